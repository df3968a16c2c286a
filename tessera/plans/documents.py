"""Queries on documents as sources (survey family S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import documents as src


@query()
def html_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Text blocks of pages."""
    return src.html_fragments(table(spark, sf, "pages"), "page_id", "html")


_LINK = """'<a href="([^"]*)"[^>]*>([^<]*)</a>'"""
_PLAIN = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href, unnest(regexp_extract_all(html, {_LINK}, 2)) AS title, unnest(range(0, len(regexp_extract_all(html, {_LINK}, 1)))) AS place FROM pages),
  u AS (SELECT page_id, CAST(place AS INTEGER) AS place, {_PLAIN.format('href')} AS href, trim({_PLAIN.format('title')}) AS title FROM l) SELECT * FROM u WHERE regexp_matches(href, '^(https?://[a-z.]+)?/') AND regexp_matches(title, '^[A-Za-z]') AND title <> 'The'""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages that start with a word."""
    links = src.html_links(table(spark, sf, "pages"), "page_id", "html")
    return src.chosen_links(links, "[a-z.]+", "^[A-Za-z]", "^The$")


@query("""SELECT page_id, 'HTML' AS media_type, 'PARSE' AS action FROM pages UNION ALL SELECT page_id + 1000000, 'PNG', 'OCR_REQUIRED' FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT page_id + 2000000, 'PDF', 'UNSUPPORTED' FROM pages WHERE page_id % 10 = 1""")
def media_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types by first bytes, and what can be done with them."""
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    png = p.filter("page_id % 10 = 0").select((F.col("page_id") + 1000000).alias("page_id"), F.unhex(F.lit("89504E470D0A1A0A")).alias("content"))
    pdf = p.filter("page_id % 10 = 1").select((F.col("page_id") + 2000000).alias("page_id"), F.encode(F.lit("%PDF-1.7"), "utf-8").alias("content"))
    kind = src.media_type(F.col("content"), F.lit("page"))
    return p.unionByName(png).unionByName(pdf).select("page_id", kind.alias("media_type"), src.readable(kind).alias("action"))
