"""Queries on scalar functions over text (survey family F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.registry import query
from tessera.session import table


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT lower(string_split(x, '=')[1]) IN ('from', 'spm', 'source', 'ref') AND NOT starts_with(lower(x), 'utm_'))), '&') AS qs FROM p)
  SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS uri FROM k""")
def uri_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """addresses in canonical form."""
    return table(spark, sf, "pages").select("page_id", tx.canonical_uri(F.col("url")).alias("uri"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(lower(text), 'the|and', '', 'g') AS bare FROM documents), c AS (SELECT doc_id, CASE WHEN strpos(bare, '.') > 0 THEN substr(bare, 1, strpos(bare, '.') - 1) ELSE bare END AS cut FROM b),
  n AS (SELECT doc_id, regexp_replace(cut, '[\p{P}\p{Z}\s]', '', 'g') AS stem FROM c) SELECT doc_id, CASE WHEN length(stem) >= 8 THEN stem END AS stem FROM n""")
def campaign_stem(spark: SparkSession, sf: str) -> DataFrame:
    """titles without noise, up to the first marker."""
    return table(spark, sf, "documents").select("doc_id", tx.campaign_stem(F.col("text"), "the|and", r"\.").alias("stem"))


@query(r"""WITH p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '不超过' || (p_size + 10) || '周岁' WHEN 1 THEN '18至' || (p_size + 20) || '周岁' WHEN 2 THEN '未满' || (p_size + 17) || '岁' WHEN 3 THEN (p_size + 14) || '岁以下' WHEN 4 THEN '35岁，博士可放宽' ELSE p_size || '岁' END AS t, p_size % 6 AS k, p_size AS z FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN z + 10 BETWEEN 16 AND 70 THEN z + 10 END WHEN 1 THEN CASE WHEN z + 20 BETWEEN 18 AND 70 THEN z + 20 END WHEN 2 THEN CASE WHEN z + 16 BETWEEN 16 AND 70 THEN z + 16 END WHEN 3 THEN CASE WHEN z + 14 BETWEEN 16 AND 70 THEN z + 14 END WHEN 4 THEN NULL ELSE CASE WHEN z BETWEEN 16 AND 70 THEN z END END AS age FROM p""")
def age_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    """age limits out of text."""
    z = F.col("p_size")
    text = F.when(z % 6 == 0, F.concat(F.lit("不超过"), (z + 10).cast("string"), F.lit("周岁"))).when(z % 6 == 1, F.concat(F.lit("18至"), (z + 20).cast("string"), F.lit("周岁"))).when(z % 6 == 2, F.concat(F.lit("未满"), (z + 17).cast("string"), F.lit("岁")))
    text = text.when(z % 6 == 3, F.concat((z + 14).cast("string"), F.lit("岁以下"))).when(z % 6 == 4, "35岁，博士可放宽").otherwise(F.concat(z.cast("string"), F.lit("岁")))
    return table(spark, sf, "part").select("p_partkey", tx.age_limit(text).alias("age"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'LEGAL' WHEN regexp_matches(text, '[#*|]') THEN 'TABLE' WHEN lang = 'en' THEN 'PROSE' ELSE 'OTHER' END AS family FROM documents""")
def keyword_classify(spark: SparkSession, sf: str) -> DataFrame:
    """ordered keyword rules."""
    family = tx.classify(F.lower("text"), [("LEGAL", "license"), ("TABLE", "[#*|]")])
    return table(spark, sf, "documents").select("doc_id", F.coalesce(family, F.when(F.col("lang") == "en", "PROSE").otherwise("OTHER")).alias("family"))


@query("""SELECT p_partkey, sha256(length(p_name) || ':' || p_name || CASE WHEN p_size > 25 THEN length(CAST(p_size AS VARCHAR)) || ':' || CAST(p_size AS VARCHAR) ELSE '-' END || length(p_brand) || ':' || p_brand) AS print FROM part""")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """prints in which null differs from empty."""
    return table(spark, sf, "part").select("p_partkey", tx.fingerprint(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_size")), F.col("p_brand")).alias("print"))


@query("""SELECT doc_id, CAST(round(least(CASE WHEN contains(text, 'the') THEN 0.35 ELSE 0 END + CASE WHEN contains(text, 'License') THEN 0.255 ELSE 0 END + CASE WHEN contains(text, 'ion') THEN 0.45 ELSE 0 END, 0.99), 2) AS DOUBLE) AS score FROM documents""")
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    """weighted words, decimal rounding."""
    score = tx.keyword_score(F.col("text"), {"the": 0.35, "License": 0.255, "ion": 0.45})
    return table(spark, sf, "documents").select("doc_id", score.cast("double").alias("score"))


@query("""WITH m AS (SELECT p_partkey, md5(p_name) AS h FROM part) SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM m""")
def name_uuids(spark: SparkSession, sf: str) -> DataFrame:
    """name-based identifiers."""
    return table(spark, sf, "part").select("p_partkey", tx.name_uuid(F.col("p_name")).alias("uuid"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """fields of JSON text under a fixed schema."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("""SELECT page_id, nullif(lower(regexp_extract(url, '[?&]page=([^&#]*)', 1)), '') AS page FROM pages""")
def url_parameter(spark: SparkSession, sf: str) -> DataFrame:
    """a parameter of an address."""
    return table(spark, sf, "pages").select("page_id", tx.query_parameter(F.col("url"), "page").alias("page"))


@query("""SELECT p_partkey, CAST(floor(CAST(25 * len(list_intersect(string_split(p_name, ' '), ['small', 'red', 'ring', 'bolt'])) / 4.0 AS FLOAT) + 0.5) AS BIGINT) AS points FROM part""")
def overlap_score(spark: SparkSession, sf: str) -> DataFrame:
    """points for matching values."""
    from tessera.plans.rules import overlap_points

    return table(spark, sf, "part").select("p_partkey", overlap_points(F.split("p_name", " "), F.array(*map(F.lit, ("small", "red", "ring", "bolt"))), 25).alias("points"))
