"""Listings of postings, captured page by page as six kinds of sites show them, and read to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.joins import exchanged
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import listings
from tessera.sources.documents import html_links

#: Kinds of sites; FRAGMENTS is JSON whose items are pieces of HTML.
KINDS = ("NUMBERED", "DECLARED_TOTAL", "JSON", "FRAGMENTS", "SUFFIX", "LINKED")
SIZE, LIMIT, YEARS = 5, 40, (2021, 2022, 2023)

#: What each listing shows: an entry for each brand and type of `part`, five postings a page; its number says its kind, and what is wrong with it.
_SHOWN = f"""e AS (SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS n FROM (SELECT DISTINCT p_brand, p_type FROM part)),
  i AS (SELECT n, n // 6 % 8 AS fault, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY n ORDER BY p_partkey) - 1 AS i FROM part JOIN e USING (p_brand, p_type)),
  s AS (SELECT n, n % 6 AS kind, fault, count(*) AS total, (count(*) + 4) // 5 AS n_pages FROM i GROUP BY ALL),
  g AS (SELECT *, unnest(range(1, n_pages + 1 + CASE WHEN kind = 4 OR fault = 7 OR n % 4 = 3 THEN 1 ELSE 0 END - CASE WHEN fault = 5 THEN 1 ELSE 0 END)) AS page FROM s),
  p AS (SELECT g.n, kind, page, list(p_partkey ORDER BY i) FILTER (p_partkey IS NOT NULL) AS uris,
    CASE WHEN kind IN (1, 2, 3) OR (kind = 0 AND g.n % 4 < 2) THEN total + CASE WHEN g.fault = 4 OR (g.fault = 3 AND page > 1) THEN 1 ELSE 0 END END AS total,
    CASE WHEN kind = 0 AND g.n % 4 = 2 THEN n_pages END AS total_pages, CASE WHEN kind = 0 AND g.fault <> 1 THEN CASE WHEN g.fault = 6 AND page = 2 THEN 1 ELSE page END END AS current,
    CASE WHEN kind = 5 THEN CASE WHEN g.fault = 1 AND page = 2 THEN CASE WHEN n_pages > 1 THEN 2 END WHEN page < n_pages THEN page + 1 END END AS next
    FROM g LEFT JOIN i ON i.n = g.n AND i.i // 5 + 1 = CASE WHEN g.fault = 1 AND page = 2 THEN 1 ELSE page END AND NOT (g.fault = 2 AND page = 2) GROUP BY ALL)"""

#: The plain fold: page after page, with the state that a reader has.
_FOLD = f"""RECURSIVE {_SHOWN},
  q AS (SELECT *, coalesce(uris, []) AS u, concat_ws('|', concat_ws(',', total, total_pages, current, next), array_to_string(coalesce(uris, []), ',')) AS print FROM p),
  f AS (SELECT n, kind, 0 AS page, CAST([] AS BIGINT[]) AS seen, CAST([] AS VARCHAR[]) AS prints, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS pages, 0 AS run, 0 AS raw, CAST(NULL AS VARCHAR) AS reason FROM s
    UNION ALL SELECT n, kind, page, now, CASE WHEN kind = 0 AND len(u) = 0 THEN prints ELSE list_append(prints, print) END, t, tp, r, raw,
      CASE WHEN kind = 0 THEN CASE WHEN said <> t THEN 'TOTAL_CHANGED' WHEN said_pages <> tp THEN 'TOTAL_PAGES_CHANGED' WHEN current <> page THEN 'UNEXPECTED_PAGE' WHEN len(u) = 0 THEN CASE WHEN r > 0 THEN 'EMPTY_PAGE' END
          WHEN r > 0 THEN 'EMPTY_MIDDLE_PAGE' WHEN again THEN 'REPEATED_PAGE' WHEN (len(now) >= t OR page >= tp) AND len(now) <> t THEN 'COUNT_MISMATCH' WHEN page >= tp THEN 'REPORTED_LAST_PAGE_REACHED' WHEN len(now) >= t THEN 'REPORTED_TOTAL_REACHED' END
        WHEN kind = 4 THEN CASE WHEN again THEN 'REPEATED_PAGE' WHEN len(u) = 0 THEN 'EMPTY_PAGE' END
        WHEN kind = 5 THEN CASE WHEN again THEN 'REPEATED_PAGE' WHEN next IS NULL THEN 'NO_NEXT_LINK' END
        ELSE CASE WHEN said IS NULL THEN 'NO_TOTAL' WHEN said <> t THEN 'TOTAL_CHANGED' WHEN again AND CASE WHEN kind = 1 THEN (page - 1) * 5 ELSE len(before) END < t THEN 'REPEATED_PAGE'
          WHEN kind <> 1 AND len(u) = 0 AND len(now) < t THEN 'EMPTY_MIDDLE_PAGE' WHEN page > 1 AND len(now) = len(before) AND len(now) < t THEN 'NOTHING_NEW' WHEN page * 5 >= t THEN CASE WHEN len(now) <> t THEN 'COUNT_MISMATCH' ELSE 'REPORTED_TOTAL_REACHED' END END END
      FROM (SELECT f.n, f.kind, q.page, f.seen AS before, list_distinct(list_concat(f.seen, q.u)) AS now, f.prints, q.print, list_contains(f.prints, q.print) AND NOT (f.kind = 0 AND len(q.u) = 0) AS again, q.u, q.total AS said, coalesce(f.total, q.total) AS t,
        q.total_pages AS said_pages, coalesce(f.pages, q.total_pages) AS tp, q.current, q.next, f.run + CASE WHEN len(q.u) = 0 THEN 1 ELSE 0 END AS r, f.raw + len(q.u) AS raw FROM f JOIN q ON q.n = f.n AND q.page = f.page + 1 WHERE f.reason IS NULL AND q.page <= {LIMIT})),
  z AS (SELECT n, kind, page AS read, seen, raw, coalesce(reason, CASE WHEN page >= {LIMIT} THEN 'PAGE_LIMIT' ELSE 'NOT_CAPTURED' END) AS reason FROM f QUALIFY row_number() OVER (PARTITION BY n ORDER BY page DESC) = 1),
  l AS (SELECT z.n, p_partkey, p_name, 2020 + p_size % 5 AS year FROM z JOIN (SELECT n, unnest(seen) AS p_partkey FROM z) USING (n) JOIN part USING (p_partkey) WHERE reason IN {listings.COMPLETE} AND p_size % 3 <> 0 AND 2020 + p_size % 5 IN {YEARS})"""


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The entries, one for each brand and type, numbered in order: a catalogue of a fixed size."""
    place = F.row_number().over(W.orderBy("p_brand", "p_type")) - 1
    return table(spark, sf, "part").select("p_brand", "p_type").distinct().withColumn("n", place)


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as they were fetched: entry, kind, page, body. Each kind words its totals and links in its own way."""
    p, c = table(spark, sf, "part"), F.col
    items = p.join(F.broadcast(_numbered(spark, sf)), ["p_brand", "p_type"]).withColumn("i", F.row_number().over(W.partitionBy("n").orderBy("p_partkey")) - 1)
    title = F.concat("p_name", F.when(c("p_size") % 3 != 0, "招聘公告").otherwise("通知"), F.lit(" "), (2020 + c("p_size") % 5).cast("string"), F.lit("年"))
    uri = F.concat(F.lit("/item/"), "p_partkey")
    link = F.concat(F.lit('<li><a href="'), uri, F.lit('">'), title, F.lit("</a></li>"))
    each = F.sort_array(F.collect_list(F.struct("i", link.alias("link"), F.struct(uri.alias("url"), title.alias("title")).alias("item"))))
    shown = items.groupBy("n", (F.floor(c("i") / SIZE) + 1).alias("shows")).agg(each.alias("x"))
    fault, kind = F.floor(c("n") / 6) % 8, c("n") % 6
    sites = items.groupBy("n").agg(F.count(F.lit(1)).alias("all")).withColumns({"fault": fault, "kind": kind, "n_pages": F.ceil(c("all") / SIZE)})
    extra = F.when((c("kind") == 4) | (c("fault") == 7) | (c("n") % 4 == 3), 1).otherwise(0) - F.when(c("fault") == 5, 1).otherwise(0)
    # a listing of one page that lost it has none
    pages = sites.withColumn("page", F.explode(F.filter(F.sequence(F.lit(0), c("n_pages") + extra), lambda x: x > 0)))
    pages = pages.withColumn("shows", F.when((c("fault") == 1) & (c("page") == 2), 1).otherwise(c("page")))
    pages = exchanged(pages, shown, ["n", "shows"], "left").withColumn("x", F.when(~((c("fault") == 2) & (c("page") == 2)), c("x")))
    total = c("all") + F.when((c("fault") == 4) | ((c("fault") == 3) & (c("page") > 1)), 1).otherwise(0)
    links = F.coalesce(F.array_join("x.link", ""), F.lit(""))
    says = F.concat_ws(
        " ", F.when((c("kind") == 1) | (c("n") % 4 < 2), F.format_string("共 %d 条", total)), F.when((c("kind") == 0) & (c("n") % 4 == 2), F.format_string("共 %d 页", "n_pages")),
        F.when((c("kind") == 0) & (c("fault") != 1), F.format_string("第 %d 页", F.when((c("fault") == 6) & (c("page") == 2), 1).otherwise(c("page")))),
    )
    follow = F.when(c("shows") < c("n_pages"), F.format_string('<a href="?page=%d">下一页</a>', c("shows") + 1)).otherwise("")
    html = F.concat(F.lit("<html><body><p>"), F.when(c("kind") < 2, says).otherwise(""), F.lit("</p><ul>"), links, F.lit("</ul>"), F.when(c("kind") == 5, follow).otherwise(""), F.lit("</body></html>"))
    json = F.to_json(F.struct(total.alias("total"), F.coalesce("x.item", F.array().cast("array<struct<url:string,title:string>>")).alias("items")))
    pieces = F.to_json(F.struct(total.alias("total"), F.coalesce("x.link", F.array().cast("array<string>")).alias("fragments")))
    return pages.select(c("n").cast("int").alias("entry"), F.element_at(F.array(*map(F.lit, KINDS)), (c("kind") + 1).cast("int")).alias("kind"), "page", F.when(c("kind") == 2, json).when(c("kind") == 3, pieces).otherwise(html).alias("body"))


def parsed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of captured pages, by their kind: what each says of the listing, and its links in order."""
    c = F.col
    said = lambda pattern: F.regexp_extract("body", pattern, 1).try_cast("bigint")
    is_json = c("kind").isin("JSON", "FRAGMENTS")
    data = F.from_json("body", "total bigint, items array<struct<url: string, title: string>>, fragments array<string>")
    rows = pages.withColumns({"data": F.when(is_json, data), "key": F.concat_ws("/", "entry", "page")})
    html = F.when(c("kind") == "FRAGMENTS", F.array_join("data.fragments", "")).when(~is_json, c("body"))
    found = html_links(rows.filter("kind <> 'JSON'").withColumn("html", html), "key", "html")
    found = found.withColumns({"entry": F.split_part("key", F.lit("/"), F.lit(1)).cast("int"), "page": F.split_part("key", F.lit("/"), F.lit(2)).cast("long")})
    listed = rows.filter("kind = 'JSON'").select("entry", c("page").cast("long").alias("page"), F.posexplode("data.items").alias("place", "item")).select("entry", "page", "place", c("item.url").alias("href"), c("item.title").alias("title"))
    links = found.select("entry", "page", "place", "href", "title").unionByName(listed)
    following = links.filter("title = '下一页'").select("entry", "page", c("href").alias("next"))
    facts = rows.select(
        "entry", c("page").cast("long").alias("page"), F.sha2("body", 256).alias("print"), F.concat(F.lit("?page="), "page").alias("url"), F.coalesce("data.total", said("共 (\\d+) 条")).alias("total"), said("共 (\\d+) 页").alias("total_pages"), said("第 (\\d+) 页").alias("current"),
    )
    return exchanged(facts, following, ["entry", "page"], "left"), links.filter("title <> '下一页'").withColumnRenamed("href", "uri")


def entries_of(spark: SparkSession, sf: str) -> DataFrame:
    """The contracts of the entries: one for each brand and type, whether any page of it was fetched or not."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("n") % 6 + 1).cast("int"))
    mode = F.when(kind == "FRAGMENTS", "JSON").otherwise(kind)
    return _numbered(spark, sf).select(F.col("n").cast("int").alias("entry"), F.col("p_brand").alias("source"), mode.alias("mode"), F.lit(SIZE).alias("page_size"), F.lit(LIMIT).alias("page_limit"), F.lit(0).alias("confirmations"), F.lit(False).alias("by_items"), F.lit(True).alias("historical"), F.when(F.col("n") % 3 == 0, "LIFECYCLE").otherwise("LISTING").alias("role"), F.col("n").alias("place"))


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = captured(spark, sf)
    entries = entries_of(spark, sf)
    facts, links = parsed(pages)
    ends = listings.listing_ends(entries, facts, links)
    year = F.regexp_extract("title", "(20[0-9]{2})年", 1).try_cast("int")
    return entries, ends, listings.accepted_links(ends, links.withColumn("year", year), F.col("title").contains("招聘") & F.col("year").isin(*YEARS))


@query(f"""WITH {_FOLD}
  SELECT CAST(z.n AS INTEGER) AS entry, reason, CASE WHEN reason IN {listings.COMPLETE} THEN 'COMPLETE' ELSE 'ERROR' END AS status, read AS pages, CASE WHEN kind IN (4, 5) THEN raw ELSE len(seen) END AS raw_count, count(l.n) AS accepted FROM z LEFT JOIN l ON l.n = z.n GROUP BY ALL""")
def listing_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry's captured pages read by its mode to the end, with the reason and the counts; what is not finished is an error row."""
    _, ends, accepted = _read(spark, sf)
    n = accepted.groupBy("entry").agg(F.count(F.lit(1)).alias("accepted"))
    return ends.join(n, "entry", "left").select("entry", "reason", "status", F.col("pages").cast("long").alias("pages"), "raw_count", F.coalesce("accepted", F.lit(0)).alias("accepted"))


@query(f"""WITH {_FOLD} SELECT p_brand AS source, '/item/' || l.p_partkey AS uri, CAST(year AS INTEGER) AS year FROM l JOIN part USING (p_partkey)""")
def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all entries of a source, each once."""
    entries, _, accepted = _read(spark, sf)
    return listings.merged_links(accepted, entries).select("source", "uri", "year")


@query(f"""WITH {_FOLD}, t AS (SELECT z.n, p_brand AS source, z.n % 4 <> 1 AS required, y.year, z.n % 10 = 0 AND y.year = 2022 AS gap, reason IN {listings.COMPLETE} AS done, read, CASE WHEN kind IN (4, 5) THEN raw ELSE len(seen) END AS raw_count, (SELECT count(*) FILTER (l.year = y.year) FROM l WHERE l.n = z.n) AS own, (SELECT count(*) FROM l WHERE l.n = z.n) AS whole
    FROM z JOIN e ON e.n = z.n CROSS JOIN (SELECT unnest({list(YEARS)}) AS year) y WHERE z.n % 7 <> 0 OR y.year < 2023),
  ev AS (SELECT source, CAST(year AS INTEGER) AS year, coalesce(sum(read) FILTER (done), 0) AS pages, coalesce(sum(raw_count) FILTER (done), 0) AS raw, coalesce(sum(own) FILTER (done), 0) AS accepted, coalesce(sum(greatest(raw_count - whole, 0)) FILTER (done), 0) AS filtered, count(*) FILTER (NOT done) AS failed, count(*) FILTER (required) AS r, count(*) FILTER (required AND gap) AS gaps, count(*) FILTER (required AND done) AS ok FROM t GROUP BY source, year)
  SELECT source, year, CAST(pages AS BIGINT) AS pages, CAST(raw AS BIGINT) AS raw, CAST(accepted AS BIGINT) AS accepted, CAST(filtered AS BIGINT) AS filtered, failed, r > 0 AND gaps = 0 AND r = ok AS complete, CASE WHEN r = 0 THEN 'NO_APPLICABLE_REQUIRED_ENTRY' WHEN gaps > 0 THEN 'KNOWN_OFFICIAL_ARCHIVE_GAP' WHEN r = ok THEN 'ALL_REQUIRED_ENTRIES_COMPLETE' ELSE 'REQUIRED_ENTRY_INCOMPLETE' END AS reason FROM ev""")
def listing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What all entries of a source prove for each year."""
    entries, ends, accepted = _read(spark, sf)
    n = F.col("entry")
    entries = entries.withColumns({"required": n % 4 != 1, "years": F.when(n % 7 == 0, F.array(F.lit(2021), F.lit(2022))).otherwise(F.array().cast("array<int>")), "gaps": F.when(n % 10 == 0, F.array(F.lit(2022))).otherwise(F.array().cast("array<int>"))})
    return listings.evidence_by_year(entries, ends, accepted, list(YEARS))
