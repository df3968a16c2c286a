"""Wordings and small readers: forms of text, ordinals, stages, yes and no, claims; searches, JSON listings, lists in scripts, linked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.scan import finder
from tessera.plans.personal import dealt
from tessera.plans.postings import literal
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import documents as src

#: Texts and what they say, each before or after a posting's own name or size.
WIDE = [("Ｊａｖａ　开发（高级）", "java开发高级"), ("㈱Ａ－Ｂ Ⅷ ①", "株abviii1"), ("ﬁle_名·称", "file名称"), ("", ""), ("ÀÉ　１２３", "àé123")]
ORDINALS = [("看第３个", 3), ("第二十一条", 21), ("第 十 项怎么样", 10), ("第两个", 2), ("第九十九个", 99), ("第100个", None), ("三个", None), (None, None)]
STAGES = [("资格复审和面试通知", "QUALIFICATION_REVIEW,INTERVIEW"), ("笔试安排", "WRITTEN_EXAM"), ("笔试成绩及入围体检", "SCORE_RESULT,PHYSICAL_EXAM"), ("考察后公示", "INVESTIGATION,PUBLICATION"), ("办理聘用手续", "APPOINTMENT"), ("招聘公告", "")]
ANSWERS = [("是", True), (" 有 ", True), ("否", False), ("无", False), ("待定", None), (None, None)]
CLAIM, DISCLAIMER = "符合条件|可以报名", "不能判断|无法确认|不代表"
CLAIMS = [("你符合条件。", True), ("无法确认你是否符合条件", False), ("无法确认；可以报名", True), ("请看公告", False), ("不代表任何结论。可以报名吗", True), (None, False)]


def _said(values: list, i: int) -> str:
    return f"({literal([v[i] for v in values])})[1 + p_partkey % {len(values)}]"


@query(f"""SELECT p_partkey, {_said(WIDE, 1)} || replace(lower(p_name), ' ', '') AS form, coalesce({_said(ORDINALS, 1)}, CASE WHEN {_said(ORDINALS, 0)} IS NULL THEN p_size END) AS ordinal, {_said(STAGES, 1)} AS stages, {_said(ANSWERS, 1)} AS answer, {_said(CLAIMS, 1)} AS claims FROM part""")
def worded_values(spark: SparkSession, sf: str) -> DataFrame:
    """what texts say, told from the texts."""
    p = table(spark, sf, "part")
    said = lambda values: dealt([v[0] for v in values], F.col("p_partkey"))
    numbered = F.coalesce(said(ORDINALS), F.format_string("其第 %d 条", "p_size"))
    stages = F.array_join(tx.labels(F.concat("p_name", F.lit(" "), said(STAGES)), tx.STAGES), ",")
    return p.select("p_partkey", tx.nfkc(F.concat(said(WIDE), F.upper("p_name"))).alias("form"), tx.ordinal(numbered).alias("ordinal"), stages.alias("stages"), tx.yes_no(said(ANSWERS), ["是", "有"], ["否", "无"]).alias("answer"), tx.says_without_disclaimer(said(CLAIMS), CLAIM, DISCLAIMER).alias("claims"))


#: Searches by what they give: a status, a priority, the first and the last day; any may be missing.
SEARCHES = [("O", None, None, None), (None, "1-URGENT", "1997-01-01", None), ("F", "5-LOW", None, "1996-06-30"), (None, None, "2000-03-01", "2000-03-31"), ("P", "2-HIGH", "1996-01-01", "1999-12-31")]


def _where(status: str | None, priority: str | None, low: str | None, high: str | None) -> str:
    parts = [f"o_orderstatus = '{status}'" if status else "", f"o_orderpriority = '{priority}'" if priority else "", f"CAST(o_orderdate AS DATE) >= DATE '{low}'" if low else "", f"CAST(o_orderdate AS DATE) <= DATE '{high}'" if high else ""]
    return " AND ".join(filter(None, parts))


@query(" UNION ALL ".join(f"SELECT {i} AS search, o_orderkey, o_custkey FROM orders WHERE {_where(*s)}" for i, s in enumerate(SEARCHES)))
def dynamic_searches(spark: SparkSession, sf: str) -> DataFrame:
    """P10: filters that are joined by AND, as many as a search gives."""
    day, out = F.col("o_orderdate").cast("date"), None
    for i, (status, priority, low, high) in enumerate(SEARCHES):
        equal = {k: v for k, v in (("o_orderstatus", status), ("o_orderpriority", priority)) if v}
        where = [c for c, given in ((day >= F.lit(low).cast("date"), low), (day <= F.lit(high).cast("date"), high)) if given]
        found = finder(table(spark, sf, "orders"), equal, where).select(F.lit(i).alias("search"), "o_orderkey", "o_custkey")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH p AS (SELECT p_brand, p_partkey // 10 AS page, count(*) AS n FROM part GROUP BY ALL), d AS (SELECT p_brand, sum(n) + CASE WHEN p_brand LIKE '%3' THEN 1 ELSE 0 END AS declared, sum(n) AS items, count(*) AS pages FROM p GROUP BY p_brand) SELECT p_brand, CAST(declared AS BIGINT) AS declared, CAST(items AS BIGINT) AS items, declared = items AS complete FROM d""")
def declared_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Items of JSON pages, with the total that each page declares; a listing is complete if they agree."""
    p = table(spark, sf, "part")
    total = p.groupBy("p_brand").agg((F.count(F.lit(1)) + F.first(F.when(F.col("p_brand").endswith("3"), 1).otherwise(0))).alias("total"))
    items = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.collect_list(F.struct(F.col("p_name").alias("title"), F.col("p_partkey").alias("code"))).alias("items"))
    pages = items.join(total, "p_brand").select("p_brand", "page", F.to_json(F.struct("total", "items")).alias("body"))
    rows = src.pages_to_rows(pages, "body", "title: string, code: bigint", "total")
    found = rows.groupBy("p_brand").agg(F.max("declared").alias("declared"), F.countDistinct("item.code").alias("items"))
    return found.withColumn("complete", F.col("declared") == F.col("items"))


@query("""SELECT p_partkey // 25 AS page, p_partkey AS code, p_name || ' ]' AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS size FROM part WHERE (p_partkey // 25) % 6 <> 5""")
def script_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of a list in a page's script, as JavaScript writes them; every sixth page has two such lists, and is left out."""
    p = table(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / 25))
    one = F.concat(F.lit("{ code: "), F.col("p_partkey").cast("string"), F.lit(", 'title': \""), "p_name", F.lit(" ]\", /* [ list: */ "), F.when(F.col("p_partkey") % 3 != 0, F.format_string("size: %d, ", "p_size")).otherwise(""), F.lit("}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))), lambda x: x["x"]), ",\n")
    pages = p.groupBy("page").agg(body.alias("body"))
    script = F.concat(F.lit("<html><script>// list: [1]\nvar data = { mylist: [1], list : [\n"), "body", F.lit(",\n], other: 'list: [2]'"), F.when(F.col("page") % 6 == 5, ", list: []").otherwise(""), F.lit("};</script></html>"))
    items = src.embedded_items(pages.select("page", script.alias("html")), "page", "html", "list", "code: bigint, title: string, size: int")
    return items.select("page", "item.*")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey + 1 + p_partkey % 3 <= (SELECT max(p_partkey) FROM part) THEN p_partkey + 1 + p_partkey % 3 ELSE p_partkey // 2 END AS next FROM part),
  w(k, step) AS (SELECT min(p_partkey), 0 FROM part UNION SELECT next, step + 1 FROM w JOIN n USING (k) WHERE step < (SELECT count(*) FROM part)) SELECT '/p/' || k AS url, CAST(min(step) AS INTEGER) AS step FROM w JOIN n USING (k) GROUP BY k""")
def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are reached from the first one by their next links, with the step; the last one leads back into the chain."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    ends = p.agg(F.min("k").alias("first"), F.max("k").alias("last"))
    ahead = F.col("k") + 1 + F.col("k") % 3
    url = lambda c: F.concat(F.lit("/p/"), c.cast("string"))
    pages = p.crossJoin(F.broadcast(ends)).select(url(F.col("k")).alias("url"), url(F.when(ahead <= F.col("last"), ahead).otherwise(F.floor(F.col("k") / 2))).alias("next"))
    first = ends.first()["first"]
    return src.followed(pages, "url", "next", f"/p/{first}").select("url", "step")
