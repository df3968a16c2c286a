"""Queries on aggregates (survey family A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import half_up, set_text, stable_key
from tessera.operators import aggregates as agg
from tessera.plans.registry import query
from tessera.session import table


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
  count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) FILTER (o_orderstatus = 'X') AS n_x FROM orders GROUP BY o_orderpriority""")
def quality_summary_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by value, zero-filled, in one pass."""
    return agg.counts_of(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"], ["o_orderpriority"])


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS returned,
  count(DISTINCT l_orderkey) FILTER (l_discount > 0.05) AS cut_orders FROM lineitem GROUP BY l_suppkey""")
def filtered_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts under conditions."""
    parts = F.countDistinct("l_partkey").alias("parts")
    returned = F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(parts, returned, F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_orderkey"))).alias("cut_orders"))


STATUS = """CASE WHEN l_quantity > 49 THEN 4 WHEN l_discount IS NULL THEN 3 WHEN l_tax > 0.07 THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END"""


@query(f"""SELECT l_orderkey, ['ELIGIBLE','CONDITIONAL','NEEDS_CONFIRMATION','CONFLICTING_EVIDENCE','INELIGIBLE'][max({STATUS}) + 1] AS status FROM lineitem GROUP BY l_orderkey""")
def severity_max_status(spark: SparkSession, sf: str) -> DataFrame:
    """The most severe status of a group."""
    status = F.when(F.col("l_quantity") > 49, "INELIGIBLE").when(F.col("l_discount").isNull(), "CONFLICTING_EVIDENCE").when(F.col("l_tax") > 0.07, "NEEDS_CONFIRMATION").when(F.col("l_returnflag") == "N", "CONDITIONAL").otherwise("ELIGIBLE")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(agg.worst_of_group(status).alias("status"))


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS a, CASE WHEN c_acctbal > 0 THEN least(CAST(floor(c_acctbal / 500) AS INTEGER), 20) END AS b,
  CASE c_mktsegment WHEN 'BUILDING' THEN 15 WHEN 'MACHINERY' THEN 5 END AS c FROM customer)
  SELECT c_custkey, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS score,
  CAST(floor(((CASE WHEN a IS NULL THEN 0 ELSE 25 END) + (CASE WHEN b IS NULL THEN 0 ELSE 20 END) + (CASE WHEN c IS NULL THEN 0 ELSE 15 END)) * 100 / 60.0 + 0.5) AS BIGINT) AS coverage,
  CAST(floor((floor(((CASE WHEN a IS NULL THEN 0 ELSE 25 END) + (CASE WHEN b IS NULL THEN 0 ELSE 20 END) + (CASE WHEN c IS NULL THEN 0 ELSE 15 END)) * 100 / 60.0 + 0.5) + 40) / 2 + 0.5) AS BIGINT) AS overall FROM d""")
def weighted_scores_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown dimensions earn nothing and lower coverage."""
    c = table(spark, sf, "customer")
    points = [F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")), F.when(F.col("c_acctbal") > 0, F.least(F.floor(F.col("c_acctbal") / 500).cast("int"), F.lit(20))), F.when(F.col("c_mktsegment") == "BUILDING", 15).when(F.col("c_mktsegment") == "MACHINERY", 5)]
    score, coverage = agg.scored(points, [25, 20, 15])
    return c.select("c_custkey", score.alias("score"), coverage.alias("coverage"), half_up((coverage + 40) / 2).alias("overall"))


@query("""WITH k AS (SELECT sha256(concat_ws('|', c_mktsegment, o_orderpriority, CAST(c_nationkey AS VARCHAR))) AS lineage, year(o_orderdate) AS y, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
  g AS (SELECT lineage, list_sort(list(DISTINCT y)) AS ys, count(*) AS n_rows, min_by(o_orderkey, (-y, o_orderkey)) AS representative FROM k GROUP BY lineage), w AS (SELECT min(y) AS a, max(y) AS b FROM k)
  SELECT lineage, array_to_string(ys, ',') AS years, n_rows, representative, (len(ys) = ys[-1] - ys[1] + 1) AS contiguous,
  CASE WHEN b - a + 1 < 2 THEN 'INSUFFICIENT_HISTORY' WHEN len(ys) = 1 THEN 'SINGLE_OCCURRENCE' WHEN len(ys) = ys[-1] - ys[1] + 1 THEN 'RECURRING_ANNUAL' ELSE 'INTERMITTENT' END AS signal, b - ys[-1] AS years_since FROM g, w""")
def lineage_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """What recurs across years, and what that says."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.select(stable_key(F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("c_nationkey").cast("string")).alias("lineage"), F.year("o_orderdate").alias("y"), "o_orderkey")
    found = agg.lineages(o, ["lineage"], "y", "o_orderkey")
    signal = agg.recurrence(F.col("years"), F.col("contiguous"), F.col("window_start"), F.col("window_end"))
    return found.select("lineage", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "n_rows", "representative", "contiguous", signal.alias("signal"), (F.col("window_end") - F.col("last_year")).alias("years_since"))


@query("""SELECT month(d) AS month, count(*) AS events FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1""")
def month_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Unique events by month."""
    return table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d")).distinct().groupBy(F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT subject, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS subject FROM part) GROUP BY subject ORDER BY n DESC, subject""")
def subject_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Unnest and count."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("subject"))
    return words.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subject")


@query("""WITH u AS (SELECT 'flag' AS stage, l_returnflag AS state, l_quantity AS v FROM lineitem UNION ALL SELECT 'status', l_linestatus, l_quantity FROM lineitem UNION ALL SELECT 'month', lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0'), NULL FROM lineitem)
  SELECT stage, state, count(*) AS n, CAST(floor(avg(v) + 0.5) AS BIGINT) AS mean_value FROM u GROUP BY stage, state""")
def stage_state_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Stages by state in one pass over unpivoted rows."""
    rows = table(spark, sf, "lineitem").selectExpr("stack(3, 'flag', l_returnflag, l_quantity, 'status', l_linestatus, l_quantity, 'month', lpad(cast(month(l_shipdate) as string), 2, '0'), null) as (stage, state, v)")
    return rows.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("v") + 0.5).cast("long").alias("mean_value"))


@query("""SELECT y.year, count(o.o_orderkey) AS n, coalesce(bool_and(o.o_orderstatus <> 'P'), false) AS complete FROM (SELECT unnest(range(1993, 2004)) AS year) y
  LEFT JOIN orders o ON year(o.o_orderdate) = y.year GROUP BY y.year""")
def annual_with_empty_years(spark: SparkSession, sf: str) -> DataFrame:
    """A year without records is there, and is not complete."""
    out = agg.every_year(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), 1993, 2003, "y", [F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_orderstatus") != "P").alias("complete")])
    return out.select("year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("complete", F.lit(False)).alias("complete"))


ROUTES = "CASE WHEN p_size > 25 THEN ['large'] ELSE [] END || CASE WHEN p_retailprice > 1500 THEN ['costly'] ELSE [] END || CASE WHEN p_type = 'STANDARD' THEN ['standard'] ELSE [] END"


@query(f"""WITH r AS (SELECT p_partkey, p_brand, p_size, unnest({ROUTES}) AS route FROM part), g AS (SELECT route, count(*) AS postings, count(DISTINCT p_brand) AS brands,
  count(*) FILTER (p_size > 40) AS formal, CAST(floor(100.0 * count(*) FILTER (p_size > 40) / count(*)) AS BIGINT) AS coverage, list_sort(list(DISTINCT p_brand)) AS b FROM r GROUP BY route)
  SELECT route, postings, brands, formal, coverage, array_to_string(b[1:8], ',') AS first_brands,
  CASE WHEN coverage >= 60 AND postings >= 20 THEN 'STRONG' WHEN coverage >= 60 AND postings >= 5 THEN 'MODERATE' WHEN postings >= 3 THEN 'LIMITED' ELSE 'WEAK' END AS strength FROM g""")
def route_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """A record in several routes, aggregates per route."""
    routes = F.array_compact(F.array(F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 1500, "costly"), F.when(F.col("p_type") == "STANDARD", "standard")))
    r = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.explode(routes).alias("route"))
    formal = F.count_if(F.col("p_size") > 40)
    g = r.groupBy("route").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("p_brand").alias("brands"), formal.alias("formal"), F.floor(100 * formal / F.count(F.lit(1))).cast("long").alias("coverage"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 8), ",").alias("first_brands"))
    return g.withColumn("strength", agg.evidence_strength(F.col("coverage"), F.col("postings")))


@query("""WITH k AS (SELECT o_orderkey, unnest(list_distinct(CASE WHEN o_totalprice > 300000 THEN ['price', 'budget'] ELSE [] END || CASE WHEN o_orderstatus = 'P' THEN ['status'] ELSE [] END || CASE WHEN o_orderpriority = '1-URGENT' THEN ['priority', 'budget'] ELSE [] END)) AS key FROM orders)
  SELECT key, count(DISTINCT o_orderkey) AS affected FROM k GROUP BY key""")
def qualification_impact(spark: SparkSession, sf: str) -> DataFrame:
    """For each fact, how many records it affects."""
    o = table(spark, sf, "orders")
    keys = F.concat(F.when(F.col("o_totalprice") > 300000, F.array(F.lit("price"), F.lit("budget"))).otherwise(F.array()), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("status"))).otherwise(F.array()), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("priority"), F.lit("budget"))).otherwise(F.array()))
    return agg.affected_by_key(o, "o_orderkey", keys)


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_failed, bool_or(l_returnflag = 'A') AS any_partial, bool_and(l_returnflag = 'N') AS all_ignored, CAST(sum(l_quantity) AS BIGINT) AS quantity,
  arg_min(CASE WHEN l_discount > 0.05 THEN l_partkey END, l_linenumber * 1000000 + l_partkey) FILTER (l_discount > 0.05) AS first_cut FROM lineitem GROUP BY l_orderkey""")
def archive_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Children of a record merged: any, all, sums, first known value in order."""
    first = F.min_by(F.when(F.col("l_discount") > 0.05, F.col("l_partkey")), F.when(F.col("l_discount") > 0.05, F.col("l_linenumber") * 1000000 + F.col("l_partkey")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_failed"), F.bool_or(F.col("l_returnflag") == "A").alias("any_partial"), F.bool_and(F.col("l_returnflag") == "N").alias("all_ignored"), F.sum("l_quantity").cast("long").alias("quantity"), first.alias("first_cut"))


@query("""WITH f AS (SELECT doc_id % 50 AS entity, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS field, CASE WHEN l.quality = 1 THEN 'CONFIRMED' WHEN l.quality = 0 THEN 'CONFLICT' ELSE 'MISSING' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT entity, coalesce(array_to_string(list_sort(list(DISTINCT field) FILTER (status = 'CONFIRMED')), ','), '') AS confirmed_fields, coalesce(array_to_string(list_sort(list(DISTINCT field) FILTER (status = 'CONFLICT')), ','), '') AS conflict_fields FROM f GROUP BY entity""")
def evidence_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of each status per record."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "CONFIRMED").when(F.col("quality") == 0, "CONFLICT").otherwise("MISSING")
    facts = d.select((F.col("doc_id") % 50).alias("entity"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("source")).alias("field"), status.alias("status"))
    return agg.folded_evidence(facts, ["entity"], "field", "status", ["CONFIRMED", "CONFLICT"])


@query("""SELECT l_suppkey, sha256(array_to_string(list_transform(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), lambda x: length(x) || ':' || x), ';')) AS parts_print, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = 3""")
def having_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by a condition on the group, with a print of their set."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("flags"), F.collect_set(F.col("l_partkey").cast("string")).alias("parts"), F.count(F.lit(1)).alias("n"))
    return g.filter("flags = 3").select("l_suppkey", F.sha2(set_text(F.col("parts")), 256).alias("parts_print"), "n")


@query("""SELECT source, count(*) AS parsed, count(*) FILTER (l.quality = 1) AS candidates, count(*) FILTER (l.toxic = 1) AS related, count(*) FILTER (l.quality = 1) - count(*) FILTER (l.quality = 1 AND l.toxic = 1) AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a batch per source; what is left is the difference."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    good, both = F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("parsed"), good.alias("candidates"), F.count_if(F.col("toxic") == 1).alias("related"), (good - both).alias("needs_review"))


@query("""SELECT p_partkey, CAST(floor(100 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand)) AS BIGINT) AS share FROM part""")
def index_share(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-percent shares inside a group."""
    from tessera.operators.aggregates import share_of_group

    return share_of_group(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "share")
