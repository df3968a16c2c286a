"""Queries on state upkeep, questions and small reports: what the other modules leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import compact
from tessera.operators import joins
from tessera.plans.postings import EVALUATED, FIT, STABILITY, evaluated
from tessera.plans.changes import snapshots
from tessera.plans.registry import query
from tessera.session import checkpoint_folder, table
from tessera.sources.state import VersionedState


@query(f"WITH {EVALUATED} " + " UNION ALL ".join(f"SELECT candidate, p_partkey, '{k}' AS dimension, {k} AS points, {m} AS most FROM d" for k, m in (FIT | STABILITY).items()))
def decision_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Each decision's dimensions as rows."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("long").alias("points"), F.lit(m).alias("most")) for k, m in (FIT | STABILITY).items())))
    return evaluated(spark, sf).select("candidate", "p_partkey", each.alias("x")).select("candidate", "p_partkey", "x.*")


@query("""WITH m AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT') AS interview, max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '2-HIGH') AS exam FROM orders GROUP BY o_custkey)
  SELECT c_custkey, coalesce(m.interview, DATE '1990-01-01') AS interview, m.exam FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def stage_update(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of a process from matched records; a stored one stays where none matched."""
    day = F.col("o_orderdate").cast("date")
    m = table(spark, sf, "orders").groupBy("o_custkey").agg(*(F.max(F.when(F.col("o_orderpriority") == p, day)).alias(n) for n, p in (("interview", "1-URGENT"), ("exam", "2-HIGH"))))
    return table(spark, sf, "customer").join(m, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("interview", F.lit("1990-01-01").cast("date")).alias("interview"), "exam")


@query("""SELECT o_orderkey, coalesce(x.top, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) x ON l_orderkey = o_orderkey
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)""")
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    """An update from a join, a delete using one."""
    l = table(spark, sf, "lineitem")
    top = l.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("top"))
    gone = l.filter("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.lacking(table(spark, sf, "orders"), gone, ["o_orderkey"]).join(top, "o_orderkey", "left").select("o_orderkey", F.coalesce("top", "o_totalprice").alias("price"))


@query("""SELECT user_id, array_to_string(list_sort(list(event_type || '=' || CAST(last AS VARCHAR))), ';') AS verified FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL) GROUP BY user_id""")
def checkpoint_map(spark: SparkSession, sf: str) -> DataFrame:
    """Per key the latest of each checkpoint."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "last"))), ";").alias("verified"))


@query(f"""WITH {EVALUATED} SELECT p_partkey, status FROM d WHERE candidate = 2 AND status <> 'INELIGIBLE' ORDER BY sev, (p_partkey % 2 = 0) DESC, fit DESC, nullif(p_type, 'ECONOMY') NULLS LAST, p_partkey LIMIT 60""")
def match_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The queue by severity, identity, fit, owner with nulls last."""
    from tessera.operators.aggregates import severity

    e = evaluated(spark, sf).filter("candidate = 2 and status <> 'INELIGIBLE'")
    return e.orderBy(severity(F.col("status")), (F.col("p_partkey") % 2 == 0).desc(), F.desc("fit"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).asc_nulls_last(), "p_partkey").limit(60).select("p_partkey", "status")


@query("""SELECT p_partkey, array_to_string(list_distinct([lower(p_name), lower(p_type), lower(p_name)]), '；') IS NOT NULL AS has_text, len(list_distinct([replace(lower(p_name), ' ', ''), lower(p_type), replace(lower(p_name), ' ', '')])) AS pieces, concat_ws('；', nullif(p_name, 'small ring'), p_type) AS joined FROM part""")
def joined_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """non-blank texts joined, equal ones in compact form once."""
    pieces = F.array_distinct(F.transform(F.array("p_name", "p_type", "p_name"), compact))
    return table(spark, sf, "part").select("p_partkey", (F.size(pieces) > 0).alias("has_text"), F.size(pieces).cast("long").alias("pieces"), F.concat_ws("；", F.nullif(F.col("p_name"), F.lit("small ring")), "p_type").alias("joined"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'T1' WHEN contains(lower(text), 'ion') THEN 'T2' END AS tier, CASE WHEN contains(lower(text), 'and') THEN 'and' END AS place FROM conversations WHERE role = 'user'""")
def question_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a text names, as filters; a small example of F27."""
    q = F.lower("text")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.when(q.contains("the"), "T1").when(q.contains("ion"), "T2").alias("tier"), F.when(q.contains("and"), "and").alias("place"))


@query("""SELECT l_orderkey, max(greatest(l_shipdate, o_orderdate + INTERVAL 60 DAY)) AS latest FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') GROUP BY l_orderkey""")
def greatest_time(spark: SparkSession, sf: str) -> DataFrame:
    """The later of two times; unresolved states by list."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"))
    l = table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return l.groupBy("l_orderkey").agg(F.max(F.greatest("l_shipdate", F.col("o_orderdate") + F.expr("interval 60 days"))).alias("latest"))


@query("""WITH s AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['current', 'target'] WHEN c_custkey % 3 = 1 THEN ['current'] ELSE ['target'] END) AS scenario, 2010 + c_custkey % 18 AS grad FROM customer)
  SELECT c_custkey, scenario, CASE WHEN scenario = 'current' AND grad BETWEEN 2022 AND 2024 THEN 'ELIGIBLE' WHEN scenario = 'target' AND grad BETWEEN 2024 AND 2026 THEN 'ELIGIBLE' WHEN grad >= 2020 THEN 'NEEDS_CONFIRMATION' ELSE 'INELIGIBLE' END AS status FROM s""")
def graduate_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted years shifted to a target year; a small example, see planning for R20-R22."""
    k = F.col("c_custkey")
    set_ = F.when(k % 3 == 0, F.array(F.lit("current"), F.lit("target"))).when(k % 3 == 1, F.array(F.lit("current"))).otherwise(F.array(F.lit("target")))
    s = table(spark, sf, "customer").select(k, F.explode(set_).alias("scenario"), (2010 + k % 18).alias("grad"))
    first = F.when(F.col("scenario") == "current", 2022).otherwise(2024)
    status = F.when(F.col("grad").between(first, first + 2), "ELIGIBLE").when(F.col("grad") >= 2020, "NEEDS_CONFIRMATION").otherwise("INELIGIBLE")
    return s.select(k, "scenario", status.alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'T1' WHEN p_size > 20 THEN 'T2' ELSE 'T3' END AS tier, CASE WHEN p_type = 'PROMO' THEN 'DROP' WHEN p_size > 40 THEN 'APPLY' WHEN p_partkey % 4 = 0 THEN 'REVIEW' ELSE 'WATCH' END AS action FROM part""")
def legacy_watch(spark: SparkSession, sf: str) -> DataFrame:
    """A tier by size and an action; a small example, see notices for R34."""
    size = F.col("p_size")
    action = F.when(F.col("p_type") == "PROMO", "DROP").when(size > 40, "APPLY").when(F.col("p_partkey") % 4 == 0, "REVIEW").otherwise("WATCH")
    return table(spark, sf, "part").select("p_partkey", F.when(size > 40, "T1").when(size > 20, "T2").otherwise("T3").alias("tier"), action.alias("action"))


@query("""SELECT o_custkey, o_orderkey, CAST(i AS INTEGER) AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'P'), o_orderkey) AS p, o_orderstatus FROM orders) WHERE p = 1 AND o_orderstatus = 'P'""")
def first_attachment(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a list that has what is wanted, and its place."""
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    each = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", place.alias("place")).filter("o_orderstatus = 'P'")
    return each.groupBy("o_custkey").agg(F.min(F.struct("place", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.place")


@query("""SELECT page_id, length(html) - length(replace(html, '<p>', 'p>')) AS cards, CASE WHEN contains(html, '<script') THEN 1 ELSE 0 END AS scripts, (length(html) - length(replace(html, '<p>', 'p>'))) > 0 AS complete FROM pages""")
def page_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of a page counted; a small example of X16."""
    h = F.col("html")
    cards = F.length(h) - F.length(F.replace(h, F.lit("<p>"), F.lit("p>")))
    return table(spark, sf, "pages").select("page_id", cards.cast("long").alias("cards"), h.contains("<script").cast("int").alias("scripts"), (cards > 0).alias("complete"))


@query("""WITH v(code, priority) AS (VALUES ('NATION_1', 'P0'), ('NATION_2', 'P1'), ('NOWHERE', 'P2')) SELECT v.code, v.priority, n.n_nationkey, CASE WHEN n.n_nationkey IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS state FROM v LEFT JOIN nation n ON n.n_name = v.code""")
def seeded_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A small example of X18: a fixed catalogue with what is there of it."""
    v = spark.createDataFrame([("NATION_1", "P0"), ("NATION_2", "P1"), ("NOWHERE", "P2")], "code string, priority string")
    n = table(spark, sf, "nation")
    return v.join(n, F.col("n_name") == F.col("code"), "left").select("code", "priority", "n_nationkey", F.when(F.col("n_nationkey").isNull(), "MISSING").otherwise("PRESENT").alias("state"))


@query("""SELECT 'documents' AS part, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, count(*) FILTER (lang = 'en') AS first FROM documents UNION ALL SELECT 'orders', count(*), min(o_orderkey), max(o_orderkey), count(*) FILTER (o_orderstatus = 'F') FROM orders
  UNION ALL SELECT 'events', count(*), min(event_id), max(event_id), count(*) FILTER (event_type = 'click') FROM events UNION ALL SELECT 'parts', count(*), min(p_partkey), max(p_partkey), count(*) FILTER (p_type = 'PROMO') FROM part""")
def daily_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """A small example of X11: four reports and their extents as one."""
    def part(name: str, t: str, key: str, first) -> DataFrame:
        k = F.col(key).cast("long")
        return table(spark, sf, t).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.count_if(first).alias("first"))

    out = part("documents", "documents", "n_chars", F.col("lang") == "en")
    for args in (("orders", "orders", "o_orderkey", F.col("o_orderstatus") == "F"), ("events", "events", "event_id", F.col("event_type") == "click"), ("parts", "part", "p_partkey", F.col("p_type") == "PROMO")):
        out = out.unionByName(part(*args))
    return out


@query("""WITH v1 AS (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 10 <> 0), v2 AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 10 ELSE p_retailprice END AS x FROM part WHERE p_partkey % 10 <> 1),
  d AS (SELECT 1 AS version, p_partkey, 'ADDED' AS status FROM v1 UNION ALL SELECT 2, coalesce(b.p_partkey, a.p_partkey), CASE WHEN a.p_partkey IS NULL THEN 'ADDED' WHEN b.p_partkey IS NULL THEN 'REMOVED' WHEN a.x = b.x THEN 'UNCHANGED' ELSE 'CHANGED' END FROM v1 a FULL JOIN v2 b USING (p_partkey))
  SELECT version, status, count(*) AS n, min(p_partkey) AS first_key FROM d GROUP BY ALL""")
def state_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What each version of a state changes; rows of a writer that ended before its manifest are not seen."""
    state = VersionedState(spark, f"{checkpoint_folder(spark)}/state-{uuid.uuid4().hex}", "parts", "p_partkey", "p_retailprice")
    out = None
    for n, rows in enumerate(snapshots(spark, sf), 1):
        delta = state.delta(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).select(F.lit(n).alias("version"), "status", "n", "first_key").checkpoint()
        out = delta if out is None else out.unionByName(delta)
        state.commit(rows)
        rows.limit(3).write.parquet(f"{state.folder}/data/torn-{n}")
    return out
