"""Queries on order and time: windows, paging, top-k (survey families W and O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import whole_months
from tessera.operators import scan, windows
from tessera.plans.registry import query
from tessera.session import table


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1")
def distinct_on_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row per key."""
    return windows.first_of_each(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def fill_down(spark: SparkSession, sf: str) -> DataFrame:
    """The last known value goes down."""
    e = table(spark, sf, "events").withColumn("filled", F.when(F.col("event_type") == "signup", F.col("value")))
    return windows.filled_down(e, ["user_id"], [F.col("ts"), F.col("event_id")], "filled").select("event_id", "filled")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS p FROM lineitem) WHERE p = 1")
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The first row per key."""
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")]
    return windows.first_of_each(table(spark, sf, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_errors FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a batch repeats; the first row wins, the others are errors."""
    errors = windows.repeats(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])
    return errors.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_errors"))


@query("""WITH i AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-06-30'),
  c AS (SELECT o_custkey, s, least(e, DATE '2000-06-30') AS e FROM i), f AS (SELECT *, CASE WHEN s > max(e) OVER w + 1 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f), g AS (SELECT o_custkey, island, min(s) AS s, max(e) + 1 AS x FROM n GROUP BY ALL)
  SELECT o_custkey, CAST(sum((year(x) - year(s)) * 12 + month(x) - month(s) - CASE WHEN day(x) < day(s) THEN 1 ELSE 0 END) // 12 AS BIGINT) AS years, CAST(sum(x - s) // 365 AS BIGINT) AS years_by_days, count(*) AS islands FROM g GROUP BY o_custkey""")
def employment_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Merged intervals, in whole months and in days."""
    day = F.col("o_orderdate").cast("date")
    i = table(spark, sf, "orders").select("o_custkey", day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 90).cast("int")).alias("e"))
    found = windows.islands(i, ["o_custkey"], "s", "e", F.lit("2000-06-30").cast("date")).withColumn("x", F.date_add("e", 1))
    months, days = F.sum(whole_months(F.col("s"), F.col("x"))), F.sum(F.datediff("x", "s"))
    return found.groupBy("o_custkey").agg(F.floor(months / 12).alias("years"), F.floor(days / 365).alias("years_by_days"), F.count(F.lit(1)).alias("islands"))


@query("""WITH o AS (SELECT user_id, event_id, ts, event_type = 'error' AS gone FROM events WHERE event_type <> 'signup'), l AS (SELECT *, lag(gone) OVER w AS g, lag(ts) OVER w AS b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, coalesce(gone AND g AND epoch_us(ts) - epoch_us(b) >= 21600000000, false) AS deactivated FROM l""")
def gone_counter_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Gone twice in a row, six hours apart; failures (signups here) do not count."""
    e = table(spark, sf, "events").filter("event_type <> 'signup'")
    return windows.deactivated(e, ["user_id"], "ts", [F.col("event_id")], F.col("event_type") == "error").select("event_id", "deactivated")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
  SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r""")
def failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive failures."""
    return windows.streak(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "streak")


@query("""WITH r AS (SELECT CAST(floor(event_id / 20) AS BIGINT) AS page, CAST(user_id % 40 AS VARCHAR) || event_type AS content FROM events), f AS (SELECT *, page = min(page) OVER (PARTITION BY content) AS fresh FROM r),
  g AS (SELECT page, count(*) AS n_rows, count(*) FILTER (fresh) AS n_new, array_to_string(list_sort(list(content)), ',') AS pr FROM f GROUP BY page)
  SELECT page, n_rows, n_new, row_number() OVER (PARTITION BY pr ORDER BY page) > 1 AS repeated, n_new = 0 AS no_progress FROM g""")
def listing_page_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated pages and pages without anything new."""
    e = table(spark, sf, "events").withColumn("page", F.floor(F.col("event_id") / 20).cast("long"))
    return windows.page_checks(e, "page", "event_id", F.concat((F.col("user_id") % 40).cast("string"), "event_type"))


@query("""SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 0) ORDER BY ts, event_id LIMIT 51""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a cursor, and a row more."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return scan.keyset_page(e, "at", "event_id", (F.lit("2024-01-10").cast("timestamp"), 0), 50).select("event_id", "user_id")


@query("SELECT p_partkey, p_retailprice, (SELECT count(*) FROM part WHERE p_size > 20) AS total FROM part WHERE p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    """A numbered page with the total."""
    return scan.offset_page(table(spark, sf, "part").filter("p_size > 20").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 2, 25)


@query("SELECT p_brand, count(*) FILTER (p <= 50) AS assessed, count(*) FILTER (p > 50) AS not_assessed FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS p FROM part) GROUP BY p_brand")
def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    """What a budget leaves out is said."""
    return scan.within_budget(table(spark, sf, "part"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")], 50)


@query("SELECT p_brand, p_partkey, p AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) WHERE p <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The first k of each group."""
    return scan.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "place")


@query("""SELECT s_suppkey, s_name FROM supplier ORDER BY CASE WHEN s_acctbal > 8000 THEN 0 WHEN s_acctbal > 4000 THEN 1 ELSE 2 END, nullif(s_nationkey, 3) DESC NULLS LAST, s_suppkey LIMIT 40""")
def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by CASE, nulls last, unique last key."""
    rank = F.when(F.col("s_acctbal") > 8000, 0).when(F.col("s_acctbal") > 4000, 1).otherwise(2)
    return table(spark, sf, "supplier").orderBy(rank, F.nullif(F.col("s_nationkey"), F.lit(3)).desc_nulls_last(), "s_suppkey").limit(40).select("s_suppkey", "s_name")


@query("""SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role, count(*) FILTER (role = 'user') AS asked, count(DISTINCT text) AS distinct_texts FROM conversations GROUP BY conv_id""")
def session_state(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state of a session."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "user").alias("asked"), F.countDistinct("text").alias("distinct_texts"))


#: Sources that a tick of an hour may take from each pool.
A_TICK = 2


@query(f"""WITH RECURSIVE e AS (SELECT event_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1 AS tick, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
  q AS (SELECT event_id, event_type, i, tick, tick AS served, 1 AS used FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.event_type, e.i, e.tick, CASE WHEN e.tick > q.served THEN e.tick WHEN q.used < {A_TICK} THEN q.served ELSE q.served + 1 END, CASE WHEN e.tick <= q.served AND q.used < {A_TICK} THEN q.used + 1 ELSE 1 END FROM q JOIN e ON e.event_type = q.event_type AND e.i = q.i + 1)
  SELECT event_id, event_type, served, served - tick AS waited FROM q""")
def dispatch_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall due are served at the next tick, a few a tick, in the order in which they fell due; the others wait."""
    tick = (F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 3600) + 1).cast("long")
    due = table(spark, sf, "events").select("event_id", "event_type", "ts", tick.alias("tick"))
    found = windows.dispatched(due, ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], "tick", A_TICK)
    return found.select("event_id", "event_type", "served", (F.col("served") - F.col("tick")).alias("waited"))
