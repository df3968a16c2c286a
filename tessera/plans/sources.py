"""Queries on sources of notices: runs, coverage by year, connection, upkeep (survey A21-A26, T04, T05, T08, T09, T12, K08, K10, X20, X21).

Events stand for what sources did: a user is a source, an event a document that was fetched, at its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table

#: The years that a source must have covered, and the hours that its last success may lie back (fixed values).
YEARS, FRESH_HOURS = (2024, 2025, 2026), 48
NOW = "2024-01-31 00:00:00"
CHECKPOINTS = ("CONTRACT_VERIFIED", "LIVE_SMOKE_VERIFIED", "BACKFILL_COMPLETE", "INCREMENTAL_VERIFIED")
CONNECTIONS = ("CONNECTED", "PARTIAL", "FAILED", "NOT_CONNECTED")
ROUTES = ("PUBLIC_TECH", "UNIVERSITY_HOSPITAL_IT", "RESEARCH_SUPPORT", "GOVERNMENT_SOE_DIGITAL")


def terminal_status(failed: Column, succeeded: Column) -> Column:
    """How a run ends."""
    return F.when(failed == 0, "SUCCEEDED").when(succeeded > 0, "PARTIALLY_SUCCEEDED").otherwise("FAILED")


def coverage_status(failed: Column, traversed: Column, targets: Column, accepted: Column) -> Column:
    """What a run says about a year; nothing found counts only if the listing was walked whole and accepted nothing."""
    return F.when((failed > 0) | ~traversed, "PARTIAL").when(targets > 0, "COMPLETE").when(accepted == 0, "NO_TARGET_RECORDS").otherwise("PARTIAL")


def connection_status(enabled: Column, failures: Column, last_run: Column, complete_years: Column, fresh: Column, verified: dict[str, Column]) -> Column:
    """FAILED after three failures in a row; CONNECTED with three complete years, a fresh success and checkpoints in order; else PARTIAL.

    verified: the time of each checkpoint, or null. A source without a run counts as failed once it has three failures.
    """
    contract, backfill, incremental = (verified[CHECKPOINTS[i]] for i in (0, 2, 3))
    ordered = contract.isNotNull() & backfill.isNotNull() & incremental.isNotNull() & (incremental >= backfill)
    connected = (complete_years == len(YEARS)) & fresh & ordered
    return F.when(~enabled, "NOT_CONNECTED").when((failures >= 3) & (F.coalesce(last_run, F.lit("FAILED")) == "FAILED"), "FAILED").when(F.coalesce(connected, F.lit(False)), "CONNECTED").otherwise("PARTIAL")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """source, run (a day), year of the notice, outcome of each document."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("source"), F.to_date("ts").alias("run"), (2024 + F.col("event_id") % 3).alias("year"), "event_type", "value", "ts", "event_id")


_DOCUMENTS = "x AS (SELECT user_id AS source, CAST(ts AS DATE) AS run, 2024 + event_id % 3 AS year, event_type, value, ts, event_id FROM events)"
_FAILED, _TARGET, _ACCEPTED = "event_type = 'error'", "event_type = 'purchase'", "event_type IN ('click', 'purchase')"


@query(f"WITH {_DOCUMENTS} SELECT source, run, count(*) AS discovered, count(*) FILTER (NOT {_FAILED}) AS fetched, count(*) FILTER ({_FAILED}) AS failed, count(*) FILTER ({_ACCEPTED}) AS parsed, CASE WHEN count(*) FILTER ({_FAILED}) = 0 THEN 'SUCCEEDED' WHEN count(*) FILTER (NOT {_FAILED}) > 0 THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END AS status FROM x GROUP BY source, run")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters and terminal status of each run."""
    failed, fetched = F.count_if(F.expr(_FAILED)), F.count_if(~F.expr(_FAILED))
    return _documents(spark, sf).groupBy("source", "run").agg(F.count(F.lit(1)).alias("discovered"), fetched.alias("fetched"), failed.alias("failed"), F.count_if(F.expr(_ACCEPTED)).alias("parsed"), terminal_status(failed, fetched).alias("status"))


@query(f"""WITH {_DOCUMENTS}, g AS (SELECT source, year, count(DISTINCT run) AS pages, count(*) AS raw, count(*) FILTER ({_ACCEPTED}) AS accepted, count(*) FILTER (event_type = 'view') AS filtered, count(*) FILTER ({_FAILED} AND value > 45) AS failed, count(*) FILTER ({_TARGET}) AS targets, min(CAST(ts AS DATE)) AS earliest, max(CAST(ts AS DATE)) AS latest, bool_and(value < 49.5) AS traversed FROM x GROUP BY source, year)
  SELECT * EXCLUDE (traversed), traversed, CASE WHEN failed > 0 OR NOT traversed THEN 'PARTIAL' WHEN targets > 0 THEN 'COMPLETE' WHEN accepted = 0 THEN 'NO_TARGET_RECORDS' ELSE 'PARTIAL' END AS status FROM g""")
def year_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Listing evidence of each source and year, and what it says."""
    day = F.to_date("ts")
    failed, targets, accepted = F.count_if(F.expr(f"{_FAILED} and value > 45")), F.count_if(F.expr(_TARGET)), F.count_if(F.expr(_ACCEPTED))
    traversed = F.every(F.col("value") < 49.5)
    g = _documents(spark, sf).groupBy("source", "year").agg(F.countDistinct("run").alias("pages"), F.count(F.lit(1)).alias("raw"), accepted.alias("accepted"), F.count_if(F.col("event_type") == "view").alias("filtered"), failed.alias("failed"), targets.alias("targets"), F.min(day).alias("earliest"), F.max(day).alias("latest"), traversed.alias("traversed"))
    return g.withColumn("status", coverage_status(F.col("failed"), F.col("traversed"), F.col("targets"), F.col("accepted")))


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with their route and connection status."""
    d = _documents(spark, sf)
    newest = W.partitionBy("source").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = d.filter(F.col("event_type").isin("purchase", "click", "error")).withColumn("status", F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "click", "PARTIALLY_SUCCEEDED").otherwise("FAILED")).withColumn("place", F.row_number().over(newest))
    first_other = F.min(F.when(F.col("status") != "FAILED", F.col("place")))
    runs = runs.groupBy("source").agg((F.coalesce(first_other, F.count(F.lit(1)) + 1) - 1).alias("failures"), F.max(F.when(F.col("place") == 1, F.col("status"))).alias("last_run"), F.max(F.when(F.col("place") == 1, F.col("ts"))).alias("ended"))
    held = d.filter("event_type = 'view'").groupBy("source", "year").agg(F.max_by(F.col("value") >= 5, F.struct("ts", "event_id")).alias("done"))
    held = held.groupBy("source").agg(F.count_if("done").alias("complete_years"))
    kind = F.element_at(F.array(*map(F.lit, CHECKPOINTS)), (F.col("event_id") % 4 + 1).cast("int"))
    marks = d.filter("event_type = 'signup' and value > 10").groupBy("source").agg(*(F.max(F.when(kind == c, F.col("ts"))).alias(c) for c in CHECKPOINTS))
    every = d.select("source").distinct().join(runs, "source", "left").join(held, "source", "left").join(marks, "source", "left")
    fresh = (F.col("last_run") == "SUCCEEDED") & (F.col("ended") >= F.lit(NOW).cast("timestamp_ntz") - F.expr(f"interval {FRESH_HOURS} hours"))
    status = connection_status(F.col("source") % 10 != 0, F.coalesce("failures", F.lit(0)), F.col("last_run"), F.coalesce("complete_years", F.lit(0)), F.coalesce(fresh, F.lit(False)), {c: F.col(c) for c in CHECKPOINTS})
    return every.select("source", F.element_at(F.array(*map(F.lit, ROUTES)), (F.col("source") % 4 + 1).cast("int")).alias("route"), status.alias("status"))


_CONNECTIONS = f"""{_DOCUMENTS}, r AS (SELECT source, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'click' THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END AS status, ts, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS place FROM x WHERE event_type IN ('purchase', 'click', 'error')),
  a AS (SELECT source, coalesce(min(place) FILTER (status <> 'FAILED'), count(*) + 1) - 1 AS failures, max(status) FILTER (place = 1) AS last_run, max(ts) FILTER (place = 1) AS ended FROM r GROUP BY source),
  y AS (SELECT source, count(*) FILTER (done) AS complete_years FROM (SELECT source, year, value >= 5 AS done FROM x WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY source, year ORDER BY ts DESC, event_id DESC) = 1) GROUP BY source),
  m AS (SELECT source, {', '.join(f'max(ts) FILTER (event_id % 4 = {i}) AS c{i}' for i in range(4))} FROM x WHERE event_type = 'signup' AND value > 10 GROUP BY source),
  s AS (SELECT source, {list(ROUTES)}[source % 4 + 1] AS route, CASE WHEN source % 10 = 0 THEN 'NOT_CONNECTED' WHEN coalesce(failures, 0) >= 3 AND coalesce(last_run, 'FAILED') = 'FAILED' THEN 'FAILED' WHEN coalesce(complete_years, 0) = 3 AND last_run = 'SUCCEEDED' AND ended >= TIMESTAMP '{NOW}' - INTERVAL {FRESH_HOURS} HOUR AND c0 IS NOT NULL AND c2 IS NOT NULL AND c3 >= c2 THEN 'CONNECTED' ELSE 'PARTIAL' END AS status
    FROM (SELECT DISTINCT source FROM x) LEFT JOIN a USING (source) LEFT JOIN y USING (source) LEFT JOIN m USING (source))"""


@query(f"WITH {_CONNECTIONS} SELECT * FROM s")
def source_connections(spark: SparkSession, sf: str) -> DataFrame:
    """The connection status of each source."""
    return connections(spark, sf)


@query(f"WITH {_CONNECTIONS} SELECT coalesce(route, 'ALL') AS route, count(*) AS targets, " + ", ".join(f"count(*) FILTER (status = '{c}') AS n_{c.lower()}" for c in CONNECTIONS) + ", count(*) FILTER (status = 'CONNECTED') = count(*) AS complete FROM s GROUP BY ROLLUP (route)")
def market_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources of each route, and of all, are connected, and whether all are."""
    n = F.count(F.lit(1))
    g = connections(spark, sf).rollup("route").agg(n.alias("targets"), *(F.count_if(F.col("status") == c).alias(f"n_{c.lower()}") for c in CONNECTIONS), (F.count_if(F.col("status") == "CONNECTED") == n).alias("complete"))
    return g.withColumn("route", F.coalesce("route", F.lit("ALL")))


def merged_coverage(stored: DataFrame, found: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """An incremental run's coverage merged into what is stored.

    A conclusive row (COMPLETE or NO_TARGET_RECORDS) and a partial one from a whole traversal stay as they are; else counts
    grow to the larger ones, and the row says that it saw a window only. Status and basis are columns of stored.
    """
    names = [*counts, "status", "basis"]
    a = stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in names))
    x = a.join(found.select(*keys, *counts), keys, "full")
    known = F.col("_status").isNotNull()
    stays = known & (F.col("_status").isin("COMPLETE", "NO_TARGET_RECORDS") | ((F.col("_status") == "PARTIAL") & ~F.col("_basis").eqNullSafe(F.lit("INCREMENTAL_WINDOW_ONLY")))) | F.col(counts[0]).isNull()
    picked = [F.when(stays, F.col(f"_{c}")).otherwise(F.greatest(f"_{c}", c)).alias(c) for c in counts]
    return x.select(*keys, *picked, F.when(stays, F.col("_status")).otherwise("PARTIAL").alias("status"), F.when(stays, F.col("_basis")).otherwise("INCREMENTAL_WINDOW_ONLY").alias("basis"))


_HALF = "2024-01-16"
_COUNTED = "count(*) AS discovered, count(*) FILTER (event_type <> 'error') AS fetched"


@query(f"""WITH {_DOCUMENTS}, a AS (SELECT source, year, {_COUNTED}, CASE WHEN max(value) > 49 THEN 'PARTIAL' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'COMPLETE' ELSE 'NO_TARGET_RECORDS' END AS status, CASE WHEN source % 3 = 0 THEN 'INCREMENTAL_WINDOW_ONLY' END AS basis FROM x WHERE run < DATE '{_HALF}' AND source % 4 <> 1 GROUP BY source, year),
  b AS (SELECT source, year, {_COUNTED} FROM x WHERE run >= DATE '{_HALF}' GROUP BY source, year), j AS (SELECT source, year, a.discovered AS ad, a.fetched AS af, a.status, a.basis, b.discovered AS bd, b.fetched AS bf, a.source IS NOT NULL AND (status <> 'PARTIAL' OR basis IS NULL) OR b.source IS NULL AS stays FROM a FULL JOIN b USING (source, year))
  SELECT source, year, CASE WHEN stays THEN ad ELSE greatest(ad, bd) END AS discovered, CASE WHEN stays THEN af ELSE greatest(af, bf) END AS fetched, CASE WHEN stays THEN status ELSE 'PARTIAL' END AS status, CASE WHEN stays THEN basis ELSE 'INCREMENTAL_WINDOW_ONLY' END AS basis FROM j""")
def incremental_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of a month merged into the coverage of the first."""
    d = _documents(spark, sf)
    counts = [F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("event_type") != "error").alias("fetched")]
    status = F.when(F.max("value") > 49, "PARTIAL").when(F.count_if(F.col("event_type") == "purchase") > 0, "COMPLETE").otherwise("NO_TARGET_RECORDS")
    stored = d.filter((F.col("run") < F.lit(_HALF).cast("date")) & (F.col("source") % 4 != 1)).groupBy("source", "year").agg(*counts, status.alias("status")).withColumn("basis", F.when(F.col("source") % 3 == 0, "INCREMENTAL_WINDOW_ONLY"))
    found = d.filter(F.col("run") >= F.lit(_HALF).cast("date")).groupBy("source", "year").agg(*counts)
    return merged_coverage(stored, found, ["source", "year"], ["discovered", "fetched"])


@query(f"""WITH {_DOCUMENTS}, g AS (SELECT source, run, count(*) FILTER (event_type <> 'error') AS fetched, count(*) FILTER (event_type = 'error' AND value > 40) AS failed, count(*) FILTER (event_type = 'purchase' AND value > 30) AS changes, count(DISTINCT year) AS years FROM x GROUP BY source, run),
  s AS (SELECT *, CASE WHEN failed = 0 THEN 'SUCCEEDED' WHEN fetched > 0 THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END AS status FROM g), b AS (SELECT *, coalesce(max(CASE WHEN status = 'SUCCEEDED' AND years = 3 THEN 1 END) OVER (PARTITION BY source ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS filled FROM s)
  SELECT source, min(run) FILTER (fetched > 0 AND status <> 'FAILED') AS smoke, min(run) FILTER (status = 'SUCCEEDED' AND years = 3) AS backfill, min(run) FILTER (filled AND status = 'SUCCEEDED' AND changes = 0) AS incremental FROM b GROUP BY source""")
def checkpoint_days(spark: SparkSession, sf: str) -> DataFrame:
    """The first run that verifies each checkpoint; the incremental one asks for a backfill before it and a success that changed nothing."""
    g = _documents(spark, sf).groupBy("source", "run").agg(F.count_if(F.col("event_type") != "error").alias("fetched"), F.count_if(F.expr("event_type = 'error' and value > 40")).alias("failed"), F.count_if(F.expr("event_type = 'purchase' and value > 30")).alias("changes"), F.countDistinct("year").alias("years"))
    g = g.withColumn("status", terminal_status(F.col("failed"), F.col("fetched")))
    whole = (F.col("status") == "SUCCEEDED") & (F.col("years") == len(YEARS))
    before = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("filled", F.coalesce(F.max(whole).over(before), F.lit(False)))
    first = lambda ok: F.min(F.when(ok, F.col("run")))
    return g.groupBy("source").agg(first((F.col("fetched") > 0) & (F.col("status") != "FAILED")).alias("smoke"), first(whole).alias("backfill"), first(F.col("filled") & (F.col("status") == "SUCCEEDED") & (F.col("changes") == 0)).alias("incremental"))


@query(f"""WITH {_DOCUMENTS}, r AS (SELECT source, ts, event_id, event_type = 'error' AS failed, event_id % 5 = 0 AS manual FROM x WHERE event_type IN ('error', 'click', 'purchase')), g AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM r),
  c AS (SELECT *, CASE WHEN failed THEN count(*) FILTER (failed) OVER (PARTITION BY source, island ORDER BY ts, event_id) ELSE 0 END AS failures FROM g) SELECT source, event_id, failures, CASE WHEN NOT manual THEN ts + INTERVAL 1 HOUR END AS due FROM c""")
def failure_state(spark: SparkSession, sf: str) -> DataFrame:
    """After each run, the failures in a row, and when the next one is due; a manual run leaves that as it was (null here)."""
    r = _documents(spark, sf).filter(F.col("event_type").isin("error", "click", "purchase")).withColumn("failed", (F.col("event_type") == "error").cast("int"))
    order = W.partitionBy("source").orderBy("ts", "event_id")
    g = r.withColumn("island", F.sum(1 - F.col("failed")).over(order))
    inside = W.partitionBy("source", "island").orderBy("ts", "event_id")
    failures = F.when(F.col("failed") == 1, F.sum("failed").over(inside)).otherwise(0)
    return g.select("source", "event_id", failures.alias("failures"), F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 1 hour")).alias("due"))


@query(f"""WITH {_DOCUMENTS}, v AS (SELECT source, event_id, CAST(floor(value / 10) AS BIGINT) AS content, event_type AS meta, lag(CAST(floor(value / 10) AS BIGINT)) OVER w AS content_was, lag(event_type) OVER w AS meta_was FROM x WINDOW w AS (PARTITION BY source ORDER BY ts, event_id))
  SELECT source, event_id, CASE WHEN content_was IS NULL THEN 'ADDED' WHEN content <> content_was THEN 'UPDATED' WHEN meta <> meta_was THEN 'METADATA_UPDATED' ELSE 'UNCHANGED' END AS transition FROM v""")
def metadata_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A listing that changed while its document did not is an update of the metadata alone."""
    order = W.partitionBy("source").orderBy("ts", "event_id")
    content, meta = F.floor(F.col("value") / 10), F.col("event_type")
    was = F.lag(content).over(order)
    kind = F.when(was.isNull(), "ADDED").when(content != was, "UPDATED").when(meta != F.lag(meta).over(order), "METADATA_UPDATED").otherwise("UNCHANGED")
    return _documents(spark, sf).select("source", "event_id", kind.alias("transition"))


@query(f"""WITH {_DOCUMENTS}, known AS (SELECT DISTINCT source, year, event_type AS document FROM x WHERE run < DATE '{_HALF}'), seen AS (SELECT DISTINCT source, year, event_type AS document FROM x WHERE run >= DATE '2024-01-28' AND event_type <> 'error'), whole AS (SELECT source, count(*) FILTER (event_type = 'error' AND value > 45) = 0 AS traversed FROM x WHERE run >= DATE '2024-01-28' GROUP BY source)
  SELECT k.source, k.year, k.document FROM known k JOIN whole w ON w.source = k.source AND w.traversed WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source = k.source AND s.year = k.year AND s.document = k.document)""")
def absent_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What a listing no longer names, but only of sources whose listing was walked whole."""
    d = _documents(spark, sf)
    named = d.select("source", "year", F.col("event_type").alias("document"), "run")
    late = d.filter(F.col("run") >= F.lit("2024-01-28").cast("date"))
    whole = late.groupBy("source").agg((F.count_if(F.expr("event_type = 'error' and value > 45")) == 0).alias("traversed")).filter("traversed").select("source")
    seen = named.filter((F.col("run") >= F.lit("2024-01-28").cast("date")) & (F.col("document") != "error")).select("source", "year", "document").distinct()
    known = named.filter(F.col("run") < F.lit(_HALF).cast("date")).select("source", "year", "document").distinct()
    return known.join(whole, "source", "left_semi").join(seen, ["source", "year", "document"], "left_anti")


@query(f"""WITH {_DOCUMENTS}, g AS (SELECT source, run, sha256(source || '|' || run || '|' || count(*) || '|' || min(event_id)) AS print FROM x GROUP BY source, run) SELECT source, run, print, lag(print) OVER (PARTITION BY source ORDER BY run) AS parent, row_number() OVER (PARTITION BY source ORDER BY run) AS version FROM g""")
def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Audit snapshots as they are appended, each with the print of the one before it."""
    g = _documents(spark, sf).groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    g = g.select("source", "run", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("source", "run", "n", "first"))), 256).alias("print"))
    order = W.partitionBy("source").orderBy("run")
    return g.select("source", "run", "print", F.lag("print").over(order).alias("parent"), F.row_number().over(order).cast("long").alias("version"))


def discovered(stored: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Discoveries of artifacts merged into what is stored: first seen stays, attempts rise on DISCOVERED only, an earlier checksum stays if a retry has none."""
    x = stored.select(*key, *(F.col(c).alias(f"_{c}") for c in ("seen", "attempts", "checksum", "state"))).join(found, key, "full")
    tried = F.coalesce(F.col("_attempts"), F.lit(0)) + F.when(F.col("state") == "DISCOVERED", 1).otherwise(0)
    return x.select(*key, F.least("_seen", "seen").alias("seen"), tried.cast("long").alias("attempts"), F.coalesce("checksum", "_checksum").alias("checksum"), F.coalesce("state", "_state").alias("state"))


@query(f"""WITH {_DOCUMENTS}, a AS (SELECT source, event_type AS artifact, min(ts) AS seen, count(*) AS attempts, max(CAST(floor(value) AS BIGINT)) AS checksum, 'STORED' AS state FROM x WHERE run < DATE '{_HALF}' AND source % 6 <> 1 GROUP BY source, event_type),
  b AS (SELECT source, event_type AS artifact, min(ts) AS seen, CASE WHEN source % 2 = 0 THEN max(CAST(floor(value) AS BIGINT)) END AS checksum, CASE WHEN source % 3 = 0 THEN 'DISCOVERED' ELSE 'STORED' END AS state FROM x WHERE run >= DATE '{_HALF}' AND event_type <> 'view' GROUP BY source, event_type)
  SELECT source, artifact, least(a.seen, b.seen) AS seen, coalesce(a.attempts, 0) + CASE WHEN b.state = 'DISCOVERED' THEN 1 ELSE 0 END AS attempts, coalesce(b.checksum, a.checksum) AS checksum, coalesce(b.state, a.state) AS state FROM a FULL JOIN b USING (source, artifact)""")
def artifact_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    """The artifacts of a second visit merged into those of the first."""
    d = _documents(spark, sf).withColumnRenamed("event_type", "artifact")
    mark = F.max(F.floor("value"))
    stored = d.filter((F.col("run") < F.lit(_HALF).cast("date")) & (F.col("source") % 6 != 1)).groupBy("source", "artifact").agg(F.min("ts").alias("seen"), F.count(F.lit(1)).alias("attempts"), mark.alias("checksum"), F.lit("STORED").alias("state"))
    found = d.filter((F.col("run") >= F.lit(_HALF).cast("date")) & (F.col("artifact") != "view")).groupBy("source", "artifact").agg(F.min("ts").alias("seen"), mark.alias("m"))
    found = found.select("source", "artifact", "seen", F.when(F.col("source") % 2 == 0, F.col("m")).alias("checksum"), F.when(F.col("source") % 3 == 0, "DISCOVERED").otherwise("STORED").alias("state"))
    return discovered(stored, found, ["source", "artifact"])
