"""Queries on streams: each drains a stream over the events and is compared with batch SQL (survey family T)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import checkpoint_folder
from tessera.sources.changelog import registered
from tessera.sources.state import Ledger
from tessera.streaming import feeds


def _folder(spark: SparkSession) -> str:
    """A folder for a stream's output in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files; their schema is that of the table."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    # a file source takes a folder or a pattern
    return spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parque[t]")


#: Rows that arrive after all others, though they are older.
LATE = "event_id % 50 = 0 and ts < timestamp_ntz'2024-01-10'"


@query("""WITH x AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events WHERE NOT (event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-10'))
  SELECT CAST(d AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM x WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows under a watermark, in append mode, over two runs: rows that are later than the watermark allows are left out, and windows that it has not passed stay open."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    folder = _folder(spark)
    batch.filter(f"not ({LATE})").write.parquet(f"{folder}/in")
    for turn in (0, 1):
        if turn:
            batch.filter(LATE).write.mode("append").parquet(f"{folder}/in")
        e = spark.readStream.schema(batch.schema).parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        out = feeds.drained(feeds.tumbling(e, "ts", "1 day", "2 hours", ["event_type"]), folder)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


#: Observations of known documents; far: gone, and long after it was gone before; fars: how many such since it was last there.
_GONE = f"""WITH o AS (SELECT user_id AS document, event_id, ts, CASE event_type WHEN 'error' THEN 'GONE' WHEN 'view' THEN 'NOT_MODIFIED' ELSE 'OK' END AS kind, props FROM events WHERE event_type <> 'signup'),
  a AS (SELECT *, count(*) FILTER (kind = 'OK') OVER w AS oks, count(*) FILTER (kind <> 'GONE') OVER w AS island FROM o WINDOW w AS (PARTITION BY document ORDER BY ts, event_id)),
  b AS (SELECT *, last_value(CASE WHEN kind = 'OK' THEN props END IGNORE NULLS) OVER (PARTITION BY document ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, row_number() OVER (PARTITION BY document ORDER BY ts, event_id) AS place,
    coalesce(kind = 'GONE' AND ts - lag(ts) OVER (PARTITION BY document, island, kind = 'GONE' ORDER BY ts, event_id) >= INTERVAL {feeds.APART} SECOND, false) AS far FROM a WHERE oks > 0),
  c AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY document, island ORDER BY ts, event_id) AS fars FROM b)"""


@query(f"""{_GONE}, off AS (SELECT document, island + 1 AS island FROM c GROUP BY document, island HAVING bool_or(far)),
  t AS (SELECT c.document, event_id, CASE WHEN place = 1 THEN 'ADDED' WHEN kind = 'GONE' THEN CASE WHEN far AND fars = 1 THEN 'DEACTIVATED' END WHEN (kind = 'OK' AND props <> known) OR off.document IS NOT NULL THEN 'UPDATED' END AS transition FROM c LEFT JOIN off ON off.document = c.document AND off.island = c.island)
  SELECT document, event_id, transition, transition <> 'DEACTIVATED' AS process FROM t WHERE transition IS NOT NULL""")
def stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The document state machine over a stream."""
    found = feeds.drained(feeds.document_transitions(feeds.observed(_events(spark, sf))), _folder(spark))
    return feeds.change_feed(found).select("document", "event_id", "transition", "process")


@query(f"""{_GONE}, n AS (SELECT *, lead(ts) OVER (PARTITION BY document ORDER BY ts, event_id) AS after FROM c)
  SELECT document, ts + INTERVAL {feeds.APART} SECOND AS due FROM n WHERE kind = 'GONE' AND fars = 0 AND coalesce(after, (SELECT max(ts) FROM events)) >= ts + INTERVAL {feeds.APART} SECOND""")
def stream_rechecks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were gone and are due for another look, told by timers in event time; over two runs, so that timers outlive a run."""
    batch, folder = spark.read.parquet(f"{sf}/events.parquet"), _folder(spark)
    for part in ("ts < timestamp_ntz'2024-01-16'", "ts >= timestamp_ntz'2024-01-16'"):
        # a document's observations lie in one file, in their order; files are read side by side
        batch.filter(part).repartition("user_id").sortWithinPartitions("user_id", "event_id").write.mode("append").parquet(f"{folder}/in")
        e = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        out = feeds.drained(feeds.document_transitions(feeds.observed(e)), folder)
    return out.filter("transition = 'CONFIRM_DUE'").select("document", F.col("at").cast("timestamp_ntz").alias("due"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def stream_once_only(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's own output; over a delay as long as the table each key comes once."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.drained(feeds.once_only(e, "ts", ["user_id", "event_type", "props"], "60 days").select("user_id", "event_type", "props"), _folder(spark))


@query("""SELECT date_part('month', ts) AS month, event_type, count(*) AS n, count(*) FILTER (value > 40) AS high FROM events GROUP BY ALL""")
def coverage_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of a period by kind."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.month("ts").cast("long").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 40).alias("high"))


def _log(spark: SparkSession, path: str) -> dict[str, str]:
    registered(spark)
    return {"path": path, "at": "ts", "key": "event_id"}


#: A cursor: half past three on January 9, and the id of the last change that was read at that time.
CURSOR = {"afterAt": "1704814200000000", "afterKey": "2800"}


@query("""SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-09 15:30:00', 2800) AND ts < TIMESTAMP '2024-01-20' AND value > 5""")
def changes_after(spark: SparkSession, sf: str) -> DataFrame:
    """The change log after a cursor, through a data source that leaves out row groups by their statistics; the filter on time goes to it, too."""
    log = spark.read.format("changes").options(**_log(spark, f"{sf}/events.parquet"), **CURSOR).load()
    return log.filter("ts < timestamp_ntz'2024-01-20' and value > 5").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts, user_id FROM events")
def stream_resumed_log(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the change log whose offset is the cursor: three runs, each over what has been appended, give every change once."""
    batch, folder = spark.read.parquet(f"{sf}/events.parquet"), _folder(spark)
    for low, high in ((1, 10), (10, 20), (20, 32)):
        batch.filter(F.dayofmonth("ts").between(low, high - 1)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.format("changes").options(**_log(spark, f"{folder}/in")).load()
        out = feeds.drained(stream.select("event_id", "ts", "user_id"), folder)
    return out


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS last_event, max_by(props, (ts, event_id)) AS print, count(*) AS changes, CAST(count(DISTINCT CASE WHEN day(ts) < 10 THEN 0 WHEN day(ts) < 20 THEN 1 ELSE 2 END) AS BIGINT) AS batches FROM events GROUP BY user_id""")
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and their changes in one commit for each batch of a stream; every batch is handed over twice, as after a failure, and counts once."""
    batch, folder = spark.read.parquet(f"{sf}/events.parquet"), _folder(spark)
    ledger = Ledger(spark, f"{folder}/ledger", "events")
    latest = F.max(F.struct("ts", "event_id", "print"))

    def take(rows: DataFrame, number: int) -> None:
        rows = rows.select("user_id", "ts", "event_id", F.col("props").alias("print"))
        known = ledger.table("documents")
        all_ = rows if known is None else rows.unionByName(known)
        documents = all_.groupBy("user_id").agg(latest.alias("x")).select("user_id", "x.*")
        ledger.put({"changes": rows.select("user_id", "event_id", F.lit(number).alias("batch"))}, {"documents": documents}, number)

    for low, high in ((1, 10), (10, 20), (20, 32)):
        batch.filter(F.dayofmonth("ts").between(low, high - 1)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        feeds.handed_over(stream, folder, lambda rows, number: [take(rows, number) for _ in range(2)])
    counts = ledger.table("changes").groupBy("user_id").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("batch").alias("batches"))
    return ledger.table("documents").join(counts, "user_id").select("user_id", F.col("event_id").alias("last_event"), "print", "changes", "batches")
