"""Streams of fetch observations: document state, change log, buckets of time.

The batch form of the state machine is a window query; the streaming form keeps the same state per document
and emits the same transitions, so each can be checked against the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Hours that must lie between two failures to find a document before it counts as gone.
APART = 6 * 3600
TRANSITIONS = T.StructType([T.StructField("document", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("transition", T.StringType()), T.StructField("process", T.BooleanType()), T.StructField("at", T.LongType())])
STATE = T.StructType([T.StructField("print", T.StringType()), T.StructField("active", T.BooleanType()), T.StructField("gone", T.IntegerType()), T.StructField("gone_at", T.DoubleType()), T.StructField("done", T.StringType()), T.StructField("due", T.LongType()), T.StructField("last", T.LongType())])
#: Keeps the state of streams out of the executors' heaps.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(state: tuple | None, kind: str, print_: str | None, at: float) -> tuple[str, bool, tuple | None]:
    """One observation of a document: its transition, whether to process it, its new state.

    kind: OK with a content print, NOT_MODIFIED, GONE or FAILURE. A failure changes nothing. Gone twice, APART seconds from
    each other, deactivates; content after that is an update. Content that was not processed yet is processed again.
    """
    if state is None:
        if kind != "OK":
            return "NONE", False, None
        return "ADDED", True, (print_, True, 0, None, print_)
    known, active, gone, gone_at, done = state
    if kind == "FAILURE":
        return "NONE", False, state
    if kind == "GONE":
        off = active and gone >= 1 and gone_at is not None and at - gone_at >= APART
        return ("DEACTIVATED" if off else "UNCHANGED"), False, (known, active and not off, gone + 1, at, done)
    now = known if kind == "NOT_MODIFIED" else print_
    changed = now != known or not active
    return ("UPDATED" if changed else "UNCHANGED"), changed or now != done, (now, True, 0, None, now)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=TRANSITIONS.names).astype({"event_id": "Int64"})


class DocumentStates(StatefulProcessor):
    """The state machine of a document over a stream: rows are taken in the parts in which they come, and only the state is kept.

    A document that is gone once is due for another look APART seconds later, which a timer in event time tells, if no
    observation that says something has come before (T02). Observations older than one already taken are LATE and change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("document", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        *current, due, last = self.kept.get() if self.kept.exists() else (None,) * 7
        current, timer = None if last is None or current[1] is None else tuple(current), due
        for part in rows:
            out = []
            for r in part.sort_values(["us", "event_id"], kind="stable").itertuples(index=False):
                at = int(r.us)
                if last is not None and at < last:
                    out.append((key[0], r.event_id, "LATE", False, at))
                    continue
                last = at
                if due is not None and at >= due:
                    out.append((key[0], None, "CONFIRM_DUE", False, due))
                    due = None
                name, process, current = step(current, r.kind, r.print, at / 1e6)
                out.append((key[0], r.event_id, name, process, at))
                if r.kind != "FAILURE":
                    due = at + APART * 1_000_000 if r.kind == "GONE" and current is not None and current[1] else None
            yield _frame(out)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer // 1000)
        if due is not None and timer != due:
            self.handle.registerTimer(due // 1000)
        self.kept.update((*(current or (None,) * 5), due, last))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        *current, due, last = self.kept.get()
        if due is not None and due // 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((*current, None, last))
            yield _frame([(key[0], None, "CONFIRM_DUE", False, due)])

    def close(self) -> None:
        pass


def document_transitions(observations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Transitions of documents from a stream of observations (document, event_id, ts, kind, print), a state for each document in the state store.

    Observations must come in their order: those of a batch from one split of a file, or of files that are taken one at a time. Needs a session whose streams keep state in RocksDB, as drained() sees to.
    """
    # times go as microseconds since 1970, so that no session's zone comes between them and the timers
    timed = observations.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    found = timed.groupBy("document").transformWithStateInPandas(DocumentStates(), TRANSITIONS, "append", "EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def observed(events: DataFrame) -> DataFrame:
    """Events as observations: errors are gone, views not modified, signups failures, all else content."""
    kind = F.when(F.col("event_type") == "error", "GONE").when(F.col("event_type") == "view", "NOT_MODIFIED").when(F.col("event_type") == "signup", "FAILURE").otherwise("OK")
    return events.select(F.col("user_id").alias("document"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("props").alias("print"))


def change_feed(transitions: DataFrame) -> DataFrame:
    """What goes to the change log: transitions that say something."""
    return transitions.filter(F.col("transition").isin("ADDED", "UPDATED", "DEACTIVATED"))


def once_only(changes: DataFrame, at: str, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Changes without repeats within a delay."""
    return changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, at: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts and sums per window of time; late rows within the delay still count."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def handed_over(stream: DataFrame, folder: str, take: Callable[[DataFrame, int], object]) -> None:
    """Runs a stream over what is there and hands each batch, with its number, to a function; the checkpoint stands in folder."""
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, number: take(rows, number) and None).start().awaitTermination()


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its output as a table: to parquet in append mode, else through foreachBatch.

    The checkpoint stands beside the output; a run that is repeated goes on where the last one ended.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(*ROCKSDB[:1], None)
    spark.conf.set(*ROCKSDB)
    try:
        if mode == "append":
            query = writer.format("parquet").outputMode("append").start(out)
        else:
            query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])
    return spark.read.schema(stream.schema).parquet(out)
