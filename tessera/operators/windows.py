"""Ordered operators: islands of intervals, fill-down, streaks, page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpoint_folder


def islands(df: DataFrame, by: list[str], start: str, end: str, until: Column | None = None, gap: int = 1) -> DataFrame:
    """Intervals of dates merged where they overlap or lie within `gap` days; clipped at `until`."""
    if until is not None:
        df = df.filter(F.col(start) <= until).withColumn(end, F.least(F.col(end), until))
    order = W.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.datediff(start, reached) > gap), 1).otherwise(0)
    numbered = df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def filled_down(df: DataFrame, by: list[str], order: list[Column], column: str) -> DataFrame:
    """The last value that was there, for rows without one."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def first_of_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order (W08, U05, W10 with a descending order)."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")


def repeats(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key came before in order: the errors of a batch in which the first wins."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_place > 1").drop("_place")


def streak(df: DataFrame, by: list[str], order: list[Column], failed: Column) -> DataFrame:
    """How many failures in a row end at each row."""
    own = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    since = df.withColumn("_failed", failed).withColumn("_run", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(own))
    return since.withColumn("streak", F.sum(F.col("_failed").cast("int")).over(W.partitionBy(*by, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).drop("_failed", "_run")


def deactivated(df: DataFrame, by: list[str], at: str, order: list[Column], gone: Column, hours: int = 6) -> DataFrame:
    """Where a document was gone again, `hours` or more after the last time, with nothing but that between.

    Failures do not count, either way: leave them out before.
    """
    own = W.partitionBy(*by).orderBy(at, *order)
    marked = df.withColumn("_gone", gone)
    before = F.when(F.lag("_gone").over(own), F.lag(at).over(own))
    apart = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) >= hours * 3_600_000_000
    return marked.withColumn("deactivated", F.coalesce(F.col("_gone") & apart, F.lit(False))).drop("_gone")


def page_checks(rows: DataFrame, page: str, row: str, content: Column) -> DataFrame:
    """Per page: number of rows, whether its content is that of an earlier page, and whether it brings nothing new."""
    first_seen = F.min(page).over(W.partitionBy("_content"))
    marked = rows.withColumn("_content", content).withColumn("_new", F.col(page) == first_seen)
    pages = marked.groupBy(page).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_new").alias("n_new"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("_content"))), 256).alias("print"))
    same = F.row_number().over(W.partitionBy("print").orderBy(page)) > 1
    return pages.withColumn("repeated", same).withColumn("no_progress", F.col("n_new") == 0).drop("print")


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Every row's place in the order of all (from 1), without bringing them to one task: ranges are sorted side by side, and each goes on where the one before it ends.

    order must tell all rows apart. Cuts lineage with a checkpoint of the sorted rows, whose partitions are then counted: a number for each.
    """
    checkpoint_folder(df.sparkSession)
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).checkpoint()
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.col("_row") - F.shiftleft(F.col("_range").cast("long"), 33)
    return ranges.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + own + 1).drop("_range", "_row", "_before")


def dispatched(due: DataFrame, by: list[str], order: list[Column], tick: str, capacity: int) -> DataFrame:
    """Adds served: the tick at which each row's turn comes, in order, with at most `capacity` rows a tick; what does not fit waits for the next.

    tick: the number of the first tick at which a row may be served, not falling in the given order. A row takes the slot behind the one before it, or the first of
    its own tick: with slots numbered through, that is its place plus the largest lead that any row so far had over its place.
    """
    walk = W.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(walk) - 1
    lead = F.max(F.col(tick) * capacity - F.col("_place")).over(walk.rowsBetween(W.unboundedPreceding, W.currentRow))
    return due.withColumn("_place", place.cast("long")).withColumn("served", F.floor((lead + F.col("_place")) / capacity).cast("long")).drop("_place")
