"""Snapshots and state: deltas, upserts, conflicts, latest-wins merges, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, print_: str) -> DataFrame:
    """key and status ADDED, REMOVED, CHANGED or UNCHANGED, from one full outer join."""
    joined = before.select(F.col(key).alias("_b"), F.col(print_).alias("_old")).join(after.select(F.col(key).alias("_a"), F.col(print_).alias("_new")), F.col("_b") == F.col("_a"), "full_outer")
    status = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED").when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED").otherwise("CHANGED")
    return joined.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def upserted(stored: DataFrame, batch: DataFrame, key: str, print_: str, complete: bool = True) -> DataFrame:
    """The table after a batch: all columns of the batch win, first_seen stays, rows that a complete batch lacks become inactive.

    stored and batch have key, print_ and seen (the time of the observation); stored also first_seen, active and quality. A
    changed or returned row goes back to quality RAW, an unchanged one keeps its quality.
    """
    s = stored.select(F.col(key).alias("_s"), F.col(print_).alias("_old"), "first_seen", F.col("active").alias("_active"), F.col("quality").alias("_quality"), F.col("seen").alias("_seen"))
    joined = s.join(batch.select(F.col(key).alias("_k"), F.col(print_).alias("_new"), F.col("seen").alias("_now")), F.col("_s") == F.col("_k"), "full_outer")
    same = F.col("_old").eqNullSafe(F.col("_new")) & F.coalesce("_active", F.lit(False))
    action = F.when(F.col("_s").isNull(), "INSERT").when(F.col("_k").isNull(), "DEACTIVATE" if complete else "KEEP").when(same, "UNCHANGED").otherwise("UPDATE")
    action = F.when(F.col("_k").isNull() & ~F.coalesce("_active", F.lit(False)), "KEEP").otherwise(action)
    return joined.withColumn("action", action).select(
        F.coalesce("_k", "_s").alias(key),
        "action",
        F.coalesce("_new", "_old").alias(print_),
        F.coalesce("first_seen", "_now").alias("first_seen"),
        F.coalesce("_now", "_seen").alias("seen"),
        F.when(F.col("action") == "DEACTIVATE", False).when(F.col("action") == "KEEP", F.col("_active")).otherwise(True).alias("active"),
        F.when(F.col("action").isin("UNCHANGED", "KEEP", "DEACTIVATE"), F.col("_quality")).otherwise("RAW").alias("quality"),
    )


def adopted(candidates: DataFrame, identity: list[str], verified: str, first_seen: str, key: str) -> DataFrame:
    """Of stored rows with one natural identity the one that goes on, verified first, oldest first; the others are superseded."""
    order = W.partitionBy(*identity).orderBy(F.col(verified).desc(), F.col(first_seen).asc_nulls_last(), F.col(key))
    return candidates.withColumn("adopted", F.row_number().over(order) == 1)


def latest_wins(stored: DataFrame, batch: DataFrame, key: list[str], at: str) -> DataFrame:
    """Union of both, the latest row of each key."""
    both = stored.withColumn("_rank", F.lit(0)).unionByName(batch.withColumn("_rank", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col(at).desc(), F.col("_rank").desc()))
    return both.withColumn("_place", place).filter("_place = 1").drop("_place", "_rank")


def inserted(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Union of both, where rows that are there stay."""
    return stored.unionByName(batch.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def replaced(stored: DataFrame, batch: DataFrame, identity: list[str]) -> DataFrame:
    """Facts of the batch in place of all stored ones with the same identity."""
    return stored.join(batch.select(*identity).distinct(), identity, "left_anti").unionByName(batch)


def conflicts(facts: DataFrame, by: list[str], value: str, status: str = "status") -> DataFrame:
    """All facts of a field are CONFLICT if its values differ."""
    own = W.partitionBy(*by)
    differ = F.min(value).over(own) != F.max(value).over(own)
    return facts.withColumn(status, F.when(F.coalesce(differ, F.lit(False)), "CONFLICT").otherwise(F.col(status)))


def guarded_update(stored: DataFrame, commands: DataFrame, key: str, version: str) -> DataFrame:
    """Each command's outcome: APPLIED if its version is the stored one, STALE if not, MISSING without a row."""
    s = stored.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    joined = commands.join(s, F.col(key) == F.col("_key"), "left")
    outcome = F.when(F.col("_key").isNull(), "MISSING").when(F.col(version) == F.col("_version"), "APPLIED").otherwise("STALE")
    return joined.withColumn("outcome", outcome).drop("_key", "_version")


def memoised(wanted: DataFrame, known: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is known for the key, and the rows still to be computed."""
    return wanted.join(known, key), wanted.join(known.select(*key), key, "left_anti")


def watched(now: DataFrame, base: DataFrame, key: str, print_: str, active: Column) -> DataFrame:
    """Whether a watched record changed since its baseline, has none, or is closed."""
    b = base.select(F.col(key).alias("_key"), F.col(print_).alias("_base"))
    joined = now.join(b, F.col(key) == F.col("_key"), "left")
    flag = F.when(~active, "CLOSED").when(F.col("_base").isNull(), "BASELINE_MISSING").when(F.col("_base") != F.col(print_), "CHANGED").otherwise("SAME")
    return joined.withColumn("watch", flag).drop("_key", "_base")
