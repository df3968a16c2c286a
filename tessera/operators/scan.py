"""Finding rows: by equality, by order, by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finder(df: DataFrame, equal: dict[str, object] | None = None, where: list[Column] | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows with the given values (null matches null) and conditions, in order; every part may be left out."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    for condition in where or []:
        df = df.filter(condition)
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit is not None else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as an exchange has: where rows are narrow and each is much work, a split of the file, cut by its bytes, is too much for one task.

    The number is given, so that tasks are not put together again by the few bytes that they read.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keyset_page(df: DataFrame, at: str, key: str, cursor: tuple[object, object] | None, size: int) -> DataFrame:
    """The page after a cursor (time, key), with a row more than its size if there is a next page."""
    if cursor is not None:
        when, last = F.lit(cursor[0]), F.lit(cursor[1])
        df = df.filter((F.col(at) > when) | ((F.col(at) == when) & (F.col(key) > last)))
    return df.orderBy(at, key).limit(size + 1)


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a numbered page, from 0, with the number of all rows as `total`."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(page * size).limit(size).crossJoin(F.broadcast(total))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before it shuffles."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def within_budget(df: DataFrame, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """Per group, how many rows a budget covers and how many stay unassessed: partial results say so."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).groupBy(*by).agg(F.count_if(F.col("place") <= budget).alias("assessed"), F.count_if(F.col("place") > budget).alias("not_assessed"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, one for each check they break; parquet tables do not enforce any."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return df.withColumn("broken", F.explode(broken))
