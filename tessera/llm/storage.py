"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tessera.session import checkpoint_folder

#: What the innermost open scratch block of a thread has made: folders, and names of tables.
_OPEN: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share."""
    return checkpoint_folder(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if made := _OPEN.get():
        made[0].append(path)
    return path


def noted_table(name: str) -> None:
    """Tells the open scratch block of a table in the catalog."""
    if made := _OPEN.get():
        made[1].append(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables and folders that operators made in it, in this thread. What they return must be written by then, to a folder made outside."""
    made: tuple[list[str], list[str]] = ([], [])
    before = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for table in made[1]:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for folder in made[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own setting: the shuffle files of a query go when it ends.
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that begins in it go at that query's end, not when the driver next happens to collect its garbage. A result that is read more than once belongs outside."""
    before = spark.conf.get(DROPS, None)
    spark.conf.set(DROPS, "true")
    try:
        yield
    finally:
        spark.conf.set(DROPS, before) if before else spark.conf.unset(DROPS)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; for tables of a few columns, as it keeps their partitioning."""
    context = df.sparkSession.sparkContext
    where = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint()


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder (or path) and reads it back: lineage ends here, and a lost executor costs nothing before."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
