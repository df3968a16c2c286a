"""Texts dealt once to chunks, for operators that come back to them several times.

A chunk is about a megabyte of texts that one Python call works on. The chunks lie in a table of the
shared folder that is bucketed by chunk, so a step that brings notes to the chunks moves the notes alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import new_folder, noted_table

#: Bytes of text in a chunk and in a bucket of the table.
CHUNK, BUCKET = 1 << 20, 16 << 20
NOTES = "chunk long, kind string, key long, data binary"


@dataclass
class Chunks:
    """table: chunk, row (unique), words (the text), doc (a struct of what is carried); n_buckets: of the table, and good for exchanges."""

    table: DataFrame
    n_buckets: int

    def none(self) -> DataFrame:
        """No notes."""
        return self.table.sparkSession.createDataFrame([], NOTES)

    def over(self, columns: list[str], notes: DataFrame, run: Callable[[pa.Table, dict[str, dict[int, bytes]]], pa.Table], schema) -> DataFrame:
        """run(rows, notes) for each chunk; notes: by kind and key. The texts stay where they are."""

        def both(rows: pa.Table, notes: pa.Table) -> pa.Table:
            by: dict[str, dict[int, bytes]] = {}
            for kind, key, data in zip(*(notes.column(c).to_pylist() for c in ("kind", "key", "data")), strict=True):
                by.setdefault(kind, {})[key] = data
            return run(rows, by)

        return self.table.select("chunk", *columns).groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(both, schema)


def chunked(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> Chunks:
    """Deals docs to chunks by a hash of id, text and input partition; carry: the columns to keep besides the text.

    Repeated rows of one partition share a chunk, those of others do not: no chunk holds more of them than a partition has.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    n_chunks = max(n_buckets, -(-size // CHUNK))
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(n_chunks))
    rows = docs.select(chunk.alias("chunk"), F.col(text_col).cast("string").alias("words"), F.struct(*carry).alias("doc"))
    rows = rows.repartition(n_buckets, "chunk").withColumn("row", F.monotonically_increasing_id())
    name = f"tessera_chunks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", new_folder(spark, "chunks")).option("compression", "zstd").bucketBy(n_buckets, "chunk").saveAsTable(name)
    noted_table(name)
    return Chunks(spark.table(name), n_buckets)
