"""Connected components of a link table, without the links or the labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed


#: Links of a partition: few links stay in few files.
LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """links has columns a, b (longs). Returns node, comp: the least node that each linked node reaches.

    Stars are merged in turn: every node sends its larger neighbours to the least one it knows, then its
    smaller ones, until each leads to one node that leads nowhere; each turn is checkpointed. A node with
    very many neighbours is a group of the aggregates and the large side of a join, which Spark combines early
    and splits.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    parts = -(-max(links.count(), 1) // LINKS)
    edges = checkpointed(edges.coalesce(parts))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node leads to one other, which leads to none."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
