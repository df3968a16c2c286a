"""Joins whose pairs are dealt evenly, against plain joins."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans import relational
from tessera.queries import QUERIES
from tests.conftest import SF


def _sides(spark):
    rows = spark.range(2000).select((F.col("id") % 400 == 1).alias("rare"), F.when(F.col("id") % 50 != 0, F.lit("x")).alias("g"), "id")
    return rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")


def test_spread_is_the_join(spark):
    """One key has nearly all pairs; each comes once, null keys meet none, and no task has more than a few times its share."""
    left, right = _sides(spark)
    out = joins.spread(left, right, ["rare", "g"], pairs=100_000)
    want = left.join(right, ["rare", "g"])
    assert out.count() == want.count() > 3_800_000 and out.select("a", "b").exceptAll(want.select("a", "b")).isEmpty()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.2 * sum(sizes)
    assert joins.spread(left.limit(0), right, ["rare", "g"]).count() == 0


def test_spread_of_null_rows(spark):
    left, right = _sides(spark)
    nothing = left.filter("g is null")
    assert joins.spread(nothing, right, ["g"]).count() == 0


@pytest.mark.parametrize("name", ["fuzzy_stem_join", "null_safe_identity", "match_cardinality"])
def test_copies(spark, tmp_path, name):
    """Copies of parts with other keys: rows without a code meet by name, and matches are counted by nation, so no step has more rows than come out."""
    rows = [(i, f"name {i % 5} of part", "Brand#1", "PROMO", 7, 1.0) for i in range(1, 601)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"s{i}", i % 25, 7000.0) for i in range(100)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    out = getattr(relational, name)(spark, str(tmp_path))
    if name == "match_cardinality":
        assert {r.targets for r in out.collect()} == {0, 4} and "p_partkey" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    else:
        same = (lambda a, b: a % 5 == b % 5) if name == "fuzzy_stem_join" else (lambda a, b: (a % 3 == 0) == (b % 3 == 0) and (a % 3 > 0 or a % 5 == b % 5))
        want = {(a, b) for a in range(1, 601) for b in range(a + 1, 601) if same(a, b)}
        got = [(r[0], r[1]) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_postings_are_dealt(spark):
    """The texts of postings are read, and decided on, in as many tasks as an exchange has, though their keys are one split of a file."""
    sizes = [r["count"] for r in QUERIES["explanations"](spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 0.4 * sum(sizes)
