"""Pairs by the index against all pairs; places of all rows."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.operators.windows import placed
from tessera.plans import matching
from tessera.plans.postings import candidates, decided, evaluated, postings


def test_open_pairs_lose_nothing(spark):
    """Of the given candidates every decision that is not an exclusion, once each; and fewer pairs than all."""
    pairs = matching.open_pairs(postings(spark, SF), candidates(spark), block=2)
    columns = ["candidate", "p_partkey", "status", "fit", "stability", "coverage", "tier", "advised"]
    got = decided(pairs).filter("status <> 'INELIGIBLE'").select(columns).collect()
    want = evaluated(spark, SF).filter("status <> 'INELIGIBLE'").select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    assert pairs.count() < 0.8 * evaluated(spark, SF).count()


def test_no_side_is_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching.open_pairs(postings(spark, SF), matching.people(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_placed(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    out = placed(df, [F.desc("a"), F.col("b").asc()], "place").collect()
    assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r.place for r in sorted(out, key=lambda r: r.place)] == [*range(1, 1001)]
    assert placed(df.limit(0), [F.desc("a")], "place").count() == 0
