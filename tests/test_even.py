"""Steps whose tasks stay small: rows without a key, few keys, numbers in place of texts, parts of documents."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.operators import joins
from tessera.plans import planning, ranking
from tessera.plans.registry import QUERIES
from tessera.sources import documents


def test_rows_without_a_key_stay_apart(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 100).alias("k"))
    right = spark.range(0, 80, 2).select(F.col("id").alias("other"), (F.col("id") * 10).alias("value"))
    out = joins.where_known(left, right, "k", "other")
    want = left.join(right, F.col("k") == F.col("other"), "left")
    assert out.columns == want.columns and sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    spread = joins.where_known(left.repartition(4), right, "k", "other").filter("k is null").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 1000


def test_years_of_work_go_to_the_postings(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planning.projected(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sides_are_folded_in_place(spark):
    for name in ("affected_postings", "decision_diff_summary"):
        assert "SortAggregate" not in ranking._sides(spark, SF, rules=ranking._rules())._jdf.queryExecution().executedPlan().toString(), name
    assert "SortAggregate" not in QUERIES["decision_diff_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_parts_go_out_a_few_at_once(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "".join(f"<p>text {i} {j}</p>" for j in range(i))) for i in range(12)], "id int, html string").coalesce(1)
    whole = documents.html_fragments(pages, "id", "html").collect()
    monkeypatch.setattr(documents, "PARTS_AT_ONCE", 4)
    few = documents.html_fragments(pages, "id", "html")
    assert few.collect() == whole and len(whole) == sum(range(12))
