"""Next runs of many moments: schedules are read once a day that they are asked for, whatever is null."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.cron import with_next_run


def test_days_are_looked_for_once(spark):
    rows = [("0 0 12 29 2 *", "UTC", datetime(2023, 3, 1, i // 60, i % 60)) for i in range(600)] + [(None, "UTC", datetime(2023, 3, 1)), ("nonsense", "UTC", datetime(2023, 3, 1)), ("0 0 0 * * *", "UTC", None)]
    df = spark.createDataFrame(rows, "c string, z string, t timestamp_ntz")
    out = with_next_run(df, "t", "c", "z", "due")
    got = [r.due for r in out.collect()]
    assert len(got) == len(rows) and got.count(datetime(2024, 2, 29, 12)) == 600 and got.count(None) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the long look ahead stands above the distinct days only
    assert out.columns == [*df.columns, "due"] and "Aggregate" in plan
    assert with_next_run(df.withColumn("due", F.lit(1)), "t", "c", "z", "due").columns == out.columns
