"""Aggregates: zero-filled counts, worst status, scores with coverage, evidence folds, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses by severity, mildest first.
SEVERITY = ("ELIGIBLE", "CONDITIONAL", "NEEDS_CONFIRMATION", "CONFLICTING_EVIDENCE", "INELIGIBLE")


def counts_of(df: DataFrame, column: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows by value, with a column for each named value whether it occurs or not, and the total."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == v).alias(f"n_{v.lower().replace(' ', '_').replace('-', '_')}") for v in values))


def severity(status: Column) -> Column:
    """0 for the mildest."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITY):
        out = F.when(status == name, i).otherwise(out)
    return out


def worst(*statuses: Column) -> Column:
    """The most severe of several statuses; nulls do not count."""
    return F.get(F.array(*map(F.lit, SEVERITY)), F.greatest(*map(severity, statuses)) if len(statuses) > 1 else severity(statuses[0]))


def worst_of_group(status: Column) -> Column:
    """The most severe status of a group."""
    return F.get(F.array(*map(F.lit, SEVERITY)), F.max(severity(status)))


def scored(points: list[Column], most: list[int]) -> tuple[Column, Column]:
    """Score, and coverage in percent: a dimension whose points are null earns nothing and is not covered."""
    score, known = F.lit(0), F.lit(0)
    for p, m in zip(points, most, strict=True):
        score = score + F.coalesce(p, F.lit(0))
        known = known + F.when(p.isNotNull(), m).otherwise(0)
    return score, F.floor(known * 100 / sum(most) + 0.5).cast("long")


def evidence_strength(coverage: Column, n: Column) -> Column:
    """STRONG, MODERATE, LIMITED, WEAK by share of complete evidence and number of records."""
    return F.when((coverage >= 60) & (n >= 20), "STRONG").when((coverage >= 60) & (n >= 5), "MODERATE").when(n >= 3, "LIMITED").otherwise("WEAK")


def folded_evidence(facts: DataFrame, by: list[str], field: str, status: str, statuses: list[str]) -> DataFrame:
    """Per record the sorted fields of each status, as text."""
    return facts.groupBy(*by).agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) == s, F.col(field)))), ",").alias(f"{s.lower()}_fields") for s in statuses))


def lineages(df: DataFrame, by: list[str], year: str, row: str) -> DataFrame:
    """Per key: sorted years, number of rows, the latest row (smallest id on a tie), and whether the years are contiguous."""
    span = df.agg(F.min(year).alias("window_start"), F.max(year).alias("window_end"))
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_set(year)).alias("years"), F.count(F.lit(1)).alias("n_rows"), F.min(F.struct((-F.col(year)).alias("y"), F.col(row).alias("r"))).alias("latest"))
    first, last = F.get("years", F.lit(0)), F.element_at("years", -1)
    grouped = grouped.withColumn("representative", F.col("latest.r")).withColumn("contiguous", F.size("years") == last - first + 1).withColumn("last_year", last)
    return grouped.drop("latest").crossJoin(F.broadcast(span))


def recurrence(years: Column, contiguous: Column, start: Column, end: Column, least: int = 2) -> Column:
    """What the observed years of a lineage say about another occurrence."""
    return F.when(end - start + 1 < least, "INSUFFICIENT_HISTORY").when(F.size(years) == 1, "SINGLE_OCCURRENCE").when(contiguous, "RECURRING_ANNUAL").otherwise("INTERMITTENT")


def every_year(df: DataFrame, start: int, end: int, year: str, measures: list[Column]) -> DataFrame:
    """Measures per year, with rows for years that have none."""
    years = df.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(df.groupBy(F.col(year).alias("year")).agg(*measures), "year", "left")


def affected_by_key(df: DataFrame, row: str, keys: Column) -> DataFrame:
    """For each key of an array column, how many distinct rows have it."""
    return df.select(row, F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.countDistinct(row).alias("affected"))


def share_of_group(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Each row's share of its group's total in whole percent, rounded down."""
    return df.withColumn("share", F.floor(100 * F.col(amount) / F.sum(amount).over(W.partitionBy(*by))).cast("long"))
