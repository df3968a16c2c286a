"""Joins beyond one equality: on either of two keys, the latest match, fuzzy containment, by cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], row: list[str]) -> DataFrame:
    """Pairs that agree in any of the key pairs, once each: a union of equi joins in place of a nested loop.

    row: columns that tell a pair from others.
    """
    parts = [left.join(right, left[a] == right[b]) for a, b in keys]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(row)


def latest_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], row: str, order: list[Column]) -> DataFrame:
    """For each row of left the first match in order, over several possible keys; rows without one stay.

    The lateral top-1 with OR becomes equi joins and a row number, which hash and shuffle by key.
    """
    parts = [left.select(row, *(a for a, _ in keys)).join(right, F.col(a) == F.col(b)).withColumn("by_key", F.lit(i)) for i, (a, b) in enumerate(keys)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    first = found.withColumn("place", F.row_number().over(W.partitionBy(row).orderBy(*order, "by_key"))).filter("place = 1")
    return left.join(first.drop("place", *(a for a, _ in keys)), row, "left")


def exchanged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The join with both sides dealt by key. For sides that grow with the input though they come from few bytes: Spark guesses from a file's bytes, and would send the rows that are made of them through the driver to all tasks."""
    return left.join(right.hint("merge"), on, how)


def having(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left that right has a match for."""
    return left.join(right.select(*on), on, "left_semi")


def where_known(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """The left join on key = other; rows without a key, which have no match, do not meet in one task but stay where they are."""
    known = left.filter(F.col(key).isNotNull()).join(right, F.col(key) == F.col(other), "left")
    unknown = left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
    return known.unionByName(unknown)


def lacking(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left that right has no match for."""
    return left.join(right.select(*on), on, "left_anti")


def spread(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = 1 << 22) -> DataFrame:
    """The inner join on keys of the same name, its pairs dealt evenly: about `pairs` to a task, however few rows make them.

    A key with more pairs is cut into blocks: the right side's rows are dealt to them, and the left side's go to each. Sizes of keys are counted first.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = size(left, "_left").join(size(right, "_right"), keys).withColumn("_pairs", F.col("_left").cast("double") * F.col("_right"))
    total = sizes.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // pairs) + 1)
    # no key has more blocks than rows to deal
    large = sizes.filter(F.col("_pairs") > pairs).select(*keys, F.least(F.ceil(F.col("_pairs") / pairs), F.col("_right")).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    ours = left.join(large, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    theirs = right.join(large, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*right.columns), blocks).cast("int")).drop("_blocks")
    dealt = [*keys, "_block"]
    return ours.repartition(tasks, *dealt).join(theirs.repartition(tasks, *dealt), dealt).drop("_block")


def _grams(stems: DataFrame, block: list[str], width: int) -> DataFrame:
    """block, stem, gram: the distinct runs of `width` characters of each stem."""
    starts = F.sequence(F.lit(1), F.length("stem") - width + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring("stem", i, F.lit(width))))
    return stems.filter(F.length("stem") >= width).select(*block, "stem", F.explode(grams).alias("gram"))


def contained_candidates(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: int, ratio: float) -> DataFrame:
    """block, a, b: stems of which one may hold the other: of like length, and the longer has the shorter's rarest run of characters.

    What is in a stem has all its runs in it, so one run is enough to look for, and the rarest of the block meets the fewest.
    """
    sides = [df.select(*block, F.col(c).alias("stem")).distinct() for df, c in ((left, a), (right, b))]
    grams = [_grams(s, block, least) for s in sides]
    counts = grams[0].unionByName(grams[1]).groupBy(*block, "gram").count()
    out = None
    for short, long_, names in ((0, 1, (a, b)), (1, 0, (b, a))):
        rarest = F.min(F.struct("count", "gram"))["gram"]
        keys = grams[short].join(counts, [*block, "gram"]).groupBy(*block, "stem").agg(rarest.alias("gram"))
        met = keys.withColumnRenamed("stem", "_short").join(grams[long_].withColumnRenamed("stem", "_long"), [*block, "gram"])
        near = (F.length("_short") < F.length("_long")) & (F.length("_short") >= ratio * F.length("_long"))
        part = met.filter(near).select(*block, F.col("_short").alias(names[0]), F.col("_long").alias(names[1]))
        out = part if out is None else out.unionByName(part)
    return out


def similar_stems(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: int = 12, ratio: float = 0.75) -> DataFrame:
    """Pairs of a block whose stems are equal, or where the shorter, of `least` characters or more, is in the longer and nearly as long.

    Equal stems meet by an equality; others by contained_candidates, as distinct stems, before their rows are joined to them; rows that share a stem are many pairs, so these are dealt evenly. A null stem meets none.
    """
    pairs = contained_candidates(left, right, block, a, b, least, ratio)
    pairs = pairs.filter(F.when(F.length(a) < F.length(b), F.contains(F.col(b), F.col(a))).otherwise(F.contains(F.col(a), F.col(b))))
    equal = spread(left, right.withColumn(a, F.col(b)), [*block, a])
    unlike = spread(left.join(pairs, [*block, a]), right, [*block, b])
    return equal.unionByName(unlike)


def resolved(left: DataFrame, matches: DataFrame, key: str, target: str) -> DataFrame:
    """MATCHED with the target if a key has one distinct target, UNMATCHED if none, AMBIGUOUS if several."""
    n = matches.groupBy(key).agg(F.countDistinct(target).alias("targets"), F.min(target).alias(target))
    status = F.when(F.coalesce(F.col("targets"), F.lit(0)) == 0, "UNMATCHED").when(F.col("targets") == 1, "MATCHED").otherwise("AMBIGUOUS")
    return left.join(n, key, "left").withColumn("status", status).withColumn(target, F.when(F.col("targets") == 1, F.col(target))).withColumn("targets", F.coalesce("targets", F.lit(0)))


def overlaid(own: DataFrame, other: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Rows of own; where other has one for the key, its values come first unless they are null."""
    names = {c: f"_{c}" for c in columns}
    joined = own.join(other.select(on, *(F.col(c).alias(n) for c, n in names.items())), on, "left")
    return joined.withColumns({c: F.coalesce(n, c) for c, n in names.items()}).drop(*names.values())


def in_ranges(cells: DataFrame, ranges: DataFrame, at: str, low: str, high: str, on: list[str], step: int = 64) -> DataFrame:
    """Cells with the ranges that hold them: ranges go to every stretch of `step` they reach, so the join is an equality, its pairs dealt evenly."""
    reached = ranges.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    return spread(reached, cells.withColumn("_stretch", F.floor(F.col(at) / step)), [*on, "_stretch"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_stretch")
