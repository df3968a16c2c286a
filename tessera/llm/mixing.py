"""Mixing sources to target weights by Sainte-Laguë apportionment.

The corpus is seen as blocks of an equal number of tokens. Each source gets an integer number of blocks by
highest quotients (target / (2 * blocks so far + 1)), its blocks go to its shards by the same rule, and a
seeded order picks the blocks inside each shard. Everything is DataFrame work; only counts per source and
per shard are ever sorted together, and a hot source is split into as many shards as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed

#: The weights that sources get in the order of their names, again and again.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit(""))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Tokens that each source should give: the whole size shared by weight, but at most `most` times a source's own.

    sizes has a row per source: source, source_size. With the sources in the order of most * size / weight,
    those that stop at their limit come first; the rest share what is left by weight, at the first place
    where that leaves the next source under its limit. Adds weight, target.
    """
    names = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(names) - 1) % len(weights)
    limits = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = limits.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
        .withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def apportion(parts: DataFrame, by: list[str], share: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Sainte-Laguë: whole numbers in proportion to `share` that add up to `seats` in each group of `by`.

    Below the divisor that would give every seat, each part has floor(share / divisor + 1/2) seats for
    certain; at most about as many seats as there are parts remain, and those go to the highest quotients
    share / (2 * seats so far + 1), ties in the given order. So the rows that are sorted are about as many
    as the parts, however many seats there are.
    """
    group = W.partitionBy(*by)
    count, total = F.count(F.lit(1)).over(group), F.sum(share).over(group)
    parts = parts.withColumn("_n", count).withColumn("_total", total)
    sure = F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0.0))
    part = F.when(F.col("_total") > 0, F.col(share) / F.col("_total")).otherwise(0.0)
    parts = parts.withColumn("_part", part).withColumn("_sure", F.floor(F.col("_part") * sure + F.when(sure > 0, F.lit(0.5)).otherwise(0.0)).cast("long"))
    parts = parts.withColumn("_left", F.when(F.col("_total") > 0, F.col(seats) - F.sum("_sure").over(group)).otherwise(0))
    tries = F.least(F.col("_left"), F.ceil(F.col("_part") * (2.5 * F.col("_n") + 4)) + 2).cast("int")
    claims = parts.withColumn("_k", F.explode(F.when((tries > 0) & (F.col("_part") > 0), F.sequence(F.lit(1), tries)).otherwise(F.array(F.lit(0)))))
    quotient = F.when(F.col("_k") > 0, F.col("_part") / (2 * (F.col("_sure") + F.col("_k")) - 1)).otherwise(F.lit(-1.0))
    rank = F.row_number().over(group.orderBy(F.desc("_quotient"), *order, "_k"))
    won = (F.col("_k") > 0) & (rank <= F.col("_left"))
    claims = claims.withColumn("_quotient", quotient).withColumn("_won", won)
    keys = [c for c in parts.columns if not c.startswith("_")]
    return claims.groupBy(*keys).agg((F.max("_sure") + F.count_if("_won")).alias(out))


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 32, shard_tokens: int = 2_000_000, seed: int = 17) -> DataFrame:
    """How many tokens of each document a mix at the target weights takes.

    Returns per row of docs: id_col, source (null is a source of its own, the last), size (words of the
    text; 0 if null or empty), source_size, target (of the source), taken (words that the mix takes,
    repeats counted; 0 to most * size). A shard's documents stand in a seeded order and are cut into blocks
    of `block` tokens, the last one shorter; a quota above the shard's blocks takes all of them once more.
    A rerun takes the same: all order comes from hashes of the seed and the rows. Repeated rows count as
    documents of their own; a null id is allowed; other columns, whatever their names, are not looked at.
    Cuts lineage with one checkpoint of the sizes, so the texts are read once.
    """
    rows = _mixed(docs, id_col, text_col, source_col, weights, most, block, shard_tokens, seed)
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 32, shard_tokens: int = 2_000_000, seed: int = 17) -> DataFrame:
    """The mix itself, of whole documents: rows of docs, unchanged, each as often as mix_sources takes its size.

    What a document is taken beyond whole times becomes one time more with that probability, by a seeded hash of the row.
    Rows that agree in id and text share what they are taken; a document without words is not in the mix.
    """
    rows = _mixed(docs, id_col, text_col, source_col, weights, most, block, shard_tokens, seed)
    each = rows.filter("taken > 0").groupBy("id", "draw").agg((F.sum("taken") / F.sum("size")).alias("times"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(1 << 20)) / (1 << 20)
    each = each.select(F.col("id"), "draw", F.floor(F.col("times") + chance).cast("int").alias("times")).filter("times > 0")
    # the documents are one column, so that none of theirs can clash with those here
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").alias("own"), _draw(id_col, text_col, seed).alias("draw"))
    drawn = packed.join(each, "draw").filter(F.col("own").eqNullSafe(F.col("id")))
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, block: int, shard_tokens: int, seed: int) -> DataFrame:
    """id, draw, source, size, source_size, target and taken for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _draw(id_col, text_col, seed).alias("draw"), word_count(F.col(text_col)).alias("size"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))

    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    name = F.col("source").asc_nulls_last()
    blocks = F.floor(F.sum("target").over(W.partitionBy()) / block + 0.5).cast("long")
    sources = apportion(sources.withColumn("blocks", blocks), [], "target", "blocks", [name], "quota")
    sources = sources.withColumn("src", F.row_number().over(W.orderBy(name))).withColumn("n_shards", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("long"))
    sources = checkpointed(sources.select("src", F.col("source").alias("name"), "source_size", "target", "quota", "n_shards"))

    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("n_shards")))
    shards = rows.groupBy("src", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["src"], "shard_size", "quota", [F.col("shard")], "take")
    n_blocks = F.ceil(F.col("shard_size") / block)
    shards = shards.select("src", "shard", n_blocks.alias("n_blocks"), F.least(F.col("take"), most * n_blocks).alias("take"))

    stream = W.partitionBy("src", "shard").orderBy("draw", "row")
    placed = rows.filter("size > 0").withColumn("begin", F.sum("size").over(stream) - F.col("size"))
    last = F.col("begin") + F.col("size") - 1
    placed = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor(last / block))))
    tokens = F.least(last + 1, (F.col("piece") + 1) * block) - F.greatest(F.col("begin"), F.col("piece") * block)
    pieces = placed.select("row", "src", "shard", "piece", tokens.alias("tokens"))
    drawn = W.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed), "src", "shard", "piece"), "piece")
    rank = F.dense_rank().over(drawn) - 1
    times = F.floor(F.col("take") / F.col("n_blocks")) + F.when(F.col("rank") < F.col("take") % F.col("n_blocks"), 1).otherwise(0)
    taken = pieces.withColumn("rank", rank).join(shards, ["src", "shard"]).groupBy("row").agg(F.sum(F.col("tokens") * times).alias("got"))
    out = rows.select("row", "id", "draw", "source", "size", "source_size", "target").join(taken, "row", "left")
    return out.withColumn("taken", F.coalesce("got", F.lit(0)).cast("long")).drop("row", "got")
