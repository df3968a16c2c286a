"""Source divergence audit: how a source's words differ from its language's, and from those of other sources.

Words are counted in the input's partitions and meet once, by language and term. All that follows is sparse: a term
that a group lacks has the group's baseline p0, so of a pair of groups only the terms that either has are looked at.

    sum |p - q| = V * |p0 - q0| + (own terms of one group) + (own terms of the other) + (terms of both)

where each part is the excess over the baseline: a group's own terms need only the counts of its distinct p, which a
running sum compares with every other group's q0; for a term that both have, blocks of terms add up the rest pair by
pair. The top terms of a group come by radix select: histograms over the bits of the value, from the highest digit
down, give each group's kth value, and ties at it are told apart by histograms over the bytes of the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed, kept
from tessera.llm.words import Words, counted, slices

#: Bytes inside a term of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, before A-Z are lower-cased.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Bytes of text that are counted at once, and rows of counts that a task gathers before it hands them on.
TEXTS, GATHERED = 2 << 20, 1 << 19
#: Rows of a block of terms, and pairs of groups that are looked at together.
BLOCK, PAIRS = 1 << 13, 1 << 18
#: Groups whose rows may go to all tasks, at most.
GROUPS = 20_000
TALLY = "lang string, source string, term string, docs long, n long"


def _bytes_at(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def term_ids(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words only, and the first word with each number. Hashes propose; bytes decide."""
    order = np.argsort(hashes, kind="stable")
    at, n = counted(hashes[order])
    ids = np.empty(len(hashes), np.int64)
    ids[order] = np.repeat(np.arange(len(at)), n)
    first, lengths = order[at], w.end - w.start
    heads = first[ids]
    if np.array_equal(lengths, lengths[heads]) and np.array_equal(w.data[_bytes_at(w.start, lengths)], w.data[_bytes_at(w.start[heads], lengths)]):
        return ids, first
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w.word(i), len(numbers)) for i in range(len(w))], np.int64)
    return ids, np.unique(ids, return_index=True)[1]


def tally(part: pa.RecordBatch) -> pa.RecordBatch:
    """How often each group's texts hold each term (n), and how many of them hold it (docs)."""
    w = Words(part.column("text"), LETTERS, lower=True)
    names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
    group = np.asarray(names[0].indices, np.int64) * max(1, len(names[1].dictionary)) + np.asarray(names[1].indices, np.int64)
    ids, first = term_ids(w, w.hashes())
    texts = w.text_of
    key = np.sort((group[texts] * max(1, len(first)) + ids) * max(1, part.num_rows) + texts)
    at, n = counted(key)  # a row for each text and term
    pair = key[at] // max(1, part.num_rows)
    rows, docs = counted(pair)
    group, ids = np.divmod(pair[rows], max(1, len(first)))
    n = np.add.reduceat(n, rows) if len(rows) else n
    begin, lengths = w.start[first[ids]], (w.end - w.start)[first[ids]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(w.data[_bytes_at(begin, lengths)].tobytes())).cast(pa.string())
    lang, source = np.divmod(group, max(1, len(names[1].dictionary)))
    return pa.RecordBatch.from_arrays([names[0].dictionary.take(pa.array(lang)), names[1].dictionary.take(pa.array(source)), terms, pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["lang", "source", "term", "docs", "n"])


def _gathered(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(parts).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
    return table.rename_columns(["lang", "source", "term", "docs", "n"]).to_batches()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        for part in slices(batch, "text", TEXTS):
            parts.append(tally(part))
            rows += parts[-1].num_rows
            if rows >= GATHERED:
                yield from _gathered(parts)
                parts, rows = [], 0
    if rows:
        yield from _gathered(parts)


def _share(count: Column, total: Column, terms: Column, prior: int, unit: int) -> Column:
    """1 + floor(unit * (count + prior) / (total + prior * terms)), in whole numbers; null without terms."""
    wide = lambda x: x.cast("decimal(20,0)")
    floor = F.call_function("div", wide(count + prior) * F.lit(unit).cast("decimal(10,0)"), wide(total + prior * terms))
    return F.when(terms > 0, 1 + floor)


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, k: int, bits: int = 30, width: int = 10, few: int = 64, hint: str = "merge") -> DataFrame:
    """Rows of each group with its k largest values, ties by the UTF-8 bytes of item, ascending; adds rank (int, from 1).

    value: whole numbers from 0 to 2 ** bits - 1; item: distinct in a group. No group is sorted: a pass counts, for
    each group, the rows of each digit of the value among those with the kth value's higher digits. Ties at the kth value
    are narrowed in the same way, two bytes a pass, until at most `few` of a group's are left open. hint: how what is
    known of each group joins the rows; "broadcast" is for few groups.
    """
    at, mask = F.col(value), (1 << width) - 1
    bytes_ = F.col(item).cast("binary")

    def crossing(counts: DataFrame, key: Column) -> DataFrame:
        """Of each group the key at which the rows so far reach what is wanted."""
        so_far = F.sum("count").over(W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow))
        seen = counts.withColumn("_to", so_far).filter((F.col("_to") >= F.col("_wanted")) & (F.col("_to") - F.col("count") < F.col("_wanted")))
        return seen.withColumn("_wanted", F.col("_wanted") - F.col("_to") + F.col("count"))

    state = None
    for shift in range(bits - width, -1, -width):
        digit = F.shiftright(at, shift).bitwiseAND(mask).alias("_digit")
        if state is None:
            counts = rows.groupBy(*by, digit).count().withColumns({"_wanted": F.lit(k), "_head": F.lit(0).cast("long")})
        else:
            open_rows = rows.join(state.hint(hint), by).filter(F.shiftright(at, shift + width) == F.col("_head"))
            counts = open_rows.groupBy(*by, "_wanted", "_head", digit).count()
        found = crossing(counts, F.col("_digit").desc())
        state = checkpointed(found.select(*by, (F.shiftleft("_head", width) + F.col("_digit")).alias("_head"), "_wanted", "count"))
        last, state = state, state.drop("count")
    # groups with fewer than k rows have no threshold; they are whole
    ties = last.select(*by, "_head", "_wanted", F.col("count").alias("_open"), F.lit(b"").alias("_prefix"))
    place = 1
    while not ties.filter(F.col("_open") > few).isEmpty():
        wide = rows.join(ties.filter(F.col("_open") > few).drop("_open").hint(hint), by).filter((at == F.col("_head")) & (F.substring(bytes_, 1, place - 1) == F.col("_prefix")))
        counts = wide.groupBy(*by, "_head", "_wanted", "_prefix", F.substring(bytes_, place, 2).alias("_bytes")).count()
        found = crossing(counts, F.col("_bytes").asc()).select(*by, "_head", "_wanted", F.col("count").alias("_open"), F.concat("_prefix", "_bytes").alias("_prefix"))
        ties = checkpointed(ties.filter(F.col("_open") <= few).unionByName(found))
        place += 2
    near = F.expr(f"substring(cast(`{item}` as binary), 1, length(_prefix))") <= F.col("_prefix")
    chosen = rows.join(ties.hint(hint), by, "left").filter(F.col("_head").isNull() | (at > F.col("_head")) | ((at == F.col("_head")) & near))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(at.desc(), F.col(item).asc()))
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= k).select(*rows.columns, "rank")


def _corrections(table: pa.Table) -> pa.Table:
    """Of a block of terms, for each pair of sources, what the terms that both have add to the sparse sums."""
    lang, source = table.column("lang")[:1], table.column("source").combine_chunks().dictionary_encode()
    term, who = np.asarray(table.column("term").combine_chunks().dictionary_encode().indices, np.int64), np.asarray(source.indices, np.int64)
    # sources by name, so that a pair's first is its smaller one
    names = source.dictionary.to_pylist()
    turn = np.empty(len(names), np.int64)
    turn[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
    order = np.lexsort((turn[who], term))
    term, who, p, base = term[order], who[order], table.column("p").to_numpy()[order], table.column("p0").to_numpy()[order]
    at, n = counted(term)
    after = np.repeat(at + n, n) - np.arange(len(term)) - 1  # later rows of the same term
    ends, keys, values = np.cumsum(after), np.empty(0, np.int64), np.empty(0, np.int64)
    begin = 0
    while begin < len(term):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        a = np.repeat(np.arange(begin, end), after[begin:end])
        b = _bytes_at(np.arange(begin, end) + 1, after[begin:end])
        fix = np.abs(p[a] - p[b]) - np.abs(p[a] - base[b]) - np.abs(base[a] - p[b]) + np.abs(base[a] - base[b])
        key, value = np.concatenate([keys, who[a] * len(names) + who[b]]), np.concatenate([values, fix])
        turn_ = np.argsort(key, kind="stable")
        heads, _ = counted(key[turn_])
        keys, values = key[turn_][heads], np.add.reduceat(value[turn_], heads) if len(heads) else value
        begin = end
    one, two = np.divmod(keys, len(names))
    return pa.table({"lang": pa.chunked_array([pa.repeat(lang[0], len(keys))]), "a": source.dictionary.take(pa.array(one)), "b": source.dictionary.take(pa.array(two)), "part": pa.array(values, pa.int64())})


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, prior: int = 5, unit: int = 10**9, top: int = 50, few: int = 64) -> DataFrame:
    """How each (language, source) group differs from the other sources of the language, and in which terms from all of it.

    A language keeps the terms that at least `least` of its rows hold; a group, or a whole language, gives a term
    p = 1 + floor(unit * (count + prior) / (N + prior * V)), with N all its counts and V the kept terms. Returns lang, source, part,
    item, value, rank: part "pair" has a row for each other source (item) of the language, value the sum of |p - q| over
    the kept terms (0 without any); part "term" has the group's terms above the language's q by p - q, the `top` first.
    Ranks are by value, descending, then by the item's UTF-8 bytes. Null texts, languages and sources count as '';
    repeated rows count each; an empty table gives no rows; other columns, whatever their names, are not looked at. `unit` is at most 2 ** 30 - 2.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    place = W.partitionBy("lang", "term")
    # dealt by language and term, so that sums of groups and of languages need no other exchange
    counts = rows.mapInArrow(_tallied, TALLY).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = counts.withColumns({"held": F.sum("docs").over(place), "lang_n": F.sum("n").over(place), "turn": F.row_number().over(place.orderBy("source"))})
    terms = kept(counts.filter(F.col("held") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("turn") == 1).alias("first")), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v")))
    groups = checkpointed(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"), prior, unit)))

    # the terms' files are packed so well that Spark takes them for a small table, which they are not when read: it is told which side is small
    hint = "broadcast" if groups.count() <= GROUPS else "merge"
    known = terms.join(groups.hint(hint), ["lang", "source"])
    p, q = (_share(F.col(c), F.col(t), F.col("v"), prior, unit) for c, t in (("n", "total"), ("lang_n", "lang_total")))
    above = known.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    best = radix_top(above, ["lang", "source"], "value", "item", top, few=few, hint=hint)

    shares = known.select("lang", "source", "term", p.alias("p"), "p0")
    pairs = pair_sums(groups, shares, terms.count())
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.*", "value").withColumn("rank", rank)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(best, "term"))


def pair_sums(groups: DataFrame, shares: DataFrame, n_rows: int, block: int = BLOCK) -> DataFrame:
    """lang, a, b (a < b), value: sum of |p - q| over the language's terms. groups: lang, source, v, p0; shares: n_rows rows lang, source, term, p, p0 of the terms that a group has."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # as many rows as the result has
    ordered = groups.repartition("lang", "source").join(other, "lang").filter(F.col("source") != F.col("item"))
    a, b = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    flat = F.coalesce(F.col("v") * F.abs(F.col("p0") - F.col("q0")), F.lit(0))
    baseline = ordered.filter(F.col("source") < F.col("item")).select("lang", a, b, flat.alias("part"))

    # a group's own terms: how many have which p, against the other groups' q0, by one running sum
    steps = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("c"))
    line = steps.select("lang", "source", "p0", F.col("p").alias("at"), "c", (F.col("c") * F.col("p")).alias("s"), F.lit(None).cast("string").alias("item"))
    asks = ordered.filter("v > 0").select("lang", "source", "p0", F.col("q0").alias("at"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s"), "item")
    group = W.partitionBy("lang", "source")
    below = group.orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    line = line.unionByName(asks).withColumns({"bc": F.sum("c").over(below), "bs": F.sum("s").over(below), "tc": F.sum("c").over(group), "ts": F.sum("s").over(group)}).filter("item is not null")
    excess = F.col("ts") - 2 * F.col("bs") + (2 * F.col("bc") - F.col("tc")) * F.col("at") - F.col("tc") * F.abs(F.col("p0") - F.col("at"))
    alone = line.select("lang", a, b, excess.alias("part"))

    n_blocks = max(1, -(-n_rows // block))
    dealt = shares.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)))
    common = dealt.groupBy("lang", "block").applyInArrow(_corrections, "lang string, a string, b string, part long")
    return baseline.unionByName(alone).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
