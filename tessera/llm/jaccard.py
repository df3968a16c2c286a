"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Sets are the distinct n-gram hashes of a text; equal sets are one class. Let need(s, t) be the overlap that two
sets of sizes s and t must have.

* Light: a small set is enumerated: for each size t that a partner may have, all its subsets of need(s, t)
  elements, as keys with both sizes. Two sets are linked exactly if they share a key.
* Heavy: of a large set, the first n - ceil(0.75 n) + 1 elements in a global order (rare ones first) are the
  inverted lists that it is on; similar sets share a list. How many sets have an element is counted for all elements
  (packed exchange), so those of one set come first, and a set of which others have too little is on no list of theirs.
* The boundary between them is where enumerating costs as many hashes as the lists and the check would.

Lists are not expanded into pairs. Every member is checked against one leader of the list; the classes that
this joins are one component, and no pair inside a component needs another look. Lists that still hold
several components get other leaders. What then remains is looked at whole: on long lists, each set that is
apart from the main component against all of it, in blocks; else the pairs of different components that share
enough list entries to be similar at all. All checks compare the whole sets.

That settles the components. All links lie inside them, so their number is counted there, every set with every other of
its component, block by block as a product of 0-1 matrices; what leaves a block is a number for each set.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import Chunks, chunked
from tessera.llm.exchange import COUNTS, answer_ranks, asked_ranks, ranks_of
from tessera.llm.graph import components
from tessera.llm.storage import checkpointed, kept, shuffles_dropped
from tessera.llm.words import Runs, Words, mix

#: Sets that are checked against one copy of another, and against one copy of many others.
MEMBERS, OTHERS = 256, 1024
#: Leaders that a list gets at most, and the most entries of a list whose remaining pairs are enumerated as they are.
ROUNDS, SPARSE = 3, 32
#: Elements of the sets of a block whose links are counted, and columns of a matrix of them.
ELEMENTS, STRIP = 1 << 20, 4096


def need(s: int, t: int) -> int:
    """Least overlap of sets of sizes s and t with Jaccard similarity 0.75 or more."""
    return -(-3 * (s + t) // 7)


def least(n):
    """Least size of a similar partner."""
    return (3 * n + 3) // 4


class Sets:
    """The sets of some texts: values ordered by text, then rank (of at most 31; ranks gives those of sorted values), then hash; first: where each text's begin."""

    def __init__(self, texts: pa.Array, n: int, ranks: Callable[[np.ndarray], np.ndarray] | None = None):
        words = Words(texts, lower=True)
        runs, counts = Runs(words.hashes()), words.counts
        at = np.flatnonzero(words.room() >= n)
        text, values = words.text_of[at], runs.at(at, n)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = np.concatenate([runs.at(words.first[short[counts[short] == k]], k) for k in range(1, n)])
            text = np.concatenate([text, np.concatenate([short[counts[short] == k] for k in range(1, n)])])
            values = np.concatenate([values, whole])
        order = np.argsort(values)
        group = text[order].astype(np.int64) << 5
        self.ranks = np.zeros(len(values), np.uint8) if ranks is None else ranks(values[order])
        group |= self.ranks
        turn = np.argsort(group.astype(np.uint16) if len(texts) < 2048 else group, kind="stable")
        text, values, self.ranks = text[order[turn]], values[order[turn]], self.ranks[turn]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.text, self.values, self.ranks = text[fresh], values[fresh], self.ranks[fresh]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set, whatever the order."""
        def total(x: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=sums[1:])
            return (sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64)

        return total(mix(self.values)), total(mix(self.values ^ np.uint64(0x5851F42D4C957F2D)))

    def fronts(self, chosen: np.ndarray) -> np.ndarray:
        """Places of the chosen sets' list entries in values."""
        n = self.sizes
        place = np.arange(len(self.values)) - self.first[self.text]
        return np.flatnonzero(chosen[self.text] & (place < (n - least(n) + 1)[self.text]))


def enumerated(s: int) -> int:
    """How many subsets a set of s elements is enumerated into."""
    return sum(math.comb(s, need(s, t)) for t in range(least(s), 4 * s // 3 + 1) if need(s, t) <= s)


def listed(s: int) -> int:
    """How many hashes a set of s elements costs on its lists and in the check of one partner."""
    return s - least(s) + 1 + s


def never_light(n_sets: int) -> int:
    """A size that is too large to be enumerated, whatever the sizes of so many sets are: one set costs more than all smaller ones can save."""
    s, saved = 1, 0
    while True:
        saved = max(saved, listed(s) - enumerated(s))
        if enumerated(s) - listed(s) > saved * n_sets:
            return s
        s += 1


def boundary(histogram: dict[int, int]) -> int:
    """The largest size up to which enumerating subsets costs no more hashes than the lists and the check of one partner."""
    best, over = 0, 0
    for s in sorted(histogram):
        over += histogram[s] * (enumerated(s) - listed(s))
        if over <= 0:
            best = s
    return best


def _light_keys(values: np.ndarray, limit: int) -> list[tuple[int, bool]]:
    """The keys of a small set: of each possible partner size up to limit, its subsets of the size needed; and whether that is its own size."""
    s, keys = len(values), []
    own = np.sort(values)
    for t in range(least(s), min(limit, 4 * s // 3) + 1):
        if (c := need(s, t)) <= s:
            tag = np.array((min(s, t) << 16) | max(s, t), np.uint64)
            for subset in combinations(range(s), c):
                picked = own[list(subset)]
                sums = (mix(picked) * np.arange(1, 2 * c, 2, dtype=np.uint64)).sum(keepdims=True)
                keys.append((int(mix(sums + mix(tag[None]))[0].view(np.int64)), s == t))
    return keys


def jaccard_components(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose sets of n-word shingles have 100 * intersection >= 75 * union, and groups them.

    Texts are lower-cased (A-Z); words are `[^\\x20\\x09-\\x0D]+`. A text of fewer words than n is one shingle;
    a null, empty or blank text has none and is linked with nothing. Returns per row of docs: id_col (a
    long), n_shingles, n_links (to how many other sets; equal sets count as one) and component_id (the
    smallest id that it reaches, itself included; null ids reach but do not count). A repeated id names rows of their own. Other columns,
    whatever their names, are not looked at. Shingles are compared by 64-bit hashes.
    """
    with shuffles_dropped(docs.sparkSession):
        texts = chunked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", ["id"])
        rows = _grouped(texts, n, "id", counted=True)
    ids = rows.groupBy("comp").agg(F.min("id").alias("component_id"))
    return rows.join(ids, "comp").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "n_links", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, less all but one of each component: the smallest id stays, of repeated ones one row."""
    columns = docs.columns
    with shuffles_dropped(docs.sparkSession):
        texts = chunked(docs, id_col, text_col, [c for c in columns if c != text_col])
        rows = _grouped(texts, n, id_col)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    stay = rows.groupBy("comp").agg(F.min(F.struct(order.alias("o"), "chunk", "row")).alias("x")).select("x.chunk", "x.row")

    def keep(rows: pa.Table, notes: dict) -> pa.Table:
        want = notes.get("stay", {})
        rows = rows.filter(pa.array([r in want for r in rows.column("row").to_pylist()], pa.bool_()))
        doc = rows.column("doc").combine_chunks()
        return pa.table([rows.column("words") if c == text_col else doc.field(c) for c in columns], columns)

    return texts.over(["row", "words", "doc"], _note(stay, "stay", "row", F.lit(b"")), keep, docs.schema)


def _grouped(texts: Chunks, n: int, id_col: str, counted: bool = False) -> DataFrame:
    """chunk, row, id, n (shingles) and comp (a row of its component) for each row; counted: n_links, too."""

    def describe(rows: pa.Table, notes: dict) -> pa.Table:
        sets = Sets(rows.column("words").combine_chunks(), n)
        one, two = sets.marks()
        ids = rows.column("doc").combine_chunks().field(id_col).cast(pa.int64())
        return pa.table([rows.column("chunk"), rows.column("row"), ids, pa.array(sets.sizes, pa.int64()), pa.array(one), pa.array(two)], ["chunk", "row", "id", "n", "one", "two"])

    nodes = kept(texts.over(["row", "words", "doc"], texts.none(), describe, "chunk long, row long, id long, n long, one long, two long"), "jaccard-nodes")
    first = nodes.filter("n > 0").groupBy("n", "one", "two").agg(F.min("row").alias("node"))
    chosen = kept(nodes.join(first.select("node"), F.col("row") == F.col("node")).select("chunk", "node", "n"), "jaccard-classes")
    small = chosen.filter(F.col("n") < never_light(chosen.count())).groupBy("n").count().collect()  # a row per size, some dozens
    limit = boundary({r["n"]: r["count"] for r in small})
    links = _light_links(texts, chosen, n, limit).unionByName(_heavy_links(texts, chosen, n, limit))
    links = kept(links.distinct(), "jaccard-links")
    comps = components(links)
    rows = nodes.join(first, ["n", "one", "two"], "left").select("chunk", "row", "id", "n", F.coalesce("node", "row").alias("node"))
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if counted:
        rows = rows.join(_link_counts(texts, chosen, comps, n), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return rows.drop("node")


def _link_counts(texts: Chunks, chosen: DataFrame, comps: DataFrame, n: int) -> DataFrame:
    """node, n_links of the sets that have links: each block of a component's sets meets itself and each other block once."""
    members = chosen.join(comps, "node").select("comp", "node", "chunk", "n")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.greatest(F.count(F.lit(1)) / OTHERS, F.sum("n") / ELEMENTS)).cast("int").alias("blocks"))
    members = kept(members.join(sizes, "comp"), "jaccard-members")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.filter("m > 2").select("comp", "node", "chunk", own, other)
    role = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    group = F.concat_ws("/", "comp", F.least("own", "other"), F.greatest("own", "other"))
    sent = _sent(texts, dealt.select("chunk", F.col("node").alias("row"), group.alias("group"), role.alias("role")), n)

    def count(table: pa.Table) -> pa.Table:
        role, row = table.column("role").to_numpy(), table.column("row").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        size = np.array([len(x) for x in sets], np.int64)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        # an element of one set alone is common to none
        often = np.bincount(column, minlength=len(values)) > 1
        owner, column = np.repeat(np.arange(len(sets)), size)[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        whole = (role == 2).all()
        a, b = (np.arange(len(sets)),) * 2 if whole else (np.flatnonzero(role == 0), np.flatnonzero(role == 1))
        common = np.zeros((len(a), len(b)))
        for c in range(0, int(often.sum()), STRIP):
            begin, end = np.searchsorted(column, [c, c + STRIP])
            has = np.zeros((len(sets), STRIP), np.float32)
            has[owner[begin:end], column[begin:end] - c] = 1
            common += has[a] @ has[b].T
        near = (100 * common >= 75 * (size[a][:, None] + size[b][None, :] - common)) & (row[a][:, None] != row[b][None, :])
        counts = near.sum(1) if whole else np.concatenate([near.sum(1), near.sum(0)])
        return pa.table({"node": row[a] if whole else np.concatenate([row[a], row[b]]), "n_links": pa.array(counts, pa.int64())})

    counted = sent.groupBy("group").applyInArrow(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    # the two sets of a component of two are linked with each other
    return counted.unionByName(members.filter("m = 2").select("node", F.lit(1).cast("long").alias("n_links")))


def _note(df: DataFrame, kind: str, key: str, data) -> DataFrame:
    return df.select("chunk", F.lit(kind).alias("kind"), F.col(key).alias("key"), data.alias("data"))


def _light_links(texts: Chunks, chosen: DataFrame, n: int, limit: int) -> DataFrame:
    """Links among the sets of at most `limit` elements: all sets of a key, if it has both of its sizes."""
    wanted = _note(chosen.filter(F.col("n") <= limit), "want", "node", F.lit(b""))

    def enumerate_(rows: pa.Table, notes: dict) -> pa.Table:
        want = notes.get("want", {})
        rows = rows.filter(pa.array([r in want for r in rows.column("row").to_pylist()], pa.bool_()))
        sets = Sets(rows.column("words").combine_chunks(), n)
        keys = [(*key, row, b - a) for row, a, b in zip(rows.column("row").to_pylist(), sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True) for key in _light_keys(sets.values[a:b], limit)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32()]
        return pa.table([pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)], ["key", "alike", "node", "n"])

    keys = kept(texts.over(["row", "words"], wanted, enumerate_, "key long, alike boolean, node long, n int").distinct(), "jaccard-light")
    # all sets of a key are linked if it is for one size, or if both of its sizes are there
    group = keys.groupBy("key").agg(F.min("node").alias("b"), F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("m"))
    found = keys.join(group.filter("m > 1"), "key").filter("(alike or low < high) and node <> b")
    return found.select(F.col("node").alias("a"), "b").distinct()


def _heavy_links(texts: Chunks, chosen: DataFrame, n: int, limit: int) -> DataFrame:
    """Links of pairs with at least one set of more than `limit` elements."""
    n_buckets = texts.n_buckets
    notes = checkpointed(_note(chosen.filter(F.col("n") >= least(limit + 1)), "want", "node", F.lit(b"")))

    def wanted(rows: pa.Table, notes: dict) -> pa.Table:
        want = notes.get("want", {})
        return rows.filter(pa.array([r in want for r in rows.column("row").to_pylist()], pa.bool_()))

    def ask(rows: pa.Table, notes: dict) -> pa.Table:
        sets = Sets(wanted(rows, notes).column("words").combine_chunks(), n)
        return pa.Table.from_batches([asked_ranks(rows.column("chunk")[0].as_py(), sets.values, n_buckets)])

    ranks = kept(answer_ranks(texts.over(["row", "words"], notes, ask, COUNTS)), "jaccard-ranks")
    notes = notes.unionByName(_note(ranks, "ranks", "bucket", F.col("ranks")).withColumn("key", F.col("key").cast("long")))

    def shared(rows: pa.Table, notes: dict) -> pa.Table:
        """A row per list entry that other sets have, too, with the set's size."""
        chunk, rows = rows.column("chunk")[0].as_py(), wanted(rows, notes)
        sets = Sets(rows.column("words").combine_chunks(), n, lambda values: ranks_of(values, notes.get("ranks", {}), n_buckets))
        at = sets.fronts(np.ones(rows.num_rows, bool))
        at = at[sets.ranks[at] > 0]
        text = sets.text[at]
        node = rows.column("row").to_numpy()[text] if len(at) else np.empty(0, np.int64)
        return pa.table([pa.array(sets.values[at].view(np.int64)), pa.array(node, pa.int64()), pa.array(sets.sizes[text], pa.int64()), pa.array(np.full(len(at), chunk, np.int64))], ["list", "node", "n", "chunk"])

    entries = kept(texts.over(["row", "words"], notes, shared, "list long, node long, n long, chunk long"), "jaccard-entries")
    links, comps = None, None
    for turn in range(ROUNDS + 1):
        own = entries.withColumn("comp", F.col("node")) if comps is None else entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # at first one order of all nodes leads the lists, so that near copies meet the same few leaders; then each list has its own
        draw = F.xxhash64(F.lit(turn), "node") if turn == 0 else F.xxhash64(F.lit(turn), "list", "node")
        order = F.struct(draw.alias("o"), F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("comp").alias("leader_comp"), F.col("chunk").alias("leader_chunk"))
        heads = own.groupBy("list").agg(F.min(order).alias("head"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"))
        heads = heads.filter("low <> high").select("list", "head.*", "m")  # lists of one component are done
        open_ = kept(own.join(heads, "list").drop("o"), f"jaccard-open-{turn}")
        entries = open_.select("list", "node", "n", "chunk")
        if turn == ROUNDS:
            rest = _open_links(texts, chosen, open_, comps, n)
            return rest if links is None else links.unionByName(rest)
        pairs = open_.filter("comp <> leader_comp").filter(_similar_sizes("n", "leader_n")).groupBy("node", "leader", "n", "leader_n", "chunk", "leader_chunk").agg(F.count(F.lit(1)).alias("common"), F.max("m").alias("m"))
        few = 10 * F.col("common") < F.least("n", "leader_n") - F.floor(3 * F.least("n", "leader_n") / 4)
        # what has few common lists, or later is on short lists only, is left to the end
        pairs = pairs.filter(~few if turn == 0 else F.col("m") > SPARSE)
        pairs = kept(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("chunk").alias("a_chunk"), F.col("leader_chunk").alias("b_chunk")), f"jaccard-pairs-{turn}")
        found = kept(_checked(texts, pairs, n), f"jaccard-found-{turn}")
        links = found if links is None else links.unionByName(found)
        comps = components(links)


def _open_links(texts: Chunks, chosen: DataFrame, open_: DataFrame, comps: DataFrame, n: int) -> DataFrame:
    """Links between what open lists hold of different components, as many as the components need.

    On a long list, whatever is not of the component that most of its entries have is checked against all of that
    component and against each other, block by block, without a row for each pair. The pairs of short lists are enumerated.
    """
    long_ = open_.filter(F.col("m") > SPARSE)
    most = long_.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("list").agg(F.max(F.struct("k", "comp")).alias("top")).select("list", F.col("top.comp").alias("main"))
    apart = kept(long_.join(most, "list").filter("comp <> main"), "jaccard-apart")
    pairs = kept(_open_pairs(open_.filter(F.col("m") <= SPARSE)), "jaccard-pairs")
    return _checked(texts, pairs, n).unionByName(_checked_blocks(texts, chosen, apart.select("node", "chunk", "main").distinct(), comps, n))


def _similar_sizes(a: str, b: str):
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _open_pairs(open_: DataFrame) -> DataFrame:
    """All pairs of different components that share enough list entries.

    If sets of sizes n and m are similar, their overlap is at least need = ceil(3 (n + m) / 7); the one whose list
    entries end first in the order shares at least (its entries) - (its size - need) of them. Common entries on
    long lists are not counted here; pairs that have any are checked there.
    """
    x = open_.select("list", F.col("node").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("chunk").alias("a_chunk"))
    y = open_.select("list", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("chunk").alias("b_chunk"))
    pairs = x.join(y, "list").filter("a > b and ac <> bc").filter(_similar_sizes("an", "bn"))
    pairs = pairs.groupBy("a", "b", "an", "bn", "a_chunk", "b_chunk").agg(F.count(F.lit(1)).alias("common"))
    wanted = F.ceil(3 * (F.col("an") + F.col("bn")) / 7)

    def spared(size: str):
        entries = F.col(size) - F.ceil(3 * F.col(size) / 4) + 1
        return entries - (F.col(size) - wanted)

    return pairs.filter(F.col("common") >= F.least(spared("an"), spared("bn"))).select("a", "b", "a_chunk", "b_chunk")


def _sent(texts: Chunks, sends: DataFrame, n: int) -> DataFrame:
    """The sets of rows, sent to groups: sends has chunk, row, group (text) and role; returns group, role, row, set."""
    sends = sends.groupBy("chunk", "row").agg(F.to_json(F.collect_list(F.array("group", F.col("role").cast("string")))).alias("to"))

    def send(rows: pa.Table, notes: dict) -> pa.Table:
        import json

        to = notes.get("send", {})
        rows = rows.filter(pa.array([r in to for r in rows.column("row").to_pylist()], pa.bool_()))
        sets, out = Sets(rows.column("words").combine_chunks(), n), []
        for row, a, b in zip(rows.column("row").to_pylist(), sets.first[:-1], sets.first[1:], strict=True):
            own = sets.values[a:b].tobytes()
            out += [(group, int(role), row, own) for group, role in json.loads(to[row])]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["group", "role", "row", "set"])

    return texts.over(["row", "words"], _note(sends, "send", "row", F.encode("to", "utf-8")), send, "group string, role int, row long, set binary")


def _compared(sent: DataFrame, one_each: bool) -> DataFrame:
    """In each group, the pairs of similar sets, the first of role 0, the other of role 1 or 2; one_each: of role 1 the first other is enough."""

    def compare(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        row, sets = table.column("row").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        mine, others = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        size = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate([sets[i] for i in mine] or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(mine)), size[mine])
        good, done = [], np.zeros(len(mine), bool)
        for j in others:
            own = np.sort(sets[j])
            at = np.minimum(np.searchsorted(own, every), max(len(own) - 1, 0))
            common = np.bincount(owner[own[at] == every], minlength=len(mine)) if len(own) and len(every) else np.zeros(len(mine), np.int64)
            near = (100 * common >= 75 * (size[mine] + size[j] - common)) & (row[mine] != row[j]) & (common > 0)
            if role[j] == 2:
                near &= row[mine] > row[j]
            elif one_each:
                near &= ~done
                done |= near
            good += [(int(row[mine[i]]), int(row[j])) for i in np.flatnonzero(near)]
        return pa.table({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())})

    return sent.groupBy("group").applyInArrow(compare, "a long, b long")


def _checked(texts: Chunks, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs whose whole sets are similar. A set travels once for each pair it is the first of, and once for MEMBERS pairs it is the second of."""
    shares = pairs.groupBy("b", "b_chunk").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("shares"))
    group = F.concat_ws("/", F.col("b"), F.col("share"))
    members = pairs.join(shares.select("b", "shares"), "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")))
    leaders = shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    sends = members.select(F.col("a_chunk").alias("chunk"), F.col("a").alias("row"), group.alias("group"), F.lit(0).alias("role"))
    sends = sends.unionByName(leaders.select(F.col("b_chunk").alias("chunk"), F.col("b").alias("row"), group.alias("group"), F.lit(1).alias("role")))
    return _compared(_sent(texts, sends, n), one_each=False)


def _checked_blocks(texts: Chunks, chosen: DataFrame, apart: DataFrame, comps: DataFrame, n: int) -> DataFrame:
    """Of nodes apart from a component (node, chunk, main), those that are similar to one of its members, with that member, and similar pairs of them."""
    mains = apart.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / OTHERS).cast("int").alias("xs"))
    nodes = chosen.select("node", "chunk").join(comps, "node", "left").withColumn("main", F.coalesce("comp", "node")).join(mains, "main")
    nodes = nodes.select("main", "xs", "node", "chunk", F.lit(1).alias("role")).unionByName(apart.join(mains, "main").select("main", "xs", "node", "chunk", F.lit(2).alias("role")))
    sizes = nodes.groupBy("main", "xs").agg(F.ceil(F.count(F.lit(1)) / OTHERS).cast("int").alias("ys"))
    group = F.concat_ws("/", F.col("main"), F.col("x"), F.col("y"))
    outer = apart.join(sizes, "main").withColumn("x", F.pmod(F.xxhash64("node"), F.col("xs"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    inner = nodes.join(sizes.drop("xs"), "main").withColumn("y", F.pmod(F.xxhash64("node"), F.col("ys"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    sends = outer.select("chunk", F.col("node").alias("row"), group.alias("group"), F.lit(0).alias("role")).unionByName(inner.select("chunk", F.col("node").alias("row"), group.alias("group"), "role"))
    return _compared(_sent(texts, sends, n), one_each=True)
