"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions: a squared projected distance,
divided by the squared distance, then follows a chi-square law. A kd-tree over the projections indexes all rows: its
top, cut on a sample of bounded size, deals every row to a cell, and each cell has a tree of its own. A query takes
projected neighbours in order, measures them on the original vectors, and stops as soon as a vector nearer than its
k-th best so far would, by that law, have shown up with the asked probability. It starts in its own cell; with the k-th
best from there, the same test says which other cells it must still look into. Cells are split to shards, and their
queries to blocks, of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import kept

#: Dimensions of the projection (even), rows of a leaf, rows of a shard, and queries of a block.
DIMENSIONS, LEAF, SHARD, BLOCK = 6, 64, 8192, 2048
#: The top of the tree: at most so many cells, cut on so many rows (those of the smallest hashes) of each vector length.
CELLS, SAMPLE = 4096, 16384
#: The probability with which a nearer vector would have been met.
SURE = 0.995


def chi_square(x: float, dimensions: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dimensions // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


def chi_square_at(p: float, dimensions: int) -> float:
    """Where that function reaches p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dimensions) < p else (low, mid)
    return high


class KdTree:
    """Points in leaves of bounded size; nodes hold bounding boxes. Cuts are at the median of the widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.kids = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            own = points[self.order[begin:end]]
            me = len(self.span)
            low, high = own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((begin, end))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = me
            if end - begin > leaf and (high > low).any():
                axis = int((high - low).argmax())
                half = (end - begin) // 2
                cut = np.argpartition(own[:, axis], half)
                self.order[begin:end] = self.order[begin:end][cut]
                todo += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def nearest_first(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves by the squared distance of their boxes from q, with the rows in them: no row of a later leaf is nearer than that."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        near = (gap * gap).sum(1).tolist()
        heap = [(near[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            a, b = self.kids[node]
            if a < 0:
                begin, end = self.span[node]
                yield d, self.order[begin:end]
            else:
                heapq.heappush(heap, (near[a], a))
                heapq.heappush(heap, (near[b], b))


class Cells:
    """The top of a kd-tree, cut on a sample: every point falls into one cell. Nodes without kids are cells; they are their own kids."""

    def __init__(self, sample: np.ndarray, most: int):
        axes, cuts, kids = [], [], []
        todo = [(sample, most, -1, 0)]
        while todo:
            own, n, parent, side = todo.pop()
            me = len(kids)
            if parent >= 0:
                kids[parent][side] = me
            kids.append([me, me])
            axes.append(int(np.ptp(own, 0).argmax()))
            line = np.sort(own[:, axes[me]])
            cuts.append(line[len(line) * (n // 2) // n])
            if n > 1 and line[-1] > line[0]:
                # of many equal values, none may be cut off from the others
                cuts[me] = max(cuts[me], line[np.searchsorted(line, line[0], "right")])
                left = own[:, axes[me]] < cuts[me]
                todo += [(own[left], n // 2, me, 0), (own[~left], n - n // 2, me, 1)]
        self.axes, self.cuts, self.kids = np.array(axes), np.array(cuts), np.array(kids)
        self.low, self.high = np.full((len(kids), sample.shape[1]), np.inf), np.full((len(kids), sample.shape[1]), -np.inf)
        self.shards = np.zeros(len(kids), np.int64)

    def of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while True:
            right = points[rows, self.axes[node]] >= self.cuts[node]
            down = self.kids[node, right.astype(np.int64)]
            if (down == node).all():
                return node
            node = down

    def within(self, q: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose rows' box is no farther from q than the root of reach."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        return np.flatnonzero((self.shards > 0) & ((gap * gap).sum(1) <= reach))


def directions(length: int, seed: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dimensions))


def rounding(*points: np.ndarray) -> float:
    """A squared distance below which projections may differ by rounding alone."""
    return (1e-10 * max((np.abs(p[np.isfinite(p)]).max(initial=0.0) for p in points), default=0.0)) ** 2


def search(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, seed: int, dimensions: int = DIMENSIONS, sure: float = SURE) -> list[tuple[int, int, float]]:
    """(query, row, distance) of each query's k nearest found among base, rows with the query's own id left out. A query's bound is the distance of its k-th best elsewhere."""
    axes = directions(base.shape[1], seed, dimensions)
    places, points = base @ axes, queries @ axes
    tree_of = KdTree(places)
    slack = rounding(places, points)
    limit, found = chi_square_at(sure, dimensions), []
    for q, query, point, bound in zip(query_ids.tolist(), queries, points, bounds.tolist(), strict=True):
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        for near, rows in tree_of.nearest_first(point):
            # P(chi-square <= near / d**2) >= sure: a vector nearer than the k-th best d would be here by now
            kth = min(bound, best_d[-1]) if len(best_d) == k else bound
            if near > limit * kth**2 + slack:  # boxes at no distance may hold copies with smaller ids
                break
            rows = rows[ids[rows] != q]
            gap = base[rows] - query
            d = np.concatenate([best_d, np.sqrt((gap * gap).sum(1))])
            i = np.concatenate([best_i, rows])
            top = np.lexsort((ids[i], d))[:k]
            best_d, best_i = d[top], i[top]
        found += zip([q] * len(best_i), ids[best_i].tolist(), best_d.tolist(), strict=True)
    return found


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(value.isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    vector = table.column("vector")
    flat = (vector.combine_chunks() if isinstance(vector, pa.ChunkedArray) else vector).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _by_length(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length, with their projections."""
    for dim in np.unique(batch.column("dim").to_numpy()).tolist():
        own = batch.filter(pc.equal(batch.column("dim"), dim))
        yield dim, own, _matrix(own) @ directions(dim, seed)


def projected(df: DataFrame, seed: int, tops: dict[int, Cells] | None = None) -> DataFrame:
    """dim, cell (0 without tops) and place, the projection, of each row."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, points in _by_length(batch, seed):
                cell = tops[dim].of(points) if tops else np.zeros(len(points), np.int64)
                yield pa.RecordBatch.from_pydict({"dim": np.full(len(points), dim, np.int32), "cell": cell, "place": pa.array(list(points), pa.list_(pa.float64()))})

    return df.select("dim", "vector").mapInArrow(project, "dim int, cell long, place array<double>")


def _tops(base: DataFrame, counts: dict[int, int], shard: int, cells: int, seed: int) -> dict[int, Cells]:
    """The tree's top for each vector length, with the box of each cell's rows and their shards: at most `cells` of them, so they fit the driver."""
    rank = F.row_number().over(W.partitionBy("dim").orderBy("mix", "id"))
    large = [dim for dim, n in counts.items() if n > shard]
    sample: dict[int, list] = {dim: [] if dim in large else [[0.0] * DIMENSIONS] for dim in counts}
    if large:
        for row in projected(base.filter(F.col("dim").isin(large)).withColumn("rank", rank).filter(F.col("rank") <= SAMPLE), seed).collect():
            sample[row["dim"]].append(row["place"])
    tops = {dim: Cells(np.array(points), min(cells, -(-counts[dim] // shard))) for dim, points in sample.items()}
    sides = [f(F.col("place")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(DIMENSIONS)]
    for row in projected(base, seed, tops).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect():
        top, cell = tops[row["dim"]], row["cell"]
        top.low[cell], top.high[cell] = row[3 : 3 + DIMENSIONS], row[3 + DIMENSIONS :]
        top.shards[cell] = -(-row["n"] // shard)
    return tops


def _dealt(df: DataFrame, tops: dict[int, Cells], seed: int, visits: Callable[[int, Cells, pa.RecordBatch, np.ndarray], tuple]) -> DataFrame:
    """A row with its cell, shard and block for each of the visits (row, cell, shard, block) that it makes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, points in _by_length(batch, seed):
                at, *where = visits(dim, tops[dim], own, points)
                for i in range(0, len(at), 4096):  # a row may make many
                    out = own.take(pa.array(at[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(x[i : i + 4096], pa.int64()) for x in where)], names=[*out.schema.names, "cell", "shard", "block"])

    fields = [*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("cell", "shard", "block"))]
    return df.mapInArrow(deal, T.StructType(fields))


def _round(base: DataFrame, queries: DataFrame, tops: dict[int, Cells], k: int, block: int, seed: int, first: bool) -> DataFrame:
    """What queries find in their own cells (first), or in all others that their bounds leave open."""
    limit = chi_square_at(SURE, DIMENSIONS)

    def asked(blocks: dict[int, np.ndarray] | None) -> Callable:
        def visits(dim: int, top: Cells, own: pa.RecordBatch, points: np.ndarray) -> tuple:
            mix, home = own.column("mix").to_numpy(), top.of(points)
            shard = mix % top.shards[home]
            at, cell = np.arange(len(home)), home
            if not first:
                reach = limit * own.column("bound").to_numpy() ** 2
                slack = rounding(top.low, top.high, points)
                seen = [top.within(q, r + slack) for q, r in zip(points, reach, strict=True)]
                at = np.repeat(at, [top.shards[c].sum() for c in seen])
                open_cells = np.concatenate(seen)
                copies = top.shards[open_cells]
                cell = np.repeat(open_cells, copies)
                each = np.arange(len(cell)) - np.repeat(np.cumsum(copies) - copies, copies)
                new = (cell != home[at]) | (each != shard[at])
                at, cell, shard = at[new], cell[new], each[new]
            return at, cell, shard, mix[at] // 4096 % blocks[dim][cell] if blocks else np.zeros(len(at), np.int64)

        return visits

    # how many queries come to a cell decides how many blocks they fill
    blocks = {dim: np.zeros(len(top.shards), np.int64) for dim, top in tops.items()}
    for row in _dealt(queries, tops, seed, asked(None)).groupBy("dim", "cell").count().collect():
        blocks[row["dim"]][row["cell"]] = -(-row["count"] // (block * tops[row["dim"]].shards[row["cell"]]))

    def indexed(dim: int, top: Cells, own: pa.RecordBatch, points: np.ndarray) -> tuple:
        cell = top.of(points)
        copies = blocks[dim][cell]
        at = np.repeat(np.arange(len(cell)), copies)
        shard = own.column("mix").to_numpy()[at] % top.shards[cell[at]]
        return at, cell[at], shard, np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asking = a.column("id").to_numpy(), b.column("id").to_numpy()
        rows = search(ids, _matrix(a), asking, _matrix(b), b.column("bound").to_numpy(), k, seed) if a.num_rows and b.num_rows else []
        q, i, d = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ["dim", "cell", "shard", "block"]
    left, right = _dealt(base, tops, seed, indexed), _dealt(queries, tops, seed, asked(blocks))
    return left.select(*keys, "id", "vector").groupBy(*keys).cogroup(right.select(*keys, "id", "vector", "bound").groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")


def nearest_neighbours(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, cells: int = CELLS, seed: int = 5) -> DataFrame:
    """Each query's k nearest rows of base by Euclidean distance, as found; with fewer candidates, all.

    Returns query_id, rank (from 1; ties to the smaller id), vec_id, score (the distance of the original vectors in
    double precision). Vectors that are null, zero or hold a null or non-finite component take no part,
    on either side; only vectors of equal length meet. An id names a vector: rows of base with the query's
    id are no candidates, repeated queries (same id and vector) count once, and a null id takes no part.
    Other columns, whatever their names, are not looked at. Every row of base is indexed, but of equal vectors only the
    k + 1 smallest ids, and k rows of each, as no other can be among a query's k best. Cells hold about `shard` rows; fuller ones, as there are
    at most `cells`, are split by hash. About `block` queries meet a shard at once.
    """
    # floats travel as such; distances are worked out in double precision
    floats = all(df.schema[vector_col].dataType.simpleString() == "array<float>" for df in (base, queries))
    value = F.col(vector_col).cast("array<float>" if floats else "array<double>")
    mix = F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(1 << 40)).alias("mix")

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), value.alias("vector"), F.size(value).alias("dim")).select("*", mix)

    # of equal vectors, so many ids and so many rows of each that none of a query's k best can be missing; one exchange for both
    copy, again = F.dense_rank().over(W.partitionBy("print", "vector").orderBy("id")), F.row_number().over(W.partitionBy("print", "vector", "id").orderBy("mix"))
    base = clean(base).withColumn("print", F.xxhash64("vector")).withColumn("copy", copy).filter(F.col("copy") <= k + 1)
    base = base.withColumn("again", again).filter(F.col("again") <= k).drop("print", "copy", "again")
    queries = clean(queries).distinct()
    # a row for each vector length: as few as there are kinds of vectors
    counts = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).join(queries.select("dim").distinct(), "dim").collect()}
    known = F.col("dim").isin(list(counts)) if counts else F.lit(False)
    base, queries = kept(base.filter(known), "neighbours-base"), queries.filter(known)
    tops = _tops(base, counts, shard, cells, seed)
    own = kept(_round(base, queries.withColumn("bound", F.lit(float("inf"))), tops, k, block, seed, first=True), "neighbours-own")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = own.withColumn("rank", rank).filter(F.col("rank") <= k)
    kth = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = queries.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    others = _round(base, bounded, tops, k, block, seed, first=False)
    return own.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
