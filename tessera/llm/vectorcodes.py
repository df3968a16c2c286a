"""Vector code compression: product codes by Lloyd's algorithm with filtering kd-trees.

Each component becomes an integer, each vector falls into equal parts, each part gets the index of its nearest entry
in a small codebook. Every input partition cuts its vectors into blocks and builds, once, a kd-tree over each part
position of a block, with the bounding box, the sum and the count of every node; the trees go to a table of the shared
folder. A round walks the trees level by level: an entry that is beaten by another on a whole box is struck off for
that box, and where one entry is left, the whole subtree is its own, by the node's sum and count. A task hands on sums
and counts per entry, so a round moves a table of fixed size; the codebooks, as small, are with the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import kept

#: Components of a block, and points of a leaf at most.
BLOCK, LEAF = 1 << 20, 16
#: Scaled components end here, so that squared distances are exact in 64 bits.
LIMIT = 1 << 27
#: What is kept of a tree.
FIELDS = ("points", "order", "low", "high", "total")


def finite(vector: F.Column) -> F.Column:
    """Not null and without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.abs(x) < float("inf")), F.lit(False))


@dataclass
class Tree:
    """A balanced kd-tree over n points. points: in the order of the leaves; order: where each was among the input.

    Node i of level l holds the points from i * n >> l to (i + 1) * n >> l; low, high and total have the nodes' boxes and sums, level after level.
    """

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n, lows, highs, totals = len(points), [], [], []
        order, depth = np.arange(n), depth_of(n, leaf)
        for level in range(depth + 1):
            edges = edges_of(n, level)
            lows.append(np.minimum.reduceat(points, edges[:-1]))
            highs.append(np.maximum.reduceat(points, edges[:-1]))
            totals.append(np.add.reduceat(points, edges[:-1], dtype=np.int64))
            if level < depth:
                # the points of each node in the order of its widest side
                node = np.repeat(np.arange(1 << level), np.diff(edges))
                side = (highs[-1] - lows[-1]).argmax(1)
                turn = np.lexsort((points[np.arange(n), side[node]], node))
                points, order = points[turn], order[turn]
        return cls(points, order, *(np.concatenate(x) for x in (lows, highs, totals)))

    def packed(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(x, t).tobytes() for x, t in ((self.points, "<i4"), (self.order, "<i4"), (self.low, "<i4"), (self.high, "<i4"), (self.total, "<i8")))

    @classmethod
    def unpacked(cls, data: tuple[bytes, ...], width: int) -> Tree:
        read = [np.frombuffer(x, t) for x, t in zip(data, ("<i4", "<i4", "<i4", "<i4", "<i8"), strict=True)]
        return cls(*(x if i == 1 else x.reshape(-1, width).astype(np.int64) for i, x in enumerate(read)))

    def filtered(self, book: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's nearest entry, ties to the lower index, in the order of the leaves; the entries' sums and counts."""
        n, k = len(self.points), len(book)
        owner, sums, counts = np.empty(n, np.int64), np.zeros_like(book), np.zeros(k, np.int64)
        nodes, alive, depth = np.zeros(1, np.int64), np.ones((1, k), bool), depth_of(n, leaf)
        for level in range(depth + 1):
            edges, first = edges_of(n, level), (1 << level) - 1
            low, high = self.low[first + nodes], self.high[first + nodes]
            best = np.where(alive, np.square(2 * book[None] - (low + high)[:, None]).sum(2), np.iinfo(np.int64).max).argmin(1)
            # how much farther an entry is than the best, at the corner of the box that suits it most
            away = book[None] - book[best][:, None]
            corner = np.where(away > 0, high[:, None], low[:, None])
            gap = (away * (book[None] + book[best][:, None] - 2 * corner)).sum(2)
            alive &= (gap < 0) | ((gap == 0) & (best[:, None] >= np.arange(k)))
            alone = alive.sum(1) == 1
            np.add.at(sums, best[alone], self.total[first + nodes[alone]])
            np.add.at(counts, best[alone], (edges[nodes + 1] - edges[nodes])[alone])
            at, lengths = _ranges(edges[nodes[alone]], edges[nodes[alone] + 1])
            owner[at] = np.repeat(best[alone], lengths)
            nodes, alive = nodes[~alone], alive[~alone]
            if level < depth:
                nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
        at, lengths = _ranges(edges[nodes], edges[nodes + 1])
        if len(at):
            found = _nearest(self.points[at], book, np.repeat(alive, lengths, axis=0))
            owner[at] = found
            counts += np.bincount(found, minlength=k)
            for j in range(book.shape[1]):
                # at most 2 ** 20 points below 2 ** 27 each: exact as floats
                sums[:, j] += np.bincount(found, self.points[at, j], minlength=k).astype(np.int64)
        return owner, sums, counts


def depth_of(n: int, leaf: int = LEAF) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


def edges_of(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1) * n) >> level


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and their lengths."""
    lengths = end - begin
    return np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()), lengths


def _nearest(points: np.ndarray, book: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The nearest of the entries that are alive; in floats where they are exact."""
    small = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) < 1 << 22 and book.shape[1] <= 64
    kind = np.float64 if small else np.int64
    far = np.square(book).sum(1).astype(kind) - 2 * (points.astype(kind) @ book.T.astype(kind))
    far[~alive] = np.inf if small else np.iinfo(np.int64).max
    return far.argmin(1)


def _components(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Integers of the vectors, padded with zeros to `width` components."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat = np.clip(np.asarray(column.flatten(), np.float64), -LIMIT / scale, LIMIT / scale)
    out = np.zeros((len(lengths), width), np.int64)
    at, _ = _ranges(np.zeros(len(lengths), np.int64), lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = np.floor(flat * scale)
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = BLOCK) -> DataFrame:
    """A product code for each vector, and how far it is from the vector.

    Rows whose vector is null or holds null or non-finite components are left out. A component x counts as
    floor(scale * x), cut off at +-2 ** 27; vectors are cut into `parts` equal parts, shorter ones are padded with zeros to
    the length of the longest, and that to a multiple of `parts`. The codebooks start as the parts of the `entries` (1 to 256)
    vectors with the smallest ids (null ids last, equal ids by their vectors; fewer, if there are no more), and follow `rounds`
    rounds of Lloyd's algorithm: nearest entry by squared distance, ties to the lower index; then floor of the mean, unused
    entries stay. Returns per row: id_col, code (two hex digits for each part), error (squared distances of the
    parts, summed), label_error (errors of all rows with an equal label_col, nulls together), codebooks_sha256. Repeated
    rows give a row each; an empty table gives none; other columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col)
    rows = vectors.filter(finite(value)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), value.alias("vector"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) or 1
    heads = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = _components(pa.array(heads, pa.list_(pa.float64())), parts * width, scale).reshape(len(heads), parts, width).swapaxes(0, 1)
    tree = T.ArrayType(T.StructType([T.StructField(c, T.BinaryType()) for c in FIELDS]))
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("trees", tree)])
    size = max(LEAF, block // (parts * width))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                points = _components(some.column("vector"), parts * width, scale).reshape(some.num_rows, parts, width)
                trees = [dict(zip(FIELDS, Tree.built(points[:, p]).packed(), strict=True)) for p in range(parts)]
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.struct([(c, pa.binary()) for c in FIELDS])))], names=schema.names)

    blocks = kept(rows.mapInArrow(build, schema), "vector-trees")

    def trees_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Tree]]]:
        for i in range(batch.num_rows):
            yield i, [Tree.unpacked(tuple(t[c] for c in FIELDS), width) for t in batch.column("trees")[i].as_py()]

    for _ in range(rounds if heads else 0):
        after = _moved(blocks, books, trees_of)
        if np.array_equal(after, books):
            break
        books = after
    told = books

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in trees_of(batch):
                n = len(trees[0].points)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (t, book) in enumerate(zip(trees, told, strict=True)):
                    owner = t.filtered(book)[0]
                    codes[t.order, p] = owner
                    error[t.order] += np.square(t.points - book[owner]).sum(1)
                names = np.frombuffer(codes.tobytes().hex().encode(), f"S{2 * parts}").astype(str)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(names, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    out = T.StructType([T.StructField("id", schema["ids"].dataType.elementType), T.StructField("label", schema["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    codes = kept(blocks.mapInArrow(coded, out), "vector-codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, told.ravel().tolist())).encode()).hexdigest()
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moved(blocks: DataFrame, books: np.ndarray, trees_of) -> np.ndarray:
    """The codebooks after a round: one pass over the trees; a task sends a row for each entry and component, and for its count."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            for _, trees in trees_of(batch):
                for p, (t, book) in enumerate(zip(trees, books, strict=True)):
                    _, sums, counts = t.filtered(book)
                    total[p, :, :width] += sums
                    total[p, :, width] += counts
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["cell", "value"])

    found = blocks.select("trees").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    flat = np.zeros(parts * k * (width + 1), object)
    for row in found:
        flat[row["cell"]] = int(row["value"])
    total = flat.reshape(parts, k, width + 1)
    after = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, width]), strict=True):
        after[p, e] = [s // total[p, e, width] for s in total[p, e, :width]]
    return after
