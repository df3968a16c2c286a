"""Packing tokenised documents into sequences by vector best-fit.

A sequence is a bin with three capacities: tokens, documents, and attention cost (the sum of squared lengths). A
document longer than a sequence is cut into whole sequences, but for its first piece. Pieces shorter than a sequence are
dealt by hash to shards of about equal size, and each shard packs its own, longest first: among the open bins that a
piece fits into under every capacity, it takes the one with the smallest weighted norm of what would be left, or the
one whose room has the largest weighted dot product with what the piece asks for. Bins with the same room are one class,
so a piece is compared with as many classes as there are kinds of room, however many bins are open.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import kept
from tessera.llm.words import slices

#: Pieces of a shard.
SHARD = 1 << 15


class Bins:
    """Open bins by the room that is left in them; classes of bins with the same room."""

    def __init__(self, capacity: tuple[int, ...], rule: str = "norm", weights: tuple[float, ...] = (1.0, 0.01, 0.01)):
        if rule not in ("norm", "dot"):
            raise ValueError("rule must be norm or dot")
        self.capacity, self.rule = np.array(capacity, np.int64), rule
        self.scale = np.sqrt(np.array(weights)) / self.capacity
        self.room = np.full((64, len(capacity)), -1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(64)]
        self.row: dict[tuple[int, ...], int] = {}
        self.free = list(range(63, -1, -1))
        self.opened = 0

    def put(self, need: tuple[int, ...]) -> int:
        """The bin that takes what is needed; a new one if none has room."""
        asked = np.array(need, np.int64)
        fits = np.flatnonzero((self.room >= asked).all(1))
        if len(fits):
            if self.rule == "norm":
                score = np.square((self.room[fits] - asked) * self.scale).sum(1)
            else:
                score = -((self.room[fits] * self.scale) @ (asked * self.scale))
            # of equal scores, the fullest
            at = fits[np.lexsort((*self.room[fits].T[::-1], score))[0]] if len(fits) > 1 else fits[0]
            room = self.room[at]
            number = self.bins[at].pop()
            left = tuple((room - asked).tolist())
            if not self.bins[at]:
                del self.row[tuple(room.tolist())]
                self.room[at] = -1
                self.free.append(at)
        else:
            number, left = self.opened, tuple((self.capacity - asked).tolist())
            self.opened += 1
        if all(x > 0 for x in left):  # a full bin takes no more
            at = self.row.get(left)
            if at is None:
                if not self.free:
                    n = len(self.room)
                    self.room = np.concatenate([self.room, np.full_like(self.room, -1)])
                    self.bins += [[] for _ in range(n)]
                    self.free = list(range(2 * n - 1, n - 1, -1))
                at = self.free.pop()
                self.row[left], self.room[at] = at, left
            self.bins[at].append(number)
        return number


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm", weights: tuple[float, ...] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, longest first, equal ones in order."""
    bins, used = Bins(capacity, rule, weights), []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bins.put((n, 1, n * n))
        if at == len(used):
            used.append(0)
        where[i], offset[i] = at, used[at]
        used[at] += n
    return where, offset


@cache
def byte_bpe_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids by the byte-level vocabulary of a tokenizer's JSON file; strings of special tokens are ordinary text.

    The file's merges make its tokens in the order of their ids, so an id is a merge's rank, and ranks are all that an encoder needs.
    """
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [model["vocab"][m] for m in made]
    if order != sorted(order):
        raise ValueError(f"{path}: ids do not follow the merges")
    singles = {c: model["vocab"][c] for c in of}
    ranks = {bytes([of[c]]): i for c, i in singles.items()} | {bytes(of[c] for c in m): i for m, i in zip(made, order, strict=True)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths: whole pieces, but for the first."""
    head = n if n <= size else n % size or size
    return [(0, head), *((at, size) for at in range(head, n, size))]


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2, size: int = 1024, most: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, ...] = (1.0, 0.01, 0.01), id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Where each piece of each document lies in sequences of at most `size` tokens, `most` documents and `attention` cost.

    A document is its token ids (tokenizer: a byte-level vocabulary's JSON file) and then `end`; a null text counts as empty. Only documents of more than `size` tokens are cut,
    into pieces of `size`, the first one shorter where they do not come out even. most: at least 1, or as many as fit; attention: the sum of
    squared lengths, at least size * size, or not limited beyond what `size` allows. Returns per piece: id_col, piece (from 0), start, length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), sequence_id (any numbers), offset (in the sequence, without gaps from 0), and
    with with_ids its ids. Repeated rows are packed each; null ids stay null; an empty table gives no rows; other columns, whatever their
    names, are not looked at. piece is an int, the others are longs. A shard's last bins may be left less full: one in some thousands.
    """
    most, attention = most or size, attention or size * size
    if attention < size * size:
        raise ValueError("attention must allow a sequence of one document")
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("row", "piece", "start", "length", "ids_crc32"))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(tokenizer, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                at, found, parts = [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = np.array([*encode(text.as_py()), end], "<u4")
                    for piece, (start, length) in enumerate(pieces_of(len(ids), size)):
                        own = ids[start : start + length]
                        at.append(i)
                        found.append((piece, start, length, zlib.crc32(own.tobytes())))
                        if with_ids:
                            parts.append(own.astype(np.int32))
                some = part.take(pa.array(at, pa.int64()))
                columns = [some.column("id"), some.column("row"), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    pieces = kept(rows.mapInArrow(cut, schema), "packing-pieces")
    whole, short = pieces.filter(F.col("length") == size), pieces.filter(F.col("length") < size)
    n_shards = max(1, round(short.count() / shard))
    columns = [F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    whole = whole.select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        where, offset = best_fit(table.column("length").to_numpy(), (size, most, attention), rule, weights)
        first = table.column("shard")[0].as_py() << 33
        return table.append_column("sequence_id", pa.array(first + 2 * where)).append_column("offset", pa.array(offset)).drop_columns(["shard"])

    placed = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards))).groupBy("shard").applyInArrow(pack, placed)
    return whole.select(*columns).unionByName(dealt.select(*columns))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with their ids: sequence_id, ids, lengths (of the documents' pieces, in order). A group has at most as many rows as a sequence has tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
