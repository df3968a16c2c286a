"""Which of very many hashes occur twice or more, without a row for each.

Every chunk of the corpus sends its distinct hashes, sorted and packed, to the buckets of the hash range;
a bucket answers each chunk with a bit per hash. A hash that a third of all texts hold is sent once by each
chunk, so no bucket is hot; buckets are as many as the hashes ask for. Where it matters how often a hash occurs, a
bucket answers with a byte for each, and a bucket's hashes are told apart by 32 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.words import counted

ASKS = "bucket int, chunk long, hashes binary, twice binary"
ANSWERS = "chunk long, bucket int, again binary"
COUNTS = "bucket int, chunk long, hashes binary, counts binary"
RANKS = "chunk long, bucket int, ranks binary"


def bucket_edges(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin among sorted hashes, and the end: equal parts of the hash range."""
    limits = np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]]).astype(np.int64)


def asked(chunk: int, hashes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A chunk's rows of ASKS; hashes: all it has, repeats included."""
    hashes = np.sort(hashes)
    at, n = counted(hashes)
    own, twice = hashes[at], n > 1
    edges = bucket_edges(own, n_buckets)
    full = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[b], edges[b + 1]) for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([own[p].tobytes() for p in parts], pa.binary()), pa.array([np.packbits(twice[p]).tobytes() for p in parts], pa.binary())],
        names=["bucket", "chunk", "hashes", "twice"],
    )


def answer(asks: DataFrame) -> DataFrame:
    """ANSWERS to rows of ASKS: of each chunk's distinct hashes in a bucket, in order, whether they occur again anywhere."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        sizes = [len(x) for x in rows]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(table.column("twice"), sizes, strict=True)])
        every = np.concatenate(rows)
        order = np.argsort(every)
        at, n = counted(every[order])
        again = np.empty(len(every), bool)
        again[order] = np.repeat((n > 1) | np.logical_or.reduceat(twice[order], at), n)
        ends = np.cumsum(sizes)
        bits = [np.packbits(again[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "again": pa.array(bits, pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


def occurs_again(hashes: np.ndarray, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """Of the hashes that a chunk asked for, in any order and with repeats, which occur twice or more; answers: by bucket."""
    own = np.unique(hashes)
    edges = bucket_edges(own, n_buckets)
    again = np.zeros(len(own), bool)
    for b, bits in answers.items():
        n = edges[b + 1] - edges[b]
        again[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return again[np.searchsorted(own, hashes)] if len(own) else np.zeros(0, bool)


def asked_ranks(chunk: int, hashes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A chunk's rows of COUNTS; hashes: all it has, repeats included. Of those of a bucket the lower 32 bits go, and a count of 255 at most."""
    hashes = np.sort(hashes)
    at, n = counted(hashes)
    edges = bucket_edges(hashes[at], n_buckets)
    low, n = hashes[at].astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    full = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[b], edges[b + 1]) for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([low[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())],
        names=["bucket", "chunk", "hashes", "counts"],
    )


def answer_ranks(asks: DataFrame) -> DataFrame:
    """RANKS in answer to rows of COUNTS: of each chunk's distinct hashes in a bucket, in order, how often they occur anywhere, in half powers of two: 0 for once, 31 at most."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("hashes")]
        every, n = np.concatenate(rows), np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        order = np.argsort(every)
        at, repeats = counted(every[order])
        total = np.add.reduceat(n[order], at, dtype=np.int64)
        ranks = np.empty(len(every), np.uint8)
        ranks[order] = np.repeat(np.minimum(np.ceil(2 * np.log2(total)), 31).astype(np.uint8), repeats)
        ends = np.cumsum([len(x) for x in rows])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ranks": pa.array([ranks[e - len(x) : e].tobytes() for x, e in zip(rows, ends, strict=True)], pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, RANKS)


def ranks_of(hashes: np.ndarray, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """The ranks of all hashes that a chunk asked for, sorted, with repeats; answers: by bucket."""
    at, n = counted(hashes)
    edges = bucket_edges(hashes[at], n_buckets)
    ranks = np.zeros(len(at), np.uint8)
    for b, data in answers.items():
        ranks[edges[b] : edges[b + 1]] = np.frombuffer(data, np.uint8)
    return np.repeat(ranks, n)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of values[i : i + width], cut off at the end, by doubling the width."""
    pick = np.minimum if least else np.maximum
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = pick(out[:-step], out[step:]) if len(out) > step else out[:-step]
        done += step
    return out

