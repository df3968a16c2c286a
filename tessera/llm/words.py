"""Words of many texts at once, as numpy arrays over the Arrow buffers.

A batch of texts is one byte buffer with offsets. Word borders, word hashes and the hashes of runs of words
are computed for the whole buffer without a Python step per word. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the polynomial hashes over bytes and over words, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text that are worked on at once; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes inside a word of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_SPACE
#: Bytes inside a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def grow(base: int) -> np.ndarray:
                x = np.full(n, base, np.uint64)
                x[0] = 1
                return np.cumprod(x)

            self.up, self.down = grow(self.base), grow(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


class Words:
    """The words of an Arrow array of strings.

    data: all bytes; edges: where each text starts in data, and the end; start, end: of each word in data;
    first: the number of each text's first word, and the number of words.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, offsets, body = texts.buffers()
        if offsets is None or not len(texts):
            edges, data = np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
        else:
            edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None else np.empty(0, np.uint8)
            edges = edges - edges[0]
        self.data = _LOWER[data] if lower else data
        self.edges = edges
        within = inside[self.data]
        opens, closes = within.copy(), within.copy()
        opens[1:] &= ~within[:-1]
        closes[:-1] &= ~within[1:]
        full = edges[:-1] < edges[1:]
        heads, tails = edges[:-1][full], edges[1:][full] - 1
        opens[heads], closes[tails] = within[heads], within[tails]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, edges)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        up, down = _BYTES.get(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Runs:
    """Hashes of runs of consecutive words, of any length, from prefix sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self.down = _WORDS.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up[: self.n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Of the runs of `length` words at `starts`, which must lie inside the words."""
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + np.uint64(length))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; a longer text is a part of its own."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0)))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def counted(sorted_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal neighbours in a sorted array: where each group starts, and its length."""
    if not len(sorted_groups):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_groups)))


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, where first has each text's first value and the end."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Of n words, those inside a run of `length` words at one of `starts`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0
