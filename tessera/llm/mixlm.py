"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words, then one end. Each token is coded by up to three bits, then counts or letters:

* Did what is known follow the two words before with this token? If so: its share of what followed them.
* Else: did it follow the one word before with it? If so: its share of that.
* Else: is the token known at all? If so: its share of all tokens. Else it is new, and spelled byte by byte, bit by bit.

Known are the training texts, less the text that is being coded, and what came before in the text itself, so the counts
learn while they code. They are exact: each chunk of texts sends its distinct tokens, pairs and triples, packed, to
buckets of the hash range, and gets their counts back; what is gathered grows with the corpus, and no bucket does.

Each bit is predicted by several tables of zeros and ones that are addressed by hashes of its context (for the three
questions: how often the words before were seen, how the last tokens were coded, how long the text has followed something known, the
one and the two words before; for letters: the last few bytes of the word). The stretched predictions are combined by
the weight set that a gate selects, and a second table refines the result by what really followed such a result. The
tables, first weights and refinement are learned from all training texts, in tables of fixed size; a bit of a
training text does not see itself in them. While a text is coded, the weights of the questions follow its bits, and one
more predictor tells how its own bits went so far. All of that is the text's own: no other held-out text has a say.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import kept, new_folder, noted_table
from tessera.llm.words import Words, counted, mix, slices, sums_by

#: Bytes that each predictor of letters looks back, and slots of its table.
ORDERS, SLOTS = (1, 2, 3, 4, 6), 1 << 18
#: Predictors of the three questions, and slots of each one's table.
ASPECTS, CELLS = 5, 1 << 16
#: Weight sets of letters: place in the word (4) by trust in the longest context (8); of questions: which (3) by how long the text has followed something known (4).
LETTER_GATES, QUESTION_GATES = 32, 12
#: Steps of a refinement table; slots of a part of a table that is summed on its own.
STEPS, PART = 33, 1 << 16
#: Bytes of text in a chunk and in a bucket; new words that are spelled at once.
CHUNK, BUCKET, WORDS = 4 << 20, 16 << 20, 20_000
#: Learning rates; bits of letters in a step; tokens of a text in a step; how much of what a text's own bits told stays from step to step.
RATE, OWN_RATE, BATCH, STRIDE, STAYS = 0.05, 0.02, 4096, 32, 0.8
#: How a token was coded.
AFTER_TWO, AFTER_ONE, PLAIN, NEW, START = range(5)

_END = mix(np.array([0xE0F], np.uint64))[0]
_FAR, _NEAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ASKS = "bucket int, chunk long, kind int, keys binary, few binary, many binary"
ANSWERS = "bucket int, chunk long, kind int, few binary, many binary, n long, v long"


def _squeezed(x: np.ndarray) -> bytes:
    """An array of whole numbers, each byte of them in a row of its own, as their entropy alone."""
    pack = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return pack.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) + pack.flush()


def _unsqueezed(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data, -15), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _few_many(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those of 255 and more in full."""
    return _squeezed(np.minimum(counts, 255).astype(np.uint8)), counts[counts >= 255].astype(np.int64).tobytes()


def _counts(few: bytes, many: bytes) -> np.ndarray:
    counts = _unsqueezed(few, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(many, np.int64)
    return counts


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of words, one after the other."""
    total = np.cumsum(size)
    return data[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


def _trained(id_: object, folds: int, out: int) -> bool:
    return zlib.crc32(str(id_).encode()) % folds != out


# --- chunks of texts and the counts of their tokens, pairs and triples


class Stream:
    """The tokens of a chunk's texts: kinds of tokens by hash; which one each is; the text and the place in it of each."""

    def __init__(self, row: dict):
        self.types = np.frombuffer(row["types"], np.uint64)
        self.which = np.frombuffer(row["stream"], np.uint32).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(len(self.which)) - self.first[self.text]

    def runs(self, length: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of `length` tokens end, and their keys: bucket and 32 bits of hash."""
        h, at = self.types[self.which], np.flatnonzero(self.place >= length - 1)
        key = h[at] + h[at - 1] * _NEAR if length == 2 else h[at] + h[at - 1] * _NEAR + h[at - 2] * _FAR + _FAR
        key = mix(key)
        return at, _bucket(key, n_buckets) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Equal parts of the hash range."""
    return (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)


def _chunks(docs: DataFrame, folds: int, out: int) -> DataFrame:
    """A row for each chunk of texts, as Stream reads it; sizes and bytes: of the tokens that at most one of its training texts holds, which alone may be new."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[0].dataType))] + [T.StructField(k, T.BinaryType()) for k in ("train", "lengths", "n_bytes", "types", "stream", "rare", "sizes", "bytes")])

    def pack(chunk: int, parts: list[tuple[pa.Array, Words, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        n, each = len(ids), np.concatenate([w.counts for _, w, _ in parts])
        lengths = each + 1
        ends = np.cumsum(lengths) - 1
        is_word = np.ones(int(lengths.sum()), bool)
        is_word[ends] = False
        hashes = np.full(len(is_word), _END, np.uint64)
        hashes[is_word] = np.concatenate([h for _, _, h in parts])
        types, which = np.unique(hashes, return_inverse=True)
        train = np.array([_trained(i, folds, out) for i in ids.to_pylist()], np.uint8)
        text = np.repeat(np.arange(n), lengths)
        shift = np.cumsum([0, *(len(w.data) for _, w, _ in parts)])
        start, size = np.zeros(len(is_word), np.int64), np.zeros(len(is_word), np.int64)
        start[is_word] = np.concatenate([w.start + s for (_, w, _), s in zip(parts, shift[:-1], strict=True)])
        size[is_word] = np.concatenate([w.end - w.start for _, w, _ in parts])
        low, high, at = np.full(len(types), n), np.full(len(types), -1), np.zeros(len(types), np.int64)
        learnt = np.flatnonzero(train[text])
        np.minimum.at(low, which[learnt], text[learnt])
        np.maximum.at(high, which[learnt], text[learnt])
        at[which] = np.arange(len(which))
        rare = np.flatnonzero(low >= high)
        data = np.concatenate([w.data for _, w, _ in parts])
        row = [train, lengths.astype(np.uint32), sums_by(np.concatenate([[0], ends + 1]), size + 1), types, which.astype(np.uint32), rare.astype(np.uint32), size[at[rare]].astype(np.uint32), _gather(data, start[at[rare]], size[at[rare]])]
        listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), listed, *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                words = Words(part.column(1), lower=True)
                parts.append((part.column(0), words, words.hashes()))
                held += len(words.data)
                if held >= CHUNK:
                    yield pack(chunk, parts)
                    parts, held, chunk = [], 0, chunk + 1
        if parts:
            yield pack(chunk, parts)

    return docs.mapInArrow(run, schema)


def _ask(chunk: int, stream: Stream, n_buckets: int) -> pa.RecordBatch:
    """A chunk's rows of ASKS: its distinct tokens (kind 1, by whole hash), pairs and triples, and how often its training texts hold each."""
    rows: list[tuple] = []
    for kind in (1, 2, 3):
        if kind == 1:
            own, counts = stream.types, np.bincount(stream.which, stream.train[stream.text], len(stream.types)).astype(np.int64)
            buckets, low = _bucket(own, n_buckets), own
        else:
            at, keys = stream.runs(kind, n_buckets)
            tagged = np.sort(keys << np.uint64(1) | stream.train[stream.text[at]].astype(np.uint64))
            keys = tagged >> np.uint64(1)
            first, n = counted(keys)
            counts = sums_by(np.append(first, len(keys)), (tagged & np.uint64(1)).astype(np.int64))
            buckets, low = keys[first] >> np.uint64(32), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(buckets, np.arange(n_buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            gaps = np.diff(low[part], prepend=low.dtype.type(0))
            rows.append((b, chunk, kind, _squeezed(gaps), *_few_many(counts[part])))
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "chunk", "kind", "keys", "few", "many"])


def _answer(table: pa.Table) -> pa.Table:
    """For each row of ASKS of a bucket, the counts over all chunks; and a row (chunk -1) with the number of training tokens and of distinct ones."""
    rows, out = table.to_pylist(), []
    for kind in (1, 2, 3):
        asks = [r for r in rows if r["kind"] == kind]
        if not asks:
            continue
        keys = [np.cumsum(_unsqueezed(r["keys"], np.uint64 if kind == 1 else np.uint32), dtype=np.uint64) for r in asks]
        every = np.concatenate(keys)
        order = np.argsort(every)
        at, n = counted(every[order])
        counts = np.concatenate([_counts(r["few"], r["many"]) for r in asks])
        sums = sums_by(np.append(at, len(every)), counts[order])
        totals = np.empty(len(every), np.int64)
        totals[order] = np.repeat(sums, n)
        ends = np.cumsum([len(k) for k in keys])
        out += [(r["bucket"], r["chunk"], kind, *_few_many(totals[e - len(k) : e]), None, None) for r, k, e in zip(asks, keys, ends, strict=True)]
        if kind == 1:
            out.append((asks[0]["bucket"], -1, 0, None, None, int(sums.sum()), int((sums > 0).sum())))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["bucket", "chunk", "kind", "few", "many", "n", "v"])


def _placed(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the keys, in the order of texts: its number among the sorted distinct ones, how often its text has it, and how often before."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    part = new.copy()
    part[1:] |= text[order[1:]] != text[order[:-1]]
    at = np.flatnonzero(part)
    size = np.diff(np.append(at, len(keys)))
    which, own, before = (np.empty(len(keys), np.int64) for _ in range(3))
    which[order], own[order], before[order] = np.cumsum(new) - 1, np.repeat(size, size), np.arange(len(keys)) - np.repeat(at, size)
    return which, own, before


def _scale(counts: np.ndarray) -> np.ndarray:
    """0 for none, then one more for each power of two, 15 at most."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)), 14) + 1, 0).astype(np.uint8)


def _coded(row: dict, answers: dict[int, np.ndarray], n: int, v: int, n_buckets: int) -> dict:
    """How each token of a chunk is coded; n, v: training tokens, and distinct ones; answers: totals by kind, in the order of the keys.

    Per token: code (see AFTER_TWO, ...; 8 and 16 are added if the first and the second question were asked), seen (scales of the counts
    of the two words and of the word before), word (16 bits of hash). Per text: its columns of the result, and direct: the
    logarithms of its shares. new, sizes, bytes: the text and the letters of each new token.
    """
    s = Stream(row)
    train, tokens = s.train[s.text], len(s.which)
    counts = {}
    for kind in (1, 2, 3):
        at, keys = (np.arange(tokens), s.which) if kind == 1 else s.runs(kind, n_buckets)
        which, own, before = _placed(keys, s.text[at])
        found = np.zeros(tokens, np.int64)
        found[at] = np.maximum((answers[kind][which] if len(at) else 0) - own * train[at], 0) + before
        counts[kind] = found
    one, two = (np.concatenate([[0], counts[k][:-1]]) if tokens else counts[k] for k in (1, 2))  # of the word, and of the two words, before
    one, two = np.where(s.place >= 1, one, 0), np.where(s.place >= 2, two, 0)
    after_two = (two > 0) & (counts[3] > 0)
    ask_one = ~after_two & (one > 0)
    after_one = ask_one & (counts[2] > 0)
    plain = ~after_two & ~after_one & (counts[1] > 0)
    code = np.select([after_two, after_one, plain], [AFTER_TWO, AFTER_ONE, PLAIN], NEW).astype(np.uint8) + np.uint8(8) * (two > 0) + np.uint8(16) * ask_one
    known = n - s.train[s.text] * s.lengths[s.text] + s.place
    share = np.select([after_two, after_one, plain], [counts[3] / np.maximum(two, 1), counts[2] / np.maximum(one, 1), counts[1] / np.maximum(known, 1)], 1.0)
    total = answers[1][s.which] if tokens else np.zeros(0, np.int64)
    new = np.flatnonzero(~(after_two | after_one | plain))
    rare, sizes = (np.frombuffer(row[k], np.uint32).astype(np.int64) for k in ("rare", "sizes"))
    of = np.searchsorted(rare, s.which[new])
    ends = np.cumsum(sizes)
    kind_of = [code & 7 == k for k in (AFTER_TWO, AFTER_ONE, PLAIN, NEW)]
    return {
        "train": s.train.astype(np.uint8),
        "lengths": s.lengths.astype(np.uint32),
        "n_bytes": np.frombuffer(row["n_bytes"], np.int64),
        "n_known": sums_by(s.first, (total > 0).astype(np.int64)),
        "base": sums_by(s.first, np.log10((total + 0.5) / (n + 0.5 * (v + 1)))),
        "direct": sums_by(s.first, np.log(np.minimum(share, 1.0))),
        "kinds": np.stack([sums_by(s.first, k.astype(np.int64)) for k in kind_of], 1),
        "code": code,
        "seen": _scale(two) << np.uint8(4) | _scale(one),
        "word": (s.types[s.which] >> np.uint64(48)).astype(np.uint16),
        "new": s.text[new].astype(np.uint32),
        "sizes": sizes[of].astype(np.uint32),
        "bytes": _gather(np.frombuffer(row["bytes"], np.uint8), ends[of] - sizes[of], sizes[of]),
    }


KINDS = {"train": np.uint8, "lengths": np.uint32, "n_bytes": np.int64, "n_known": np.int64, "base": np.float64, "direct": np.float64, "kinds": np.int64, "code": np.uint8, "seen": np.uint8, "word": np.uint16, "new": np.uint32, "sizes": np.uint32, "bytes": np.uint8}


# --- bits and their predictors


def _stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + 0.4) / (zero + 0.4))


class Mixer:
    """tables: zeros and ones by predictor and slot; weights: by gate and input; refined: zeros and ones by gate and step of a result.

    Stretched chances are worked out once for each slot: as it is, and as it is to a bit that is in the tables itself and is not to see itself, a zero or a one.
    """

    def __init__(self, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray | None = None):
        self.weights, self.refined, self.slots = weights.astype(np.float32), refined, tables.shape[2]
        zero, one = tables[:, 0], tables[:, 1]
        less = [(zero, one), (np.maximum(zero - 1, 0), one), (zero, np.maximum(one - 1, 0))]
        self.stretched = np.stack([_stretched(z, o) for z, o in less], 1).astype(np.float32).reshape(len(tables), -1)
        self.trust = np.concatenate([np.minimum(np.log2(z[-1] + o[-1] + 1), 7) for z, o in less]).astype(np.int64)

    def inputs(self, slots: list[np.ndarray], ones: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' stretched chances of a one, a row for each bit, and how much the last predictor has seen. Where own is 1, the bit is in the tables."""
        shift = (own * (1 + ones)).astype(np.int64) * self.slots
        x = np.empty((len(ones), len(slots)), np.float32)
        for i, s in enumerate(slots):
            at = s + shift
            x[:, i] = self.stretched[i][at]
        return x, self.trust[at]

    def chance(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one, after refinement."""
        p = 1 / (1 + np.exp(-mixed))
        if self.refined is not None:
            zero, one = self.refined[:, gate, _step(mixed)]
            p = (p + (one + 8 * p) / (zero + one + 8)) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)


def _step(mixed: np.ndarray) -> np.ndarray:
    return np.rint((mixed + 14) * (STEPS - 1) / 28).astype(np.int64)


def _mixed(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", x, weights), -14, 14)


class Letters:
    """The bits of new tokens: a word ends with a space, the end of a text is a zero byte."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray, own: np.ndarray):
        n = len(sizes)
        ends = np.cumsum(sizes + 1)
        self.first = np.concatenate([[0], ends])
        coded = np.full(int(ends[-1]) if n else 0, 0x20, np.uint8)
        token = np.repeat(np.arange(n), sizes + 1)
        place = np.arange(len(coded)) - self.first[token]
        coded[place < sizes[token]] = data
        coded[self.first[:-1][sizes == 0]] = 0
        self.coded, self.own = coded, own[token].astype(np.float32)
        self.gate = np.minimum(np.log2(place + 1).astype(np.int64), 3) * 8
        self.contexts, wide = [], coded.astype(np.uint64)
        for order in ORDERS:
            h = np.full(len(coded), order, np.uint64)
            for back in range(1, order + 1):
                seen = np.where(place >= back, np.concatenate([np.zeros(back, np.uint64), wide])[: len(coded)] + np.uint64(1), np.uint64(0))
                h = (h + seen) * _FAR
            self.contexts.append(mix(h))

    def each(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each of eight places in a byte: the bits there, and the slots of each predictor."""
        for k in range(8):
            node = (np.uint64(1) << np.uint64(k)) | (self.coded >> np.uint8(8 - k)).astype(np.uint64) if k else np.ones(len(self.coded), np.uint64)
            step = node * np.uint64(0xBF58476D1CE4E5B9)
            yield (self.coded >> np.uint8(7 - k)) & np.uint8(1), [(((c + step) * np.uint64(0x94D049BB133111EB)) >> np.uint64(46)).astype(np.int64) for c in self.contexts]


def _letters(row: dict, train: bool = False) -> Iterator[tuple[Letters, np.ndarray]]:
    """The new tokens of a chunk (train: of its training texts) in blocks, and the text of each."""
    sizes, text, data = row["sizes"].astype(np.int64), row["new"].astype(np.int64), row["bytes"]
    if train:
        own = np.flatnonzero(row["train"][text])
        data = _gather(data, (np.cumsum(sizes) - sizes)[own], sizes[own])
        sizes, text = sizes[own], text[own]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), WORDS):
        to = min(at + WORDS, len(sizes))
        yield Letters(sizes[at:to], data[edges[at] : edges[to]], row["train"][text[at:to]]), text[at:to]


class Questions:
    """The bits of the three questions of a chunk, in steps of STRIDE tokens of each text; texts are numbered from the longest on."""

    def __init__(self, row: dict, train: bool = False):
        """train: of training texts alone."""
        lengths = row["lengths"].astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.number = np.empty(len(lengths), np.int64)
        self.number[order] = np.arange(len(lengths))
        first = np.concatenate([[0], np.cumsum(lengths)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(text)) - first[text]
        how, code = row["code"] & 7, row["code"]
        n = len(how)
        last = [np.where(place >= b, np.concatenate([np.zeros(b, np.uint8), how])[:n], START).astype(np.uint64) for b in (1, 2, 3)]
        broken = np.where((how != AFTER_TWO) | (place == 0), np.arange(n), 0)
        run = np.arange(n) - np.concatenate([[0], np.maximum.accumulate(broken)])[:n] - 1 if n else broken
        run = np.clip(np.where(place >= 1, run, 0), 0, 15).astype(np.uint64)
        near, far = (np.where(place >= b, np.concatenate([np.zeros(b, np.uint16), row["word"]])[:n], 0).astype(np.uint64) for b in (1, 2))
        two, one = (row["seen"] >> np.uint8(4)).astype(np.uint64), (row["seen"] & np.uint8(15)).astype(np.uint64)
        wanted = row["train"][text] > 0 if train else np.ones(n, bool)
        asked = [np.flatnonzero((code & 8 > 0) & wanted), np.flatnonzero((code & 16 > 0) & wanted), np.flatnonzero((how >= PLAIN) & wanted)]
        at = np.concatenate(asked)
        which = np.repeat(np.arange(3), [len(a) for a in asked])
        ones = np.concatenate([how[a] == k for a, k in zip(asked, (AFTER_TWO, AFTER_ONE, PLAIN), strict=True)])
        step = place[at] // STRIDE
        order = np.lexsort((self.number[text[at]], step))
        at, which, self.ones = at[order], which[order], ones[order].astype(np.float32)
        self.edges = np.searchsorted(step[order], np.arange(int(step.max(initial=-1)) + 2))
        self.text, self.own = self.number[text[at]], row["train"][text[at]].astype(np.float32)
        self.which, self.gate = which, which * 4 + np.minimum(run[at], 3).astype(np.int64)
        q, seen = which.astype(np.uint64), np.where(which == 0, two[at], one[at])
        aspects = [(seen << np.uint64(8)) | one[at], last[0][at] | last[1][at] << np.uint64(3) | last[2][at] << np.uint64(6), (seen << np.uint64(8)) | run[at], near[at], (near[at] << np.uint64(16)) | far[at]]
        self.slots = [((((a << np.uint64(6)) | (q << np.uint64(4)) | np.uint64(i)) + np.uint64(1)) * _FAR >> np.uint64(48)).astype(np.int64) for i, a in enumerate(aspects)]

    def coded(self, mixer: Mixer, adapt: bool, weigh: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Goes through the steps; returns each bit's mixed result, and its chance of what it is.

        adapt: each text's weights follow its bits, from those of the mixer on; weigh: those of the mixer follow the bits of training texts.
        """
        n_texts, n_inputs = len(self.number), ASPECTS + 2
        own = np.repeat(mixer.weights[None], n_texts, 0) if adapt else None
        told = np.zeros((2, n_texts, 3), np.float32)  # zeros and ones of a text's own bits so far
        every = np.empty(len(self.ones), np.float32)
        inputs = np.full((len(self.ones), n_inputs), 0.3, np.float32)
        inputs[:, :ASPECTS] = mixer.inputs(self.slots, self.ones, self.own)[0]
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True):
            if a == b:
                continue
            part = slice(a, b)
            text, gate, ones, which, x = self.text[part], self.gate[part], self.ones[part], self.which[part], inputs[part]
            x[:, ASPECTS] = _stretched(told[0, text, which], told[1, text, which])
            mixed = _mixed(x, own[text, gate] if adapt else mixer.weights[gate])
            every[part] = mixed
            miss = ones - 1 / (1 + np.exp(-mixed))
            m = int(text.max()) + 1
            told[:, :m] *= STAYS
            now = np.bincount((text * 3 + which) * 2 + (ones > 0), minlength=m * 6).reshape(m, 3, 2)
            told[:, :m] += now.transpose(2, 0, 1)
            if adapt:
                cell = text * QUESTION_GATES + gate
                times = np.maximum(np.bincount(cell, minlength=m * QUESTION_GATES), 1)
                for i in range(n_inputs):
                    own[:m, :, i] += (OWN_RATE * np.bincount(cell, miss * x[:, i], m * QUESTION_GATES) / times).reshape(m, -1)
            if weigh:
                miss = miss * self.own[part]
                times = np.maximum(np.bincount(gate, self.own[part], QUESTION_GATES), 1)
                mixer.weights = mixer.weights + (RATE * np.stack([np.bincount(gate, miss * x[:, i], QUESTION_GATES) / times for i in range(n_inputs)], 1)).astype(np.float32)
        p = mixer.chance(every, self.gate)
        return every, np.where(self.ones == 1, p, 1 - p)


# --- learning


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in KINDS.items()}


def _parts(*totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrays, one after the other, in parts; those of zeros alone are left out."""
    flat = np.concatenate([t.ravel() for t in totals])
    for i, at in enumerate(range(0, len(flat), PART)):
        if flat[at : at + PART].any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "data": pa.array([zlib.compress(flat[at : at + PART].astype(np.float32).tobytes(), 1)], pa.binary())})


def _summed(parts: DataFrame, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    """Sums of what _parts gave in each task; the shapes are fixed by parameters."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.float32).astype(np.float64) for x in table.column("data"))
        return pa.table({"part": table.column("part")[:1], "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    sizes = [int(np.prod(s)) for s in shapes]
    total = np.zeros(sum(sizes), np.float32)
    for row in parts.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        x = np.frombuffer(row["data"], np.float32)
        total[row["part"] * PART : row["part"] * PART + len(x)] = x
    return [x.reshape(s) for x, s in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def _spelled(mixer: Mixer, row: dict) -> np.ndarray:
    """The log chance of each text's new tokens."""
    out = np.zeros(len(row["lengths"]))
    for letters, text in _letters(row):
        log = np.zeros(len(letters.coded))
        for ones, slots in letters.each():
            x, trust = mixer.inputs(slots, ones, letters.own)
            gate = letters.gate + trust
            p = mixer.chance(_mixed(x, mixer.weights[gate]), gate)
            log += np.log(np.where(ones == 1, p, 1 - p))
        out += np.bincount(text, sums_by(letters.first, log), len(out))
    return out


def _spelling(mixer: Mixer, row: dict, refined: np.ndarray) -> None:
    """Lets the weights follow the new tokens of training texts; refined gets what followed each result."""
    for letters, _ in _letters(row, train=True):
        for ones, slots in letters.each():
            x, trust = mixer.inputs(slots, ones, letters.own)
            gate = letters.gate + trust
            for at in range(0, len(ones), BATCH):
                p = slice(at, at + BATCH)
                mixed = _mixed(x[p], mixer.weights[gate[p]])
                _follow(refined, gate[p], mixed, ones[p])
                miss = ones[p] - 1 / (1 + np.exp(-mixed))
                times = np.maximum(np.bincount(gate[p], minlength=LETTER_GATES), 1)
                mixer.weights = mixer.weights + (RATE * np.stack([np.bincount(gate[p], miss * x[p, i], LETTER_GATES) / times for i in range(len(ORDERS))], 1)).astype(np.float32)


def _follow(refined: np.ndarray, gate: np.ndarray, mixed: np.ndarray, ones: np.ndarray) -> None:
    """Counts what followed each result."""
    size = refined[0].size
    refined += np.bincount((gate * STEPS + _step(mixed)) + size * (ones > 0), minlength=2 * size).reshape(refined.shape)


def _learned(coded: DataFrame) -> tuple:
    """Tables (as a broadcast), weights and refinements for letters and for questions, from all bits of training texts, in two passes."""
    context = coded.sparkSession.sparkContext
    tables = (len(ORDERS), 2, SLOTS), (ASPECTS, 2, CELLS)
    sets = (LETTER_GATES, len(ORDERS)), (QUESTION_GATES, ASPECTS + 2)
    finer = (2, LETTER_GATES, STEPS), (2, QUESTION_GATES, STEPS)
    first = [np.full(s, 1.5 / s[1]) for s in sets]

    def count(batches):
        letters, questions = (np.zeros(s, np.float32) for s in tables)
        for row in _rows(batches):
            for block, _ in _letters(row, train=True):
                for ones, slots in block.each():
                    shift = ones.astype(np.int64) * SLOTS
                    for i, s in enumerate(slots):
                        np.add.at(letters[i].ravel(), s + shift, np.float32(1))
            q = Questions(row, train=True)
            shift = (q.ones > 0) * CELLS
            for i, s in enumerate(q.slots):
                questions[i] += np.bincount(s + shift, minlength=2 * CELLS).reshape(2, -1)
        yield from _parts(letters, questions)

    told = context.broadcast(_summed(coded.mapInArrow(count, "part int, data binary"), *tables))

    def weigh(batches):
        letters, questions, seen = Mixer(told.value[0], first[0]), Mixer(told.value[1], first[1]), 1e-9
        total, after = [np.zeros(s) for s in sets], [np.zeros(s) for s in finer]
        for row in _rows(batches):
            _spelling(letters, row, after[0])
            q = Questions(row, train=True)
            mixed, _ = q.coded(questions, adapt=False, weigh=True)
            _follow(after[1], q.gate, mixed, q.ones)
            bits = float(row["lengths"][row["train"] > 0].sum())
            seen += bits
            for t, m in zip(total, (letters, questions), strict=True):
                t += m.weights * bits
        yield from _parts(*total, np.array([seen]), *after)

    *weights, seen, letters_after, questions_after = _summed(coded.mapInArrow(weigh, "part int, data binary"), *sets, (1,), *finer)
    weights = [w / seen[0] for w in weights] if seen[0] >= 1 else first
    return told, weights, (letters_after, questions_after)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out: int = 1) -> DataFrame:
    """log10 probabilities of every whole text, A-Z lower-cased, from the texts whose crc32(id as text) mod folds is not out.

    Tokens are the words `[^\\x20\\x09-\\x0D]+`, then one end. Returns per row of docs: id_col, held_out, n_tokens,
    n_known (tokens that training texts hold), train_tokens, base_score (sum of log10((c + 0.5) / (N + 0.5 (V + 1)))),
    score (the mixing model's log10 probability; of a training text, by the other training texts), n_after_two, n_after_one,
    n_plain, n_new (how its tokens were coded), n_bytes (as coded) and bits_per_byte. A null or empty text is
    one end. A null id counts as the text "None". Repeated rows and ids are texts of their own; other
    columns, whatever their names, are not looked at. Without training texts every count is 0. Counts of pairs and triples
    meet by 32 bits of hash in a bucket, those of tokens by 64. First weights are averages over chunks of texts, so the last digits of a score
    depend on how the input is split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    name = f"tessera_texts_{uuid.uuid4().hex}"
    # a task's chunks go to the bucket files as they are: texts move never
    _chunks(docs, folds, out).write.format("parquet").option("path", new_folder(spark, "lm-texts")).option("compression", "zstd").bucketBy(n_buckets, "chunk").saveAsTable(name)
    noted_table(name)
    chunks = spark.table(name)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _ask(row["chunk"], Stream(row), n_buckets)

    asks = chunks.select("chunk", "types", "stream", "lengths", "train").mapInArrow(ask, ASKS)
    answers = kept(asks.groupBy("bucket").applyInArrow(_answer, ANSWERS), "lm-counts")
    total = answers.filter("chunk < 0").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n", "v"))).first()
    n, v = total["n"], total["v"]
    ids = T.StructField("ids", chunks.schema["ids"].dataType)

    def code(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        told = sorted(answers.select(["kind", "bucket", "few", "many"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        by = {k: np.concatenate([np.zeros(0, np.int64), *(_counts(r["few"], r["many"]) for r in told if r["kind"] == k)]) for k in (1, 2, 3)}
        row = chunk.drop_columns(["ids"]).to_pylist()[0]
        found = _coded(row, by, n, v, n_buckets)
        return pa.table([chunk.column("ids"), *(pa.array([found[k].astype(t).tobytes()], pa.binary()) for k, t in KINDS.items())], ["ids", *KINDS])

    coded = chunks.groupBy("chunk").cogroup(answers.filter("chunk >= 0").select("chunk", "kind", "bucket", "few", "many").groupBy("chunk"))
    coded = kept(coded.applyInArrow(code, T.StructType([ids, *(T.StructField(k, T.BinaryType()) for k in KINDS)])), "lm-coded")
    told, weights, refined = _learned(coded)
    long, double = T.LongType(), T.DoubleType()
    names = [(id_col, docs.schema[id_col].dataType), ("held_out", T.BooleanType()), ("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", double), ("score", double), *((f"n_{k}", long) for k in ("after_two", "after_one", "plain", "new", "bytes")), ("bits_per_byte", double)]
    schema = T.StructType([T.StructField(k, t) for k, t in names])

    def score(batches):
        letters, questions = (Mixer(t, w, r) for t, w, r in zip(told.value, weights, refined, strict=True))
        for batch in batches:
            for i in range(batch.num_rows):
                row = next(_rows([batch.slice(i, 1)]))
                q = Questions(row)
                _, chances = q.coded(questions, adapt=True)
                log = row["direct"] + _spelled(letters, row) + np.bincount(q.text, np.log(chances), len(q.number))[q.number]
                found, kinds = log / np.log(10), row["kinds"].reshape(-1, 4)
                arrays = [batch.column("ids")[i].values, pa.array(row["train"] == 0), pa.array(row["lengths"].astype(np.int64)), pa.array(row["n_known"]), pa.array(np.full(len(log), n, np.int64)), pa.array(row["base"]), pa.array(found), *(pa.array(np.ascontiguousarray(kinds[:, k])) for k in range(4)), pa.array(row["n_bytes"]), pa.array(-log / np.log(2) / row["n_bytes"])]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return coded.mapInArrow(score, schema)
