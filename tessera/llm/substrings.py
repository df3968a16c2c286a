"""Substring dedup by level-wise doubling.

A window is a number of consecutive words. Windows that repeat at one length alone are extended to twice
that length, until no candidates survive:

1. Half windows. Of the half windows inside each window, the one with the least hash stands for it (equal
   windows have equal ones), so about a tenth of all places are looked at. Half windows that occur once end here.
2. Whole windows, at all places whose half window repeats. Their words are what is removed.
3. Twice, four times, ... the length, from the starts of step 1 inside repeated stretches: each level asks for the
   starts that the level before left, and the last one that something survived is reported per document.

Texts are dealt once to chunks, kept in a bucketed table of the shared folder, so no later step moves them.
At every level, a chunk sends its distinct hashes packed to the buckets of `exchange`, and only bits come back: a
passage that very many texts share is one hash of each chunk. The starts of step 3 are packed, too, a row for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.chunks import chunked
from tessera.llm.exchange import ASKS, answer, asked, occurs_again, sliding
from tessera.llm.storage import kept
from tessera.llm.words import Runs, Words, covered, sums_by

#: Starts of one chunk: the row of each, how many doublings fit behind it, and the hashes of those, start after start; survivors: the rows in which the level before repeats.
STARTS = "chunk long, row binary, levels binary, hashes binary, survivors binary"


class Level:
    """The windows of one chunk: half windows, whole windows and what the notes say of them."""

    def __init__(self, texts: pa.Array, length: int, n_buckets: int, notes: dict[str, dict[int, bytes]]):
        self.words, self.length, self.n_buckets, self.notes = Words(texts), length, n_buckets, notes
        half = (length + 1) // 2 if length > 1 else 1
        self.room = self.words.room()
        self.runs = Runs(self.words.hashes())
        self.starts = self.room >= length
        n = len(self.words)
        names = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at = np.flatnonzero(self.room >= half)
        names[at] = self.runs.at(at, half)
        width = length - half + 1
        self.least = sliding(names, width, least=True)
        reached = np.where(self.starts, self.least, np.uint64(0))
        reached = sliding(reached[::-1], width, least=False)[::-1]
        #: Half windows that stand for a whole window.
        self.anchors = np.flatnonzero((names == reached) & (self.room >= half))
        self.names = names

    def halves(self) -> np.ndarray:
        return self.names[self.anchors]

    def _again(self, hashes: np.ndarray, kind: str) -> np.ndarray:
        return occurs_again(hashes, self.notes.get(kind, {}), self.n_buckets)

    def candidates(self) -> np.ndarray:
        """Whole windows whose half window repeats."""
        at = np.flatnonzero(self.starts)
        own = np.unique(self.halves())
        again = self._again(own, "half")
        return at[again[np.searchsorted(own, self.least[at])]] if len(at) else at

    def repeated(self) -> np.ndarray:
        """Whole windows that repeat."""
        at = self.candidates()
        return at[self._again(self.runs.at(at, self.length), "whole")]

    def extended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors inside stretches of repeated windows that a doubled window fits behind: their texts, how many doublings fit, and the hashes of those."""
        at = self.repeated()
        alive = np.zeros(len(self.words) + 1, np.int64)
        alive[at] = 1
        stop = np.flatnonzero(alive == 0)
        begin = self.anchors[alive[self.anchors] > 0]
        reach = stop[np.searchsorted(stop, begin)] - begin + self.length - 1 if len(begin) else begin
        reach = np.minimum(reach, self.room[begin])
        levels = np.log2(np.maximum(reach // self.length, 1)).astype(np.int64)
        begin, levels = begin[levels > 0], levels[levels > 0]
        ends = np.cumsum(levels)
        hashes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            on = np.flatnonzero(levels >= level)
            hashes[ends[on] - levels[on] + level - 1] = self.runs.at(begin[on], self.length << level)
        return self.words.text_of[begin], levels, hashes


def _kept_text(words: Words, gone: np.ndarray) -> pa.Array:
    """The words that are not gone, joined by one space, of each text."""
    stay = np.flatnonzero(~gone)
    steps = np.zeros(len(words.data) + 1, np.int64)
    steps[words.start[stay]] += 1
    steps[words.end[stay]] -= 1
    keep = np.cumsum(steps[:-1]) > 0
    text = words.text_of[stay]
    more = np.flatnonzero(text[1:] == text[:-1])  # a kept word that has a later one in its text
    gaps = words.end[stay[more]]
    data = words.data.copy()
    data[gaps] = 0x20
    keep[gaps] = True
    edges = np.concatenate([[0], np.cumsum(keep)])[words.edges].astype(np.int32)
    return pa.StringArray.from_buffers(len(words.edges) - 1, pa.py_buffer(edges.tobytes()), pa.py_buffer(data[keep].tobytes()))


def _spans(words: Words, gone: np.ndarray) -> pa.Array:
    """[begin, end) of the stretches of gone words, as places in their text."""
    text = words.text_of
    inner = np.concatenate([[False], gone[1:] & gone[:-1] & (text[1:] == text[:-1])]) if len(gone) else gone
    begin = np.flatnonzero(gone & ~inner)
    stop = np.flatnonzero(gone & ~np.append(inner[1:], False)) + 1 if len(gone) else begin
    first = words.first[text[begin]]
    pairs = pa.StructArray.from_arrays([pa.array(begin - first, pa.int32()), pa.array(stop - first, pa.int32())], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first), pa.int32()), pairs)


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Finds each window of `length` words that also starts elsewhere, in the same text or another, and removes its words.

    Windows are judged on the input, not on what is left. Words are `[^\\x20\\x09-\\x0D]+`, compared as they
    are by 64-bit hashes of their runs. Returns, per row of docs, the struct doc with the columns in `carry`
    (if None, all but the text; their names clash with nothing there), and n_words, n_removed, kept_text (the
    other words joined by one space; with as_is, a text that loses nothing stays as it is, null included),
    spans (stretches of removed words as [begin, end)) and longest_repeat (the longest doubled length that
    repeats from some looked-at start; 0 if none, `length` if only that). A null or empty text has no words
    and an empty kept_text. Texts under `length` words keep all. Repeated rows are texts of their own: they
    repeat each other. Writes tables to the shared folder, which the result reads; see storage.scratch.
    """
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    texts = chunked(docs, id_col, text_col, carry)
    n_buckets = texts.n_buckets

    def level(rows: pa.Table, notes: dict[str, dict[int, bytes]]) -> Level:
        return Level(rows.column("words").combine_chunks(), length, n_buckets, notes)

    def ask(hashes: Callable[[Level], np.ndarray]) -> Callable[[pa.Table, dict], pa.Table]:
        return lambda rows, notes: pa.Table.from_batches([asked(rows.column("chunk")[0].as_py(), hashes(level(rows, notes)), n_buckets)])

    def told(asks: DataFrame, kind: str) -> DataFrame:
        return kept(answer(asks).select("chunk", F.lit(kind).alias("kind"), F.col("bucket").cast("long").alias("key"), F.col("again").alias("data")), f"substrings-{kind}")

    def whole(x: Level) -> np.ndarray:
        return x.runs.at(x.candidates(), length)

    notes = told(texts.over(["words"], texts.none(), ask(lambda x: x.halves()), ASKS), "half")
    notes = notes.unionByName(told(texts.over(["words"], notes, ask(whole), ASKS), "whole"))

    def extend(rows: pa.Table, notes: dict[str, dict[int, bytes]]) -> pa.Table:
        text, levels, hashes = level(rows, notes).extended()
        return _starts(rows.column("chunk")[0].as_py(), rows.column("row").to_numpy()[text], levels, hashes, np.empty(0, np.int64))

    starts = kept(texts.over(["words", "row"], notes, extend, STARTS), "substrings-starts")
    notes = notes.unionByName(_doubled(starts, length, n_buckets))

    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    long = T.LongType()
    schema = T.StructType([texts.table.schema["doc"], T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("kept_text", T.StringType()), T.StructField("spans", spans), T.StructField("longest_repeat", long)])

    def cut(rows: pa.Table, notes: dict[str, dict[int, bytes]]) -> pa.Table:
        here = level(rows, notes)
        words, at = here.words, here.repeated()
        gone = covered(len(words), at, length)
        removed = sums_by(words.first, gone.astype(np.int64))
        most = {r: size for size, found in sorted(notes.get("longest", {}).items()) for r in np.frombuffer(found, np.int64).tolist()}
        longest = [most.get(r, length if n else 0) for r, n in zip(rows.column("row").to_pylist(), removed.tolist(), strict=True)]
        left = _kept_text(words, gone)
        if as_is:
            left = pc.if_else(pa.array(removed == 0), rows.column("words").combine_chunks(), left)
        arrays = [rows.column("doc").combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), left, _spans(words, gone), pa.array(longest, pa.int64())]
        return pa.table(arrays, schema.names)

    return texts.over(["words", "row", "doc"], notes, cut, schema)


def _starts(chunk: int, row: np.ndarray, levels: np.ndarray, hashes: np.ndarray, survivors: np.ndarray) -> pa.Table:
    """A row of STARTS, or none if there is nothing to tell."""
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (row.astype(np.int64), levels.astype(np.uint8), hashes, survivors.astype(np.int64))]
    table = pa.table([pa.array([chunk], pa.int64()), *packed], ["chunk", "row", "levels", "hashes", "survivors"])
    return table if len(row) or len(survivors) else table.slice(0, 0)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    levels = np.frombuffer(row["levels"], np.uint8).astype(np.int64)
    return np.frombuffer(row["row"], np.int64), levels, np.frombuffer(row["hashes"], np.uint64)


def _doubled(starts: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Level after level, the starts whose doubled window repeats, until none survives; notes of the rows that each level survived in, by its size."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, levels, hashes = _unpacked(row)
                yield asked(row["chunk"], hashes[np.cumsum(levels) - levels], n_buckets)

    def survive(own: pa.Table, answers: pa.Table) -> pa.Table:
        """The starts whose next doubling repeats, less that doubling."""
        if not own.num_rows:
            return _starts(0, *(np.empty(0, np.int64) for _ in range(4)))
        row, levels, hashes = _unpacked(own.to_pylist()[0])
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("again").to_pylist(), strict=True))
        again = occurs_again(hashes[np.cumsum(levels) - levels], told, n_buckets)
        more = again & (levels > 1)
        rest = np.repeat(more, levels)
        rest[(np.cumsum(levels) - levels)[more]] = False
        return _starts(own.column("chunk")[0].as_py(), row[more], levels[more] - 1, hashes[rest], np.unique(row[again]))

    notes, level = None, 0
    while not starts.filter("length(row) > 0").isEmpty():
        level += 1
        open_ = starts.filter("length(row) > 0")
        answers = answer(open_.mapInArrow(ask, ASKS))
        starts = kept(open_.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(survive, STARTS), f"substrings-doubled-{level}")
        here = starts.filter("length(survivors) > 0").select("chunk", F.lit("longest").alias("kind"), F.lit(length << level).cast("long").alias("key"), F.col("survivors").alias("data"))
        notes = here if notes is None else notes.unionByName(here)
    return starts.limit(0).select("chunk", F.lit("").alias("kind"), F.lit(0).cast("long").alias("key"), F.col("row").alias("data")) if notes is None else notes
