"""Quality rules on repetition: how much of a text stands inside n-grams and lines that it repeats.

The hashes of all runs of n words come from prefix sums over the words' hashes (one rolling hash per
length, in numpy, for many texts at once); equal hashes of one text meet by sorting. Rows are independent:
no shuffle, memory bounded by a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import Runs, Words, counted, covered, mix, slices, sums_by

#: Highest share of word characters inside repeated n-grams, by n (fixed values of published repetition filters).
REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of word characters inside the most frequent n-gram, by n.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Highest share of lines, and of line characters, that equal an earlier line.
LINES, LINE_CHARS = 0.30, 0.20
#: Highest number of symbols per word.
SYMBOLS = 0.10

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes that begin a code point.
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False

COLUMNS = (
    [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    + [("n_lines", T.LongType()), ("dup_line_chars", T.LongType()), ("n_dup_runs", T.LongType())]
    + [(f"dup_{n}gram_chars", T.LongType()) for n in REPEATED]
    + [(f"top_{n}gram_chars", T.LongType()) for n in TOP]
)


def _repeats(runs: Runs, words: Words, room: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of n words that can be had; the order that sorts them by text and hash; groups of equals as (start, length) in it."""
    starts = np.flatnonzero(room >= n)
    keys = mix(runs.at(starts, n) + mix(text_of[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    return starts, order, np.stack(counted(keys[order]))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for each text."""
    words = Words(texts)
    n_texts, n = len(texts), len(words)
    room, text_of = words.room(), words.text_of
    points = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_POINT[words.data], out=points[1:])
    chars = points[words.end] - points[words.start]
    out: dict[str, np.ndarray] = {"n_words": words.counts, "word_chars": sums_by(words.first, chars)}
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=symbols[1:])
    out["n_symbols"] = symbols[words.edges[1:]] - symbols[words.edges[:-1]]
    runs = Runs(words.hashes())

    def within(n_gram: int, later_only: bool) -> np.ndarray:
        """Words inside runs that occur twice or more; the first of equal runs counts unless later_only."""
        starts, order, (at, length) = _repeats(runs, words, room, text_of, n_gram)
        again = np.repeat(length > 1, length)
        if later_only:
            again[at] = False
        return covered(n, np.sort(starts[order[again]]), n_gram)

    out["n_repeat_words"] = sums_by(words.first, within(3, later_only=False).astype(np.int64))
    for size in REPEATED:
        inside = within(size, later_only=True)
        out[f"dup_{size}gram_chars"] = sums_by(words.first, np.where(inside, chars, 0))
        if size == min(REPEATED):
            opens = inside.copy()
            opens[1:] &= ~inside[:-1] | (text_of[1:] != text_of[:-1])
            out["n_dup_runs"] = sums_by(words.first, opens.astype(np.int64))
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    for size in TOP:
        starts, order, (at, length) = _repeats(runs, words, room, text_of, size)
        best = np.zeros(n_texts, np.int64)
        heads = starts[order[at]] if len(at) else np.empty(0, np.int64)
        filled = np.where(length > 1, length * (char_sums[heads + size] - char_sums[heads]), 0)
        np.maximum.at(best, text_of[heads], filled)
        out[f"top_{size}gram_chars"] = best
    out |= _lines(words, points, n_texts)
    return out | verdict(out)


def _lines(words: Words, points: np.ndarray, n_texts: int) -> dict[str, np.ndarray]:
    """Lines between line feeds that hold a word, and those among them that equal an earlier one of their text, byte for byte."""
    data, edges = words.data, words.edges
    breaks = np.flatnonzero(data == 0x0A)
    full = edges[:-1] < edges[1:]
    starts = np.unique(np.concatenate([edges[:-1][full], breaks + 1]))
    starts = starts[starts < len(data)]
    stops = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
    text = np.searchsorted(edges, starts, "right") - 1
    stops = np.minimum(stops, edges[text + 1]) if len(starts) else stops
    stops = stops - (data[np.maximum(stops - 1, 0)] == 0x0A) if len(starts) else stops
    has_word = np.searchsorted(words.start, stops) > np.searchsorted(words.start, starts)
    starts, stops, text = starts[has_word], stops[has_word], text[has_word]
    whole = Words.__new__(Words)
    whole.data, whole.start, whole.end = data, starts, stops
    keys = mix(whole.hashes() + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    at, _ = counted(keys[order])
    again = np.ones(len(starts), bool)
    again[order[at]] = False
    length = points[stops] - points[starts]
    return {
        "n_lines": np.bincount(text, minlength=n_texts)[:n_texts],
        "n_dup_lines": np.bincount(text, again, n_texts)[:n_texts].astype(np.int64),
        "dup_line_chars": np.bincount(text, np.where(again, length, 0), n_texts)[:n_texts].astype(np.int64),
        "line_chars": np.bincount(text, length, n_texts)[:n_texts].astype(np.int64),
    }


def verdict(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """base_failed, and kept: neither that nor any share above its limit."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = failed.copy()
    for size, most in REPEATED.items():
        bad |= m[f"dup_{size}gram_chars"] > most * m["word_chars"]
    for size, most in TOP.items():
        bad |= m[f"top_{size}gram_chars"] > most * m["word_chars"]
    bad |= m["n_dup_lines"] > LINES * m["n_lines"]
    bad |= m["dup_line_chars"] > LINE_CHARS * m["line_chars"]
    bad |= m["n_symbols"] > SYMBOLS * m["n_words"]
    return {"base_failed": failed, "kept": ~bad}


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of repetition and a verdict for every whole text.

    Returns per row of docs: id_col and COLUMNS. Words are `[^\\x20\\x09-\\x0D]+`. word_chars and the
    *_chars count code points; n_repeat_words: words in windows of three that the text holds twice or more,
    the first included; dup_Ngram_chars: characters of words inside an N-gram that stood earlier in the text; n_dup_runs: stretches of
    such words, for the shortest N;
    top_Ngram_chars: those of the N-gram that fills most, if it repeats. A null or empty text has zeros and
    fails (under 50 words). Repeated rows and ids give a row each; a null id stays null; other columns,
    whatever their names, are not looked at.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(k, t) for k, t in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                m = measures(part.column(1))
                arrays = [pa.array(m[k], pa.bool_() if isinstance(t, T.BooleanType) else pa.int64()) for k, t in COLUMNS]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
