"""Quality classifier by co-training of two views.

One view sees the text (surface measures and hashed words), the other the page's metadata (source, language,
length). Both start from labelled documents; round after round, each labels the unlabelled documents that it
is sure of, and the other learns from them. On labelled documents that neither has
seen, each view is calibrated, and the calibrated views are combined; that scores every document. There are two
such pairs: one for low quality, one for toxic text.

The measures of all unlabelled documents are taken once, and stored. A round goes over all of them: tasks count words
and metadata values of those that a view is sure of, in tables of fixed size; then the regressions, which start from
the labelled documents, take Newton steps whose sums (a few dozen numbers a side) come from all that a view is sure of,
weighing together as much as the labelled ones. Only labelled documents are bounded (LABELLED, chosen by a hash of their
ids); the driver holds the sums, the fitted tables and the labelled documents' columns, and scoring is one more pass.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import kept
from tessera.llm.words import Words, counted, slices, sums_by

#: Labelled documents that are fitted on, at most.
LABELLED = 8000
#: Buckets of hashed words and of hashed metadata values; documents that must hold a word before it counts.
BUCKETS, VALUES, SUPPORT = 1 << 18, 1 << 12, 3
ROUNDS, STEPS, SURE = 4, 1, 0.97
#: Sums of a task become whole numbers by this, so that their order does not matter.
EXACT = 1 << 24
#: Numbers of a part that is summed on its own; groups of tasks that are summed first; words that are looked at together.
PART, LANES, WORDS = 1 << 13, 64, 1 << 19
#: Highest share of good labelled documents that a threshold may reject.
LOSS = 0.002


def _log_odds(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return np.where(bad + good >= SUPPORT, odds, 0.0).astype(np.float32)


class Logistic:
    """Logistic regression on standardised columns, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.penalty = np.full(x.shape[1] + 1, ridge)
        self.penalty[0] = 1e-6
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.stepped(self.sums(x, y)) < 1e-6:
                break

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """X'WX and X'(y - p), side by side, at the present weights."""
        z = self._with_one(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return np.concatenate([(z * (p * (1 - p) + 1e-9)[:, None]).T @ z, (z.T @ (y - p))[:, None]], 1)

    def stepped(self, sums: np.ndarray) -> float:
        """Takes a step; how far it went."""
        step = np.clip(np.linalg.solve(sums[:, :-1] + np.diag(self.penalty), sums[:, -1] - self.penalty * self.w), -5, 5)
        self.w += step
        return float(np.abs(step).max())

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._with_one(x) @ self.w, -30, 30)


@dataclass
class Rows:
    """surface: measures of each text; words: buckets of the distinct words of each text, with first; meta: hashed values and numbers."""

    surface: np.ndarray
    words: np.ndarray
    first: np.ndarray
    meta: np.ndarray
    numbers: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        n = np.diff(self.first)[at]
        first = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.first[:-1][at] - first[:-1], n) + np.arange(first[-1])
        return Rows(self.surface[at], self.words[where], first, self.meta[at], self.numbers[at])

    def __len__(self) -> int:
        return len(self.surface)


def _crc(values: list, salt: str) -> np.ndarray:
    return np.array([zlib.crc32(f"{salt}{v}".encode()) % VALUES for v in values], np.int64)


def rows_of(texts: pa.Array, meta: list[pa.Array], numbers: list[pa.Array]) -> Rows:
    words, raw = Words(texts, lower=True), Words(texts)
    n, per = len(texts), np.maximum(words.counts, 1)
    size = np.maximum(np.diff(words.edges), 1)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return (total[words.edges[1:]] - total[words.edges[:-1]]) / size

    data = raw.data
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = (data >= 65) & (data <= 90)
    digits = (data >= 48) & (data <= 57)
    plain = letters | digits | (data >= 128) | (data == 32) | (data == 10)
    stops = np.isin(data, np.frombuffer(b".,;:", np.uint8))
    hashes = words.hashes()
    keys = np.sort(words.text_of << 18 | (hashes >> np.uint64(46)).astype(np.int64))
    at, times = counted(keys)
    distinct, text = keys[at] & (BUCKETS - 1), keys[at] >> 18
    first = np.searchsorted(text, np.arange(n + 1))
    length = (words.end - words.start).astype(float)
    mean_length = sums_by(words.first, length) / per
    top = np.zeros(n)
    np.maximum.at(top, text, times)
    breaks = share(data == 10) * size
    columns = [np.log1p(words.counts), mean_length, np.sqrt(np.maximum(sums_by(words.first, length**2) / per - mean_length**2, 0)), share(upper), share(digits), share(~plain & ~stops), share(stops), share(data >= 128), np.diff(first) / per, top / per, np.log1p(per / (breaks + 1)), share(data == 33), share(data == 124), (words.counts < 50).astype(float)]
    values = [_crc(m.to_pylist(), str(i)) for i, m in enumerate(meta)]
    figures = [np.log1p(np.maximum(np.nan_to_num(np.array([np.nan if v is None else float(v) for v in m.to_pylist()])), 0)) for m in numbers]
    figures += [np.log1p(size), np.log1p(size) ** 2]
    return Rows(np.stack(columns, 1), distinct, first, np.stack(values, 1) if values else np.zeros((n, 0), np.int64), np.stack(figures, 1))


class Counts:
    """For each view, what the documents hold that the other is sure of: words or values by label, and the number of documents."""

    def __init__(self, columns: int, flat: np.ndarray | None = None):
        size = 2 * (BUCKETS + columns * VALUES + 2)
        self.flat = np.zeros(size, np.int64) if flat is None else flat
        self.words, values, n = np.split(self.flat, [2 * BUCKETS, size - 4])
        self.words, self.values, self.n = self.words.reshape(2, -1), values.reshape(columns, 2, VALUES), n.reshape(2, 2)

    def add(self, rows: Rows, by_text: np.ndarray, by_meta: np.ndarray) -> None:
        """by_text, by_meta: the label that a view is sure of, or -1."""
        each = np.repeat(by_meta, np.diff(rows.first))
        for v in (0, 1):
            self.words[v] += np.bincount(rows.words[each == v], minlength=BUCKETS)
            for i, values in enumerate(self.values):
                values[v] += np.bincount(rows.meta[by_text == v, i], minlength=VALUES)
            self.n[:, v] += (by_meta == v).sum(), (by_text == v).sum()


class TextView:
    """Log odds of hashed words from one half of the labelled rows and from counts, then a regression on them and the surface of the other half."""

    def __init__(self, rows: Rows, y: np.ndarray, counts: Counts):
        half = np.arange(len(rows)) % 2 == 0
        own = rows.take(np.flatnonzero(half))
        label = np.repeat(y[half], np.diff(own.first))
        bad, good = (np.bincount(own.words[label == v], minlength=BUCKETS) + counts.words[v] for v in (1, 0))
        self.odds = _log_odds(bad, good, int(y[half].sum() + counts.n[0, 1]), int((1 - y[half]).sum() + counts.n[0, 0]))
        rest = np.flatnonzero(~half)
        self.x, self.y = self.columns(rows.take(rest)), y[rest]
        self.model = Logistic(self.x, self.y)

    def columns(self, rows: Rows) -> np.ndarray:
        w, n = self.odds[rows.words].astype(float), np.maximum(np.diff(rows.first), 1)
        text = np.repeat(np.arange(len(rows)), np.diff(rows.first))
        most = np.zeros(len(rows))
        np.maximum.at(most, text, w)
        strong = sums_by(rows.first, np.where(w > 1.5, w, 0.0))
        return np.concatenate([rows.surface, np.stack([most, np.log1p(strong), sums_by(rows.first, w) / n, strong / n], 1)], 1)

    def logit(self, rows: Rows) -> np.ndarray:
        return self.model.logit(self.columns(rows))


class MetaView:
    """Log odds of the metadata's values from labelled rows and counts, and a regression on them and its numbers."""

    def __init__(self, rows: Rows, y: np.ndarray, counts: Counts):
        n_bad, n_good = int(y.sum() + counts.n[1, 1]), int((1 - y).sum() + counts.n[1, 0])
        self.odds = [_log_odds(*(np.bincount(rows.meta[y == v, i], minlength=VALUES) + counts.values[i, v] for v in (1, 0)), n_bad, n_good) for i in range(rows.meta.shape[1])]
        self.x, self.y = self.columns(rows), y
        self.model = Logistic(self.x, self.y)

    def columns(self, rows: Rows) -> np.ndarray:
        return np.concatenate([np.stack([o[rows.meta[:, i]] for i, o in enumerate(self.odds)], 1) if self.odds else np.zeros((len(rows), 0)), rows.numbers], 1)

    def logit(self, rows: Rows) -> np.ndarray:
        return self.model.logit(self.columns(rows))


def _both(y: np.ndarray, least: int = 2) -> bool:
    return min(int(y.sum()), int((1 - y).sum())) >= least


class CoTrained:
    """Two views, their calibration and combination, and the threshold from which a document is rejected.

    The views' tables come from labelled rows and from counts over the unlabelled documents that the models of the round
    before were sure of; taught() lets their regressions learn from the same documents.
    """

    def __init__(self, rows: Rows, y: np.ndarray, counts: Counts):
        turn = np.arange(len(rows)) % 10
        fit, rest = np.flatnonzero(turn < 7), np.flatnonzero(turn >= 7)
        self.views = [kind(rows.take(fit), y[fit], counts) for kind in (TextView, MetaView)]
        held = rows.take(rest)
        self.held, self.held_y = [v.columns(held) for v in self.views], y[rest]
        self._calibrated()

    def _calibrated(self) -> None:
        logits = [v.model.logit(x) for v, x in zip(self.views, self.held, strict=True)]
        self.scales = [Logistic(x[:, None], self.held_y) for x in logits]
        scaled = np.stack([s.logit(x[:, None]) for s, x in zip(self.scales, logits, strict=True)], 1)
        self.final = Logistic(scaled, self.held_y)
        good = np.sort((1 / (1 + np.exp(-self.final.logit(scaled))))[self.held_y == 0])
        self.threshold = max(0.5, float(good[int(np.ceil((1 - LOSS) * len(good))) - 1])) if len(good) else 0.5

    def lesson(self, rows: Rows, before: CoTrained) -> list[tuple[np.ndarray, int]]:
        """For each view, the Newton sums of the rows that the other view of the models before is sure of, and how many they are."""
        out = []
        for view, label in zip(self.views, reversed(before.sure(rows)), strict=True):
            at = np.flatnonzero(label >= 0)
            out.append((view.model.sums(view.columns(rows.take(at)), label[at]), len(at)))
        return out

    def taught(self, lessons: list[tuple[np.ndarray, int]]) -> None:
        """A Newton step on the labelled rows and the sums of others, which weigh as much as the labelled ones at most."""
        for view, (sums, n) in zip(self.views, lessons, strict=True):
            view.model.stepped(view.model.sums(view.x, view.y) + sums * min(1.0, len(view.y) / max(n, 1)))
        self._calibrated()

    def light(self) -> CoTrained:
        """The same without the labelled rows' columns, for the tasks."""
        out = copy(self)
        out.views = [copy(v) for v in self.views]
        for v in out.views:
            v.x = v.y = None
        out.held = out.held_y = None
        return out

    def sure(self, rows: Rows) -> list[np.ndarray]:
        """For each view, the label that it is sure of, or -1; where the views are sure of different ones, only the surer says it."""
        logits = [v.logit(rows) for v in self.views]
        p = [1 / (1 + np.exp(-x)) for x in logits]
        labels = [np.where(x >= SURE, 1, np.where(1 - x >= SURE, 0, -1)) for x in p]
        apart = (np.minimum(*labels) == 0) & (np.maximum(*labels) == 1)
        first = np.abs(logits[0]) > np.abs(logits[1])
        return [np.where(apart & ~first, -1, labels[0]), np.where(apart & first, -1, labels[1])]

    def _scaled(self, rows: Rows) -> np.ndarray:
        return np.stack([s.logit(v.logit(rows)[:, None]) for s, v in zip(self.scales, self.views, strict=True)], 1)

    def chances(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the text, by the metadata, by both."""
        x = self._scaled(rows)
        return tuple(1 / (1 + np.exp(-v)) for v in (x[:, 0], x[:, 1], self.final.logit(x)))


Models = tuple[CoTrained | None, CoTrained | None]


@dataclass
class Fitted:
    """The models for low quality and for toxic text (None: nothing to learn from), and the columns they look at."""

    models: Models
    text: str
    meta: tuple[str, ...]
    numbers: tuple[str, ...]

    def judged(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        """Chances by text, metadata and both, for each model; and what is kept."""
        string = lambda c: batch.column(c).cast(pa.string())
        rows = rows_of(string(self.text), [string(c) for c in self.meta], [batch.column(c) for c in self.numbers])
        out, stays = [], np.ones(batch.num_rows, bool)
        for model in self.models:
            found = model.chances(rows) if model else (np.zeros(len(rows)),) * 3
            stays &= found[2] < model.threshold if model else True
            out += found
        return out, stays


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta: tuple[str, ...], numbers: tuple[str, ...], labelled: int) -> Fitted:
    """Fits on at most `labelled` labelled documents and all others; see quality_scores."""
    meta, numbers = tuple(c for c in meta if c in docs.columns), tuple(c for c in numbers if c in docs.columns)
    named = [F.col(text_col).cast("string").alias("t"), *(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numbers))]
    documents = docs.select(F.col(id_col).alias("id"), F.struct(*named).alias("doc"))
    draw = F.xxhash64(F.lit(23), "id")
    given = labels.select(F.col(id_col).alias("id"), "quality", "toxic").filter("id is not null").groupBy("id").agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("bad"))
    chosen = given.orderBy(draw, "id").limit(labelled)
    # of a labelled id with several texts the first is the labelled one; the others are documents as all others
    chosen = kept(documents.join(F.broadcast(chosen), "id").groupBy("id", "low", "bad").agg(F.min("doc").alias("doc")), "quality-chosen")  # at most `labelled` rows
    lists = {"surface": T.DoubleType(), "words": T.IntegerType(), "meta": T.IntegerType(), "numbers": T.DoubleType()}

    def measured(rows: DataFrame, others: list[str], name: str) -> DataFrame:
        """The measures of each row, stored."""
        schema = T.StructType([*(rows.schema[c] for c in others), *(T.StructField(c, T.ArrayType(t)) for c, t in lists.items())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "t"):
                    x = rows_of(part.column("t"), [part.column(f"m{i}") for i in range(len(meta))], [part.column(f"x{i}") for i in range(len(numbers))])
                    columns = [pa.array(list(x.surface), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(x.first, pa.int32()), pa.array(x.words, pa.int32())), pa.array(list(x.meta.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(x.numbers), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], names=schema.names)

        return kept(rows.mapInArrow(run, schema), name)

    sample = measured(chosen.select(draw.alias("draw"), F.col("low").cast("double").alias("low"), F.col("bad").cast("double").alias("bad"), "doc.*"), ["draw", "low", "bad"], "quality-sample")
    context = docs.sparkSession.sparkContext

    def fitted(counts: list[Counts]) -> Models:
        told = context.broadcast([_dense(c.flat) for c in counts])

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts := [b for b in batches if b.num_rows]:
                table = pa.Table.from_batches(parts)
                models = _models(table.take(pc.sort_indices(table["draw"])), [Counts(len(meta), _flat(data)) for data in told.value])
                yield pa.RecordBatch.from_pydict({"models": pa.array([pickle.dumps(models)], pa.binary())})

        found = sample.repartition(1).mapInArrow(fit, "models binary").first()  # at most `labelled` rows in
        told.destroy()
        return pickle.loads(found["models"]) if found else (None, None)

    models = fitted([Counts(len(meta)) for _ in range(2)])
    if not any(models):
        return Fitted(models, text_col, meta, numbers)
    own = F.broadcast(chosen.select("id", F.xxhash64("doc").alias("print")))
    rest = documents.join(own, (documents["id"] == own["id"]) & (F.xxhash64(documents["doc"]) == own["print"]), "left_anti")
    rest = measured(rest.select("doc.*"), [], "quality-measures")
    for _ in range(ROUNDS):
        before, counts = models, _counts_of(rest, models, len(meta))
        models = fitted(counts)
        for _ in range(STEPS):
            for model, lessons in zip(models, _lessons(rest, models, before), strict=True):
                if model:
                    model.taught(lessons)
    return Fitted(tuple(m and m.light() for m in models), text_col, meta, numbers)


def _summed(rows: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of the tasks' tables by part (part int, lane int, data: whole numbers, compressed); of very many tasks in two steps, so that no task gets a row of every other."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(_flat(x.as_py()) for x in table.column("data"))
        return pa.table({"part": table.column("part")[:1], "data": pa.array([_dense(total)], pa.binary())})

    if tasks > LANES**2:
        rows = rows.groupBy("part", "lane").applyInArrow(add, "part int, data binary")
    return {r["part"]: _flat(r["data"]) for r in rows.groupBy("part").applyInArrow(add, "part int, data binary").collect()}


def _parts(flat: np.ndarray, lane: int) -> Iterator[pa.RecordBatch]:
    for i, at in enumerate(range(0, len(flat), PART)):
        if flat[at : at + PART].any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "lane": pa.array([lane], pa.int32()), "data": pa.array([_dense(flat[at : at + PART])], pa.binary())})


def _dense(counts: np.ndarray) -> bytes:
    """Counts are small and many are 0: a tenth of their size."""
    return zlib.compress(counts.tobytes(), 1)


def _flat(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def _counts_of(rest: DataFrame, models: Models, n_meta: int) -> list[Counts]:
    """Over all unlabelled documents, for each model; tables of fixed size, whatever the number of documents."""
    told = rest.sparkSession.sparkContext.broadcast([m and m.light() for m in models])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counts(n_meta) for _ in told.value]
        for rows in _stored(batches):
            for own, model in zip(counts, told.value, strict=True):
                if model:
                    own.add(rows, *model.sure(rows))
        yield from _parts(np.concatenate([c.flat for c in counts]), TaskContext.get().partitionId() % LANES)

    flat = np.concatenate([Counts(n_meta).flat for _ in models])
    for part, x in _summed(rest.mapInArrow(count, "part int, lane int, data binary"), rest.rdd.getNumPartitions()).items():
        flat[part * PART : part * PART + len(x)] = x
    told.destroy()
    return [Counts(n_meta, x) for x in np.split(flat, len(models))]


def _lessons(rest: DataFrame, models: Models, before: Models) -> list[list[tuple[np.ndarray, int]]]:
    """For each model and view, the Newton sums over all unlabelled documents that the other view was sure of before, and their number."""
    told = rest.sparkSession.sparkContext.broadcast(([m and m.light() for m in models], [m and m.light() for m in before]))
    shapes = [[(len(v.model.w), len(v.model.w) + 1) for v in m.views] if m else [] for m in models]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[[np.zeros(s), 0] for s in own] for own in shapes]
        for rows in _stored(batches):
            for total, model, old in zip(totals, *told.value, strict=True):
                for mine, (sums, n) in zip(total, model.lesson(rows, old) if model else (), strict=True):
                    mine[0] += sums
                    mine[1] += n
        flat = np.concatenate([np.append(np.rint(sums.ravel() * EXACT), n) for own in totals for sums, n in own]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "n"])

    flat = np.zeros(sum(a * b + 1 for own in shapes for a, b in own), np.int64)
    for row in rest.mapInArrow(learn, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[row["cell"]] = row["n"]
    told.destroy()
    out, at = [], 0
    for own in shapes:
        out.append([])
        for a, b in own:
            out[-1].append((flat[at : at + a * b].reshape(a, b) / EXACT, int(flat[at + a * b])))
            at += a * b + 1
    return out


def _models(table: pa.Table, counts: list[Counts]) -> Models:
    """The models for low quality and for toxic text; None where either kind of label is missing."""
    rows, models = _unpacked(table), []
    for head, own in zip(("low", "bad"), counts, strict=True):
        y = table.column(head).to_numpy()
        known = np.flatnonzero(~np.isnan(y))
        turn = np.arange(len(known)) % 10
        enough = len(known) and all(_both(y[known][m].astype(int)) for m in (turn < 7, turn >= 7))
        models.append(CoTrained(rows.take(known), y[known].astype(int), own) if enough else None)
    return tuple(models)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Stored measures, a bounded number of words at a time."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("words").value_lengths(), np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + WORDS, "right")))
            yield _unpacked(pa.Table.from_batches([batch.slice(at, to - at)]))
            at = to


def _unpacked(table: pa.Table) -> Rows:
    n = table.num_rows
    lists = {c: table.column(c).combine_chunks() for c in ("surface", "words", "meta", "numbers")}
    flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
    first = np.concatenate([[0], np.cumsum(lists["words"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Rows(flat["surface"].reshape(n, -1), flat["words"], first, flat["meta"].reshape(n, -1), flat["numbers"].reshape(n, -1))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",), labelled: int = LABELLED) -> DataFrame:
    """Chances that each document is of low quality or toxic, and whether it is kept.

    labels has id_col, quality and toxic (0 or 1; a null says nothing; of repeated labels the worse counts).
    Returns per row of docs: id_col, text_low, meta_low, low_quality (by the text, by the metadata, combined),
    text_toxic, meta_toxic, toxic, score (1 minus the larger of low_quality and toxic) and kept (both under their
    thresholds). If the sample lacks either kind of label, that chance is 0 and rejects nothing. A null text counts
    as empty; null metadata is a value of its own; columns of meta and numbers that docs lacks are left out, and
    other columns, whatever their names, are not looked at. Repeated rows and ids give a row each. At most
    `labelled` labelled documents count as such; words, metadata values and regressions are learned from all others, too.
    """
    fitted = fit_quality(docs, labels, id_col, text_col, meta, numbers, labelled)
    names = ["text_low", "meta_low", "low_quality", "text_toxic", "meta_toxic", "toxic", "score"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, T.DoubleType()) for k in names), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out, stays = fitted.judged(part)
                score = 1 - np.maximum(out[2], out[5])
                yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(x, pa.float64()) for x in [*out, score]), pa.array(stays)], names=schema.names)

    return docs.select(*dict.fromkeys([id_col, text_col, *fitted.meta, *fitted.numbers])).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",), labelled: int = LABELLED) -> DataFrame:
    """The rows of docs, unchanged, that quality_scores keeps."""
    fitted = fit_quality(docs, labels, id_col, text_col, meta, numbers, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(fitted.judged(part)[1]))

    return docs.mapInArrow(run, docs.schema)
