"""Quality by ordinal cumulative-link regression over hashed text features.

A document's grade y is one of 0 < 1 < ... < K.  One weight vector w is shared by all grades and
ordered thresholds t_1 < ... < t_K tell them apart:  P(y >= k) = sigmoid(w.x - t_k).  The model
gives the expected grade and the tail probabilities by which documents are selected.

Features are hashes of what a text holds: words and their first letters, runs of punctuation,
words in capitals, a word that repeats the one before it.  Each but the first letters counts
twice, as present and by its share of the text, in separate hash slots.  The hash space is so
wide that an unknown word hardly ever meets a known slot.  Only slots whose rated texts have
grades clearly unlike the average get a weight, so that a long text gathers no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import discard, materialize
from .textkit import LOWER, chunks, mix, set_of, span_hashes, trimmed, words

#: Rated documents that fitting reads at most, those with the smallest hashes.
SAMPLE = 6_000
#: Rated documents in which a slot must occur to get a weight.
LEAST_TEXTS = 4
#: Standard errors by which the mean grade of a slot's texts must differ from that of all texts.
LEAST_SCORE = 4.0
#: Word beginnings, in bytes.
PREFIXES = (4, 5)
SLOTS = 1 << 40
PENALTY, STEPS = 0.1, 150

_BLANK = set_of("\x20\x09\x0a\x0b\x0c\x0d")
_UPPER = set_of(bytes(range(65, 91)))
_LETTERS = set_of(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_MARKS = ~(_BLANK | _LETTERS)
_CAPITALS, _REPEAT = np.uint64(0xA11CA95), np.uint64(0x4E9EA7)


def _slots(keys: np.ndarray, kind: int) -> np.ndarray:
    return mix(keys ^ mix(np.full(1, kind, np.uint64))) % np.uint64(SLOTS)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(slots, values)`` for each text of a buffer, slots ascending."""
    low = LOWER[data]
    word, word_end, word_bounds = words(low, offsets, _LETTERS)
    mark, mark_end, mark_bounds = words(data, offsets, _MARKS)
    word_keys, mark_keys = span_hashes(low, word, word_end), span_hashes(data, mark, mark_end)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    plain = np.concatenate(([0], np.cumsum(data < 128)))
    raised = capitals[word_end] - capitals[word]
    loud = (raised >= 2) & (raised == plain[word_end] - plain[word])  # all of it in capitals, as far as ASCII goes
    again = np.zeros(len(word_keys), bool)
    again[1:] = word_keys[1:] == word_keys[:-1]
    size = word_end - word
    both = np.concatenate([span_hashes(low, word, word + np.minimum(size, n)) ^ mix(np.full(1, n, np.uint64)) for n in PREFIXES])
    for k in range(len(offsets) - 1):
        a, b, c, d = word_bounds[k], word_bounds[k + 1], mark_bounds[k], mark_bounds[k + 1]
        total = max(1, b - a)
        own, n = np.unique(np.concatenate((word_keys[a:b], mark_keys[c:d] ^ np.uint64(0x5A5A5A5A))), return_counts=True)
        flags = [(f, m) for f, m in ((_CAPITALS, int(loud[a:b].sum())), (_REPEAT, int(again[a + 1 : b].sum()))) if m]
        keys = np.concatenate((own, np.array([f for f, _ in flags], np.uint64)))
        n = np.concatenate((n, np.array([m for _, m in flags], np.int64)))
        begins = np.unique(np.concatenate([both[j * len(word) :][a:b] for j in range(len(PREFIXES))]))
        slots = np.concatenate((_slots(keys, 1), _slots(keys, 2), _slots(begins, 3)))
        values = np.concatenate((np.ones(len(keys)), np.sqrt(n / total), np.ones(len(begins))))
        order = np.argsort(slots, kind="stable")
        yield slots[order].astype(np.int64), values[order].astype(np.float32)


@dataclass
class Model:
    """Sorted slots with their weights, and the ordered thresholds between grades."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K."""
        total = 0.0
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
            hit = self.slots[at] == slots
            total = float(self.weights[at[hit]] @ values[hit])
        return 1 / (1 + np.exp(np.clip(self.thresholds - total, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, *, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised likelihood (L-BFGS); entries sorted by row.

    A threshold is the first one plus exponentials, which keeps them in order.
    """
    top, n = int(grades.max()), len(grades)
    back = np.argsort(columns, kind="stable")
    by_row = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    by_column = np.concatenate(([0], np.cumsum(np.bincount(columns, minlength=n_columns))))

    def sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[edges[1:]] - total[edges[:-1]]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = p[:n_columns], p[n_columns:]
        t = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
        z = sums(values * w[columns], by_row)
        # P(y = k) = s(z - t_k) - s(z - t_{k+1}), with t_0 = -inf and t_{K+1} = inf
        low = np.where(grades > 0, _sigmoid(z - t[np.maximum(grades, 1) - 1]), 1.0)
        high = np.where(grades < top, _sigmoid(z - t[np.minimum(grades, top - 1)]), 0.0)
        chance = np.maximum(low - high, 1e-12)
        slope_low, slope_high = low * (1 - low) / chance, high * (1 - high) / chance
        dz = -(slope_low - slope_high) / n
        dt = np.bincount(np.maximum(grades, 1) - 1, np.where(grades > 0, slope_low, 0), top) - np.bincount(np.minimum(grades, top - 1), np.where(grades < top, slope_high, 0), top)
        dt = np.cumsum((dt / n)[::-1])[::-1]
        dt[1:] *= np.exp(raw[1:])
        dw = sums((values * dz[rows])[back], by_column) + penalty / n * w
        return float(-np.log(chance).mean() + penalty / (2 * n) * (w @ w)), np.concatenate((dw, dt))

    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    p = np.concatenate((np.zeros(n_columns), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    value, slope = loss(p)
    held: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        step, scale = slope.copy(), []
        for s, y, r in reversed(held):
            scale.append(r * (s @ step))
            step -= scale[-1] * y
        if held:
            s, y, _ = held[-1]
            step *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(held, reversed(scale)):
            step += (a - r * (y @ step)) * s
        size = 1.0 if held else min(1.0, 1 / np.abs(slope).sum())
        while True:
            new_value, new_slope = loss(p - size * step)
            if new_value <= value - 1e-4 * size * (slope @ step) or size < 1e-10:
                break
            size /= 2
        s, y = -size * step, new_slope - slope
        if s @ y > 1e-12:
            held = [*held[-9:], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7
        p, value, slope = p + s, new_value, new_slope
        if done:
            break
    raw = p[n_columns:]
    return p[:n_columns], np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


def grades_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: of 0/1 ratings, 2 for good text, 1 for one fault (poor quality or
    toxic), 0 for both.  A null toxic counts as 0; rows with a null quality or doc_id are left out;
    of several ratings of a document the lowest counts."""
    grade = F.col("quality").cast("int") + 1 - F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.greatest(F.lit(0), F.least(F.lit(2), grade))).cast("int").alias("grade"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, at in chunks(batch.column("text")):
            found = list(features(data, at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    batch.column("grade").slice(low, high - low),
                    pa.array([s for s, _ in found], pa.list_(pa.int64())),
                    pa.array([v for _, v in found], pa.list_(pa.float32())),
                ],
                ["doc_id", "grade", "slots", "values"],
            )


def train(spark: SparkSession, docs: DataFrame, ratings: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` rated documents, whole texts, chosen by a hash of their ids.

    ``ratings`` has (doc_id, grade).  Of several texts of one id the first by order counts.  None if no
    rated document is there, or all have one grade.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # rows of two integers
    rated = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text for each rated id, so that the sample bounds what the driver reads; two passes read it
    rated = materialize(spark, rated.groupBy("doc_id", "grade").agg(F.min("text").alias("text")), "quality-rated")
    found = rated.mapInArrow(_extract, "doc_id long, grade int, slots array<long>, values array<float>")
    overall = chosen.agg(F.avg("grade").alias("mean"), F.stddev_pop("grade").alias("spread")).first()
    if not overall["spread"]:
        discard(spark, rated)
        return None
    slot = found.select(F.explode("slots").alias("slot"), "grade").groupBy("slot").agg(F.count("*").alias("n"), F.avg("grade").alias("mean")).where(F.col("n") >= LEAST_TEXTS)
    told = slot.withColumn("score", F.abs(F.col("mean") - overall["mean"]) * F.sqrt("n") / overall["spread"]).where(F.col("score") >= LEAST_SCORE)
    slots = np.array(sorted(r["slot"] for r in told.select("slot").collect()), np.int64)  # at most the sample's features
    known = spark.sparkContext.broadcast(slots)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _extract(batches):
            columns, values = [], []
            for s, v in zip(batch.column("slots"), batch.column("values")):
                own = s.values.to_numpy()
                if not len(known.value):
                    columns.append(b"")
                    values.append(b"")
                    continue
                at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
                hit = known.value[at] == own
                columns.append(at[hit].astype(np.int32).tobytes())
                values.append(v.values.to_numpy()[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "grade", "columns", "values"])

    rows = sorted(rated.mapInArrow(kept, "doc_id long, grade int, columns binary, values binary").collect(), key=lambda r: r["doc_id"])
    discard(spark, rated)
    grades = np.array([r["grade"] for r in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return None  # ratings of documents that aren't there
    steps = {g: k for k, g in enumerate(sorted(set(grades.tolist())))}  # grades that no text has need no threshold
    columns = [np.frombuffer(r["columns"], np.int32) for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    weights, thresholds = fit(
        at, np.concatenate(columns).astype(np.int64), np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]).astype(float), np.array([steps[g] for g in grades.tolist()]), len(slots)
    )
    used = np.abs(weights) > 1e-9
    full = np.concatenate([[thresholds[sum(1 for g in steps if g < k) - 1] if any(g < k for g in steps) else -np.inf] for k in range(1, max(steps) + 1)])
    return Model(slots[used], weights[used], full)


def score(docs: DataFrame, model: Model | None, *, top: int = 2, least: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tails, kept)`` of each whole text.

    ``tails`` holds P(grade >= k) for k = 1 to ``top``; a document is kept if the last is ``least``
    or more.  A null or empty text has no features and is judged by the thresholds alone.
    Without a model nothing is known: the grade and tails are null and everything is kept.
    Repeated rows, null doc_ids, other columns and empty tables need no care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in chunks(batch.column("text")):
                if model is None:
                    tails = [None] * (high - low)
                else:
                    found = [model.tails(*f) for f in features(data, at)]
                    tails = [np.concatenate((t, np.zeros(max(0, top - len(t)))))[:top].tolist() for t in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([None if t is None else sum(t) for t in tails], pa.float64()),
                        pa.array(tails, pa.list_(pa.float64())),
                        pa.array([t is None or t[-1] >= least for t in tails], pa.bool_()),
                    ],
                    ["doc_id", "expected_grade", "tails", "kept"],
                )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, kept boolean")


def select(docs: DataFrame, model: Model | None, *, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``score`` keeps; nothing is shuffled."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            if model is None:
                yield batch
                continue
            at = [k for k, c in enumerate(names) if c.lower() == "text"][0]
            for low, high, data, offsets in chunks(batch.column(at)):
                keep = pa.array([bool(model.tails(*f)[-1] >= least) for f in features(data, offsets)], pa.bool_())
                yield batch.slice(low, high - low).filter(keep)

    return docs.mapInArrow(run, docs.schema)
