"""Operator 1: quality classifier, naive Bayes support vectors (NB-SVM).

Method: a text is a set of n-gram indicators: its byte trigrams, hashed to 2**``BITS``
buckets, and how often it repeats neighbouring words and three-word windows, in eighths.
Indicators are scaled by the class log-count ratio ``r`` of the labelled training rows and
the rows brought to unit length; a linear hinge-loss model on them is fitted by dual
coordinate descent. A sigmoid fitted on rows that the descent did not see turns margins
into scores.

What is learned from what: the log-count ratios count *all* labelled training rows. The
descent uses a bounded sample, the ``fit_rows`` rows with the smallest hash of id and text, of
which every fourth is left for the sigmoid. Rows whose crc32(doc_id as text) mod 3 is 1
take part in neither.

Plan: training texts are joined with their labels once and stored; counts are summed per
task, then per bucket; the sample is found by a threshold on the hash, so only its own
rows are gathered; scoring is one pass over the table with the broadcast model (two
numbers a bucket, a fixed size).

Defined results: null and empty texts have no indicators and get the score of the margin
zero; without training rows, or with one class only, every score is the share of label 1
(0.5 without rows); contradictory labels of one id are left out; null and repeated ids
are scored row by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts

BITS = 18
EXTRA = 18  # buckets of the repetition indicators
SIZE = (1 << BITS) + EXTRA


def indicators(text: str) -> np.ndarray:
    """Sorted distinct buckets of one whole text."""
    body = text.encode()
    raw = np.frombuffer(body, np.uint8)
    if len(raw) == 0:
        return np.empty(0, np.int64)
    seen = np.zeros(SIZE, bool)
    for at in range(0, max(1, len(raw) - 2), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(b) > 2:
            grams = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            seen[(grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = body.split()
    if len(words) > 2:
        pairs = len(words) - 1
        same = sum(map(bytes.__eq__, words, words[1:]))
        windows = pairs - 1
        again = windows - len(set(zip(words, words[1:], words[2:])))
        base = 1 << BITS
        seen[base + (1 + 7 * same // pairs if same else 0)] = True
        seen[base + 9 + (1 + 7 * again // windows if again else 0)] = True
    return np.flatnonzero(seen)


def _is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
    )
    rows = texts(docs, id_col, text_col).where(~_is_held_out(F.col("doc_id")))
    joined = rows.join(known.hint("merge"), "doc_id")
    return joined.select("doc_id", "label", "text", F.xxhash64("doc_id", "text").alias("draw"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
    for batch in slices(batches):
        for label, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts[label, indicators(text)] += 1
            rows[label] += 1
    used = np.flatnonzero(counts.any(axis=0))
    bucket = np.concatenate([used, [-1]])  # bucket -1: the rows themselves
    columns = [np.concatenate([counts[k, used], [rows[k]]]) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket), *map(pa.array, columns)], names=["bucket", "bad", "good"]
    )


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [indicators(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.binary())],
            names=["draw", "label", "buckets"],
        )


class Model:
    """``weight`` and squared log-count ratio ``square`` per bucket, bias and sigmoid."""

    def __init__(self, weight, square, bias: float, slope: float, shift: float):
        self.weight, self.square = weight.astype(np.float32), square.astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.square[found].sum(dtype=np.float64)) ** 0.5
        inner = float(self.weight[found].sum(dtype=np.float64)) / norm if norm > 0 else 0.0
        return inner + self.bias

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratio(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    good, bad = good + 1.0, bad + 1.0
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, cost: float = 1.0, epochs: int = 20
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; ``y`` is -1 or 1; returns w and the bias.

    Each coordinate is set to its optimum within [0, cost]; the bias is a constant feature.
    """
    values = [ratio[x] / (np.linalg.norm(ratio[x]) or 1.0) for x in rows]
    diagonal = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / diagonal[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps on smoothed targets (Platt scaling)."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * margins + shift)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ margins, d.sum()])
        hess = np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        size = np.abs(step).max()
        slope, shift = np.array([slope, shift]) - step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(slope), float(shift)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    fit_rows: int = 8192,
    cost: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Train; ``fit_rows`` bounds the sample of the descent (and what the driver gathers)."""
    rows = stored(training_rows(docs, labels, id_col, text_col), "quality-training")
    counted = (
        rows.select("label", "text")
        .mapInArrow(_count, "bucket long, bad long, good long")
        .groupBy("bucket")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toArrow()
    )
    bucket, bad, good = (counted[n].to_numpy() for n in ("bucket", "bad", "good"))
    by_class = np.zeros((2, SIZE))
    there = bucket >= 0
    by_class[:, bucket[there]] = bad[there], good[there]
    n_bad, n_good = (int(x[~there].sum()) for x in (bad, good))
    if not n_bad or not n_good:
        share = (n_good / (n_bad + n_good)) if n_bad + n_good else 0.5
        odds = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, odds)
    ratio = log_count_ratio(*by_class)
    draws = rows.select("draw").orderBy("draw").limit(fit_rows)
    last = draws.agg(F.max("draw")).first()[0]
    picked = (
        rows.where(F.col("draw") <= last)
        .select("draw", "label", "text")
        .mapInArrow(_sample, "draw long, label int, buckets binary")
        .orderBy("draw", "label", "buckets")  # rows that repeat share a draw
        .limit(fit_rows)
        .toArrow()
        .sort_by([("draw", "ascending"), ("label", "ascending"), ("buckets", "ascending")])
    )
    found = [np.frombuffer(b, "<i4") for b in picked["buckets"].to_pylist()]
    label = picked["label"].to_numpy()
    aside = np.arange(len(found)) % 4 == 3
    if len(set(label[~aside])) < 2 or not aside.any():
        aside[:] = False
    learn = np.flatnonzero(~aside)
    y = np.where(label[learn] > 0, 1.0, -1.0)
    w, bias = descend([found[i] for i in learn], y, ratio, cost=cost)
    model = Model(w * ratio, ratio**2, bias, 1.0, 0.0)
    test = np.flatnonzero(aside) if aside.any() else learn
    margins = np.array([model.margin(found[i]) for i in test])
    model.slope, model.shift = sigmoid_fit(margins, label[test].astype(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"):
    """Every row: ``doc_id, held_out, score, predicted``."""
    parts = (model.weight, model.square, model.bias, model.slope, model.shift)
    shipped = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for batch in slices(batches):
            scores = [model.score(indicators(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = texts(docs, id_col, text_col)
    return rows.select("doc_id", _is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
