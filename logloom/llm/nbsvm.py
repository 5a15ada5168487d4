"""Quality classifier: linear model over n-gram indicators scaled by naive
Bayes log-count ratios (support vector machine with naive Bayes features),
fitted by dual coordinate descent on the hinge loss, scores by a logistic
curve through out-of-fold margins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import arrow_map, sample_by_hash
from logloom.llm.features import indicators
from logloom.session import ship_package

BITS = 18


@dataclass
class Model:
    weights: np.ndarray  # per feature: ratio times hinge weight
    ratios: np.ndarray   # log-count ratio per feature
    bias: float
    slope: float
    shift: float
    bits: int

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.full(len(rows), self.bias)
        if sizes.sum():
            full = sizes > 0
            flat = np.concatenate(rows)
            first = (np.cumsum(sizes) - sizes)[full]
            dot = np.add.reduceat(self.weights[flat], first)
            square = np.add.reduceat(self.ratios[flat] ** 2, first)
            out[full] += dot / np.sqrt(np.maximum(square, 1e-12))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of positives that have a feature) / (share of negatives)."""
    counts = np.full((2, size), smooth)
    for found, label in zip(rows, y):
        counts[int(label > 0), found] += 1
    return np.log((counts[1] / (counts[1].sum())) / (counts[0] / counts[0].sum()))


def hinge_dual(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float, epochs: int,
               seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, costs
    balanced by class; the bias is a constant feature."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    upper = np.array([c * len(y) / (2 * share[int(s)]) for s in y])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _fit_once(rows, y, size, c, epochs):
    ratios = log_count_ratios(rows, y, size)
    values = []
    for found in rows:
        v = ratios[found]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm else v)
    w, bias = hinge_dual(rows, values, y, size, c, epochs)
    return w * ratios, ratios, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by
    Newton steps with smoothed targets; never falling."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum(), d.sum()])
        m = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()],
                      [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return max(a, 1e-6), b


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, c: float = 1.0, epochs: int = 12,
        folds: int = 3) -> Model:
    """``y``: +1 or -1.  Without rows of both classes every score is the
    share of positives (0.5 without rows)."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        z = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, z, bits)
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        kept = np.flatnonzero(fold != k)
        weights, ratios, bias = _fit_once([rows[i] for i in kept], y[kept], size, c, epochs)
        part = Model(weights, ratios, bias, 1.0, 0.0, bits)
        margins[fold == k] = part.margins([rows[i] for i in np.flatnonzero(fold == k)])
    slope, shift = _logistic(margins, y)
    weights, ratios, bias = _fit_once(rows, y, size, c, epochs)
    return Model(weights, ratios, bias, slope, shift, bits)


#: Labelled rows that a model is fitted on at most.  The task that fits holds
#: their distinct features, at most 2**bits numbers a row; the driver holds the
#: model only.
TRAIN_ROWS = 4000
_MODEL = "weights binary, ratios binary, bias double, slope double, shift double"


def _fitted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The model of all rows (doc_id, label, found) of a task, as one row."""
    ids, y, rows = [], [], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        y.append(batch.column(1).to_numpy())
        flat, off = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
        rows += [flat[a - off[0]:b - off[0]] for a, b in zip(off[:-1], off[1:])]
    order = np.argsort(np.concatenate(ids), kind="stable") if rows else []
    y = np.concatenate(y)[order] if rows else np.zeros(0, np.int64)
    m = fit([rows[i] for i in order], np.where(y > 0, 1, -1), bits)
    yield pa.RecordBatch.from_arrays(
        [pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.ratios.tobytes()], pa.binary()),
         *[pa.array([float(x)]) for x in (m.bias, m.slope, m.shift)]], ["weights", "ratios", "bias", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on the documents whose ``labels`` row (doc_id, ``label`` 1 or 0) is
    among the ``max_rows`` lowest by hash of doc_id.

    Null labels and ids and other label values are left out; a doc_id with
    both labels counts as 0; one of several texts of a doc_id (the least) is
    taken; null texts are empty.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label"))
    marked = sample_by_hash(marked, "doc_id", max_rows)  # bounded by max_rows: safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array(indicators(batch.column(2), bits), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "label", "found"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fitted(batches, bits)

    found = arrow_map(texts, run, "doc_id bigint, label int, found array<int>")
    ship_package(docs.sparkSession)
    got = found.repartition(1).mapInArrow(one, _MODEL).toArrow()  # at most max_rows rows meet
    if not got.num_rows:  # no partition, no task
        return fit([], np.zeros(0, np.int64), bits)
    weights, ratios = (np.frombuffer(got.column(k)[0].as_py(), np.float64) for k in (0, 1))
    return Model(weights, ratios, *(got.column(k)[0].as_py() for k in (2, 3, 4)), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row: 0 to 1, higher: label 1 likelier.  Every text
    is scored whole; null and empty texts get the model's base score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(m.scores(indicators(batch.column(1), m.bits)))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return batch.filter(pa.array(m.scores(indicators(batch.column(at), m.bits)) >= threshold))

    return arrow_map(docs, run, docs.schema)
