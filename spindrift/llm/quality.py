"""Quality classifier: a linear SVM over naive-Bayes scaled n-gram indicators.

A text's n-grams are runs of three bytes and runs of one to three word shapes (letter case,
punctuation, length, whether the word repeats the one before), hashed to 2^BITS indicators.  Each
indicator is scaled by the log ratio of its smoothed class counts; a hinge-loss linear model is
fitted to the scaled, length-normalised vectors by dual coordinate descent; a sigmoid fitted to
margins of rows that the margin model has not seen gives a score in (0, 1).

The model is fitted on at most ``rows`` labelled rows (TRAIN_ROWS), the first by a hash of their
id.  Scoring reads every whole text.

Edge cases: null and empty texts have no n-grams and get the score of the bias alone; rows whose
label is null or whose document is missing are no training rows; with no training rows, or with
one class only, every score is the share of label 1 (0.5 without rows); rows that repeat are
scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import hashing

BITS = 18
#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 6000
SEED = 11
#: Smoothing of the class counts; cost of a margin violation; passes over the rows.
ALPHA, COST, EPOCHS = 1.0, 4.0, 12
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """Byte classes: 0 lower-case letter or other byte, 1 upper-case, 2 digit, 3 punctuation."""
    kind = np.zeros(256, dtype=np.int64)
    kind[65:91], kind[48:58] = 1, 2
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    return kind


KIND = _kinds()


def ngram_indicators(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct indicators, sorted."""
    grams, at = [], []
    n = len(data)
    if n >= 3:
        b = data.astype(np.uint64)
        code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        grams.append(code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
        at.append((offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])))
    hashes, starts, ends, first = hashing.words(data, offsets)
    if len(hashes):
        counts = [np.concatenate([[0], np.cumsum(KIND[data] == k)]) for k in (1, 2, 3)]
        upper, digit, punct = [np.minimum(c[ends] - c[starts], 3) for c in counts]
        size = np.minimum(np.log2(ends - starts + 1).astype(np.int64), 5)
        same = np.zeros(len(hashes), dtype=np.int64)
        same[1:] = hashes[1:] == hashes[:-1]
        last = KIND[data[ends - 1]]
        shape = (((((upper * 4 + digit) * 4 + punct) * 6 + size) * 2 + same) * 4 + last).astype(np.uint64) + np.uint64(1)
        for width in (1, 2, 3):
            m = len(shape) - width + 1
            if m <= 0:
                break
            code = np.full(m, width, dtype=np.uint64)
            for i in range(width):
                code = hashing.mix(code + shape[i : i + m])
            grams.append(code >> np.uint64(64 - BITS))
            at.append((first[:-1], np.maximum(first[1:] - width + 1, first[:-1])))
    out = []
    for i in range(len(offsets) - 1):
        parts = [g[s[i] : e[i]] for g, (s, e) in zip(grams, at, strict=True)]
        out.append(np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, dtype=np.int64))
    return out


def fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


class Model:
    """Weights by indicator, bias, and the sigmoid over margins."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weights[grams].sum() / np.sqrt(len(grams)) + self.bias) if len(grams) else self.bias

    def score(self, grams: np.ndarray) -> float:
        z = self.slope * self.margin(grams) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    up, down = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    for grams, label in zip(rows, y, strict=True):
        (up if label > 0 else down)[grams] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (by indicator, scaled) and bias of the hinge-loss SVM; the bias is one more input, always 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    scaled = [ratio[g] / np.sqrt(max(1, len(g))) for g in rows]
    square = np.array([float(s @ s) + 1.0 for s in scaled])
    alpha = np.zeros(len(rows))
    # The classes weigh the same together.
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    random = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in random.permutation(len(rows)):
            g, s = rows[i], scaled[i]
            slack = y[i] * (float(w[g] @ s) + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[g] += step * s
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the smoothed-target logistic fit, by Newton steps."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        inside = np.flatnonzero(part != k)
        if len(set(y[inside].tolist())) < 2:
            inside = np.arange(len(y))
        own = [rows[i] for i in inside]
        w, b = dual_descent(own, y[inside], log_count_ratio(own, y[inside]))
        m = Model(w, b, 1, 0)
        for i in np.flatnonzero(part == k):
            margins[i] = m.margin(rows[i])
    slope, shift = sigmoid_fit(margins, y)
    w, b = dual_descent(rows, y, log_count_ratio(rows, y))
    return Model(w, b, slope, shift)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = hashing.buffers(batch.column("text"))
        for a, b in hashing.chunks(offsets):
            grams = ngram_indicators(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array([g.astype(np.int32) for g in grams], pa.list_(pa.int32()))], names=["doc_id", "label", "grams"]
            )


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows whose fold is not 0, at most ``rows`` of them."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("quality").cast("int").alias("label"))
    picked = usable.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    # ``picked`` has ``rows`` rows at most, so it can be sent to every task.
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = texts.select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, label int, grams array<int>").toArrow().combine_chunks()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    label = got.column("label").to_numpy()
    # Views of the Arrow buffers: no Python object for a number.
    views: list[np.ndarray] = []
    for chunk in got.column("grams").chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        views += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return fit([views[i] for i in order], label[order])


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, then the columns in ``keep`` (one of these names there is an error)."""
    if clash := {"doc_id", "held_out", "score", "predicted"} & set(keep):
        raise ValueError(f"keep names output columns: {sorted(clash)}")
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column("text_"))
            scores: list[float] = []
            for a, b in hashing.chunks(offsets):
                scores += [m.score(g) for g in ngram_indicators(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    texts = documents.select(*names, F.col("text").cast("string").alias("text_"))
    kinds = dict(texts.dtypes)
    scored = texts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *keep)
