"""Operator 2: quality classifier, naive Bayes support vectors.

A text becomes the set of its hashed 1- and 2-grams of tokens (runs of letters and digits, runs of other signs,
line ends; the share of tokens that repeat their predecessor is one more). Each indicator is scaled by the log ratio of its smoothed frequencies in good and bad texts; rows are
set to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve on margins
of rows that the fit did not see turns margins into a score in 0..1.

The fit uses at most `rows` labelled texts (default TRAIN_ROWS) of at most MAX_BYTES together, one an id, without ids whose labels conflict; scoring covers every text, map-side, with a weight vector of fixed size.
Null and empty texts have no n-grams and get the score of margin bias. With no labels of a kind every score is the
share of good labels (0.5 without any). Other columns play no part; repeated rows give repeated rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import labelled
from ledgerloom.llm.common import flat, gram_hashes, slices, word_hashes
from ledgerloom.shipping import ship

TRAIN_ROWS, BITS = 12_000, 18

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 3
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct hashed 1- and 2-grams of each text, in order."""
    data, offsets = flat(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    new = np.empty(len(data), bool)
    new[0] = True
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    used = kind[starts] != 0
    starts, ends = starts[used], ends[used]
    row = np.searchsorted(offsets, starts, "right") - 1
    h = word_hashes(data, starts, ends)
    pair = gram_hashes(h, 2)
    same = row[1:] == row[:-1]
    key = np.concatenate([(row << bits) | (h >> np.uint64(64 - bits)).astype(np.int64), (row[:-1][same] << bits) | (pair[same] >> np.uint64(64 - bits)).astype(np.int64)])
    # a token that repeats the one before is a 2-gram of its own kind: one indicator for its share in eighths
    n = np.bincount(row, minlength=len(column))
    twice = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=len(column))
    some = np.flatnonzero(twice)
    key = np.concatenate([key, (some << bits) | (twice[some] * 8 // n[some])])
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)


class Model:
    """weights: hinge-loss weights times log-count ratios, for rows of unit length of `ratio`."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.ratio = np.zeros(1 << bits, np.float32)
        self.weights = np.zeros(1 << bits, np.float32)
        self.bias, self.slope, self.shift = 0.0, 0.0, 0.0

    def margins(self, column: pa.Array) -> np.ndarray:
        row, index = features(column, self.bits)
        n = len(column)
        size = np.sqrt(np.bincount(row, self.ratio[index].astype(np.float64) ** 2, n))
        return np.bincount(row, self.weights[index].astype(np.float64), n) / np.maximum(size, 1e-9) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -35, 35)))


def _descend(values, index, spans, y, size, c, epochs, seed=7):
    """Dual coordinate descent for the hinge loss over rows values[a:b], index[a:b]; the last entry of w is the bias. Returns w and the dual values."""
    w = np.zeros(size + 1, np.float64)
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([float(values[a:b] @ values[a:b]) + 1.0 for a, b in spans])
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(y)):
            a, b = spans[i]
            v, j = values[a:b], index[a:b]
            g = y[i] * (float(w[j] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
                w[j] += step * v
                w[-1] += step
        if worst < 1e-3 * c:
            break
    return w, alpha


def fit(row: np.ndarray, index: np.ndarray, y: np.ndarray, bits: int = BITS, c: float = 4.0, epochs: int = 12, smooth: float = 1.0) -> Model:
    """row, index: indicators of texts 0..len(y)-1 in order; y: 0/1. Every fifth text only calibrates."""
    m = Model(bits)
    good = float((y == 1).mean()) if len(y) else 0.5
    if len(y) < 10 or good in (0.0, 1.0):
        m.shift = float(np.log((good * len(y) + 1) / ((1 - good) * len(y) + 1)))
        return m
    learn = np.arange(len(y)) % 5 != 4
    size = 1 << bits
    p = smooth + np.bincount(index[learn[row] & (y[row] == 1)], minlength=size)
    q = smooth + np.bincount(index[learn[row] & (y[row] == 0)], minlength=size)
    m.ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    m.ratio[(p == smooth) & (q == smooth)] = 0
    values = m.ratio[index]
    length = np.sqrt(np.bincount(row, values * values, len(y)))
    values /= np.maximum(length, 1e-9).astype(np.float32)[row]
    starts = np.searchsorted(row, np.arange(len(y) + 1)).tolist()
    ids = np.flatnonzero(learn)
    w, _ = _descend(values, index, [(starts[i], starts[i + 1]) for i in ids.tolist()], np.where(y[ids] == 1, 1.0, -1.0), size, c, epochs)
    m.weights, m.bias = (w[:-1] * m.ratio).astype(np.float32), float(w[-1])
    margin = np.bincount(row, w[index] * values, len(y)) + w[-1]
    m.slope, m.shift = labelled.logistic(margin[~learn], y[~learn])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fits on at most `rows` labelled texts that are not held out; their hashed n-grams come to the driver."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, index = features(b["text"], bits)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["_id"], b["label"], pa.ListArray.from_arrays(at, pa.array(index.astype(np.int32)))], ["_id", "label", "grams"])

    some = labelled.sample(docs, labels, label, rows).repartition(16, "_id")
    found = some.mapInArrow(run, "_id long, label int, grams array<int>").toArrow().sort_by("_id")
    y = found["label"].to_numpy()
    grams = found["grams"].combine_chunks() if len(found) else pa.array([], pa.list_(pa.int32()))
    del found
    sizes = np.diff(grams.offsets.to_numpy()) if len(grams) else np.zeros(0, np.int64)
    # 32-bit arrays, and no copies by row: the driver holds about 12 bytes an n-gram of the sample
    return fit(np.repeat(np.arange(len(y), dtype=np.int32), sizes), grams.flatten().to_numpy(), y, bits)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, mod: int = 5, held: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 where score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = shared.value.scores(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.remainder(F.col("doc_id"), mod) == held).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
