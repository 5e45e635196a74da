"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is 0 (toxic), 1 (poor) or 2 (good).  One weight vector over hashed text features
is shared by all thresholds: P(rating <= k) = sigmoid(threshold_k - score), thresholds in
order.  ``expected_grade`` is the mean rating, ``p_tail`` the probability of the top one;
a document is ``selected`` from ``min_tail`` on.

Features are the distinct lower-cased words of a text and bits of its shape (shares of
capitals and symbols, repetition), hashed into ``2 ** BITS`` weights; only features that
``min_df`` sampled documents have, and whose share of some rating is off by ``min_z``
standard errors, are fitted, so the many words that say nothing add no noise.  Fitted on a
bounded sample (``max_train_docs`` documents, half of them with the top rating at most, and
``max_train_features`` features, in hash order; a document that no longer fits is left out);
all documents are scored, over whole texts.

Defined results: null and wordless texts score by the thresholds alone; rows of labels
with a null part are not used, of several different ones for one document each counts; of
rated rows of one id the least text is trained on; without labels of two ratings at least,
weights are 0 and thresholds those of equal shares; repeated rows give a row each; a null id
is an id; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import collected_within, map_batches

BITS, GRADES = 20, 3
_SYMBOL = T._lut(lambda b: chr(b) in "#*$%&|<>")
_UPPER = T._lut(lambda b: 0x41 <= b <= 0x5A)
_SHAPES = T.mix(np.arange(1, 17, dtype=np.uint64)) >> np.uint64(64 - BITS)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a block, each pair once, in order."""
    w = T.Words(data, offs, T.ALNUM, True)
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)

    def share(mask):
        s = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=s[1:])
        return (s[offs[1:]] - s[offs[:-1]]) / size

    at, h = w.windows(5)
    _, twice = T.repeated(w.row[at], h)
    again = np.bincount(w.row[at[twice]], minlength=n) / np.maximum(w.counts, 1)
    upper, symbol = share(_UPPER[data]), share(_SYMBOL[data])
    shapes = [upper > 0.1, upper > 0.3, symbol > 0.005, symbol > 0.03, again > 0.05, again > 0.3, w.counts == 0, w.counts < 20, w.counts < 100]
    rows = [w.row, *(np.flatnonzero(s) for s in shapes)]
    feats = [w.hash >> np.uint64(64 - BITS), *(np.full(len(r), _SHAPES[i], np.uint64) for i, r in enumerate(rows[1:]))]
    pair = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(feats))
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), np.asarray(thresholds, float)

    def grades(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Probability of every rating for each row."""
        score = np.bincount(row, self.weights[feature], rows)
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate((np.zeros((rows, 1)), below, np.ones((rows, 1))), axis=1), axis=1)


def associations(y: np.ndarray, row: np.ndarray, feature: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Of each feature, the most standard errors by which the share of a rating among its documents is off."""
    z = np.zeros(1 << BITS)
    for k in range(GRADES):
        share = np.clip((y == k).mean(), 1e-6, 1 - 1e-6)
        seen = np.bincount(feature, y[row] == k, 1 << BITS)
        z = np.maximum(z, np.abs(seen - share * df) / np.sqrt(np.maximum(share * (1 - share) * df, 0.05)))
    return z


def fit(y: np.ndarray, row: np.ndarray, feature: np.ndarray, min_df: int = 5, min_z: float = 4.5, steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Maximum likelihood with L2 by Adam; thresholds are a first one and positive steps."""
    weights = np.zeros(1 << BITS)
    share = np.clip(np.array([(y <= k).mean() if len(y) else (k + 1) / GRADES for k in range(GRADES - 1)]), 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(weights, start)
    df = np.bincount(feature, minlength=1 << BITS)
    used = np.flatnonzero((df >= min_df) & (associations(y, row, feature, df) >= min_z))
    column = np.full(1 << BITS, -1)
    column[used] = np.arange(len(used))
    ok = column[feature] >= 0
    row, col = row[ok], column[feature][ok]
    n = len(y)
    scale = np.sqrt(np.log((1 + n) / df[used]))  # a feature of all documents says nothing
    theta = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    grade_weight = np.sqrt(n / (GRADES * np.maximum(np.bincount(y, minlength=GRADES), 1)))[y]
    for step in range(1, steps + 1):
        w, cut = theta[: len(used)] * scale, np.cumsum(np.concatenate((theta[len(used) : len(used) + 1], np.exp(theta[len(used) + 1 :]))))
        score = np.bincount(row, w[col], n)
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        up, low = _sigmoid(edge[y + 1] - score), _sigmoid(edge[y] - score)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_score = grade_weight * (d_low - d_up)
        grad = np.zeros_like(theta)
        grad[: len(used)] = np.bincount(col, g_score[row], len(used)) * scale
        g_cut = np.array([(grade_weight * (d_up * (y == k) - d_low * (y == k + 1))).sum() for k in range(GRADES - 1)])
        grad[len(used)] = g_cut.sum()
        for k in range(1, GRADES - 1):
            grad[len(used) + k] = g_cut[k:].sum() * np.exp(theta[len(used) + k])
        grad /= n
        grad[: len(used)] -= l2 * theta[: len(used)]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = theta[: len(used)] * scale
    return Model(weights, np.cumsum(np.concatenate((theta[len(used) : len(used) + 1], np.exp(theta[len(used) + 1 :])))))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


class _Sampled:
    def __call__(self, batches):
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                row, feature = features(data, offs)
                edge = np.searchsorted(row, np.arange(r1 - r0 + 1))
                packed = [feature[a:z].astype(np.int32).tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], T.column(b, "grade")[r0:r1].cast(pa.int32()), pa.array(np.diff(edge)), pa.array(packed, pa.binary())], ["doc_id", "grade", "n", "features"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train_docs: int = 6000, max_train_features: int = 20_000_000) -> Model:
    rated = ratings(labels).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("grade")]
    top, rest = (rated.where(c).orderBy(*order).limit(max_train_docs // 2) for c in ("grade = 2", "grade < 2"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = docs.join(F.broadcast(top.unionByName(rest)), "doc_id")  # bounded by max_train_docs
    sample = sample.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = collected_within(map_batches(sample, _Sampled(), "doc_id long, grade int, n long, features binary"), "doc_id", "grade", "n", max_train_features)
    rows.sort(key=lambda r: (r.doc_id, r.grade))
    parts = [np.frombuffer(r.features, np.int32) for r in rows]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.array([r.grade for r in rows], np.int64), row, np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64))


GRADED = "doc_id long, expected_grade double, p_tail double, p_toxic double, selected boolean"


class _Grade:
    def __init__(self, model, min_tail):
        self.model, self.min_tail = model, min_tail

    def __call__(self, batches):
        m = self.model.value
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                p = m.grades(*features(data, offs), r1 - r0)
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], *map(pa.array, (p @ np.arange(GRADES), p[:, -1], p[:, 0], p[:, -1] >= self.min_tail))], ["doc_id", "expected_grade", "p_tail", "p_toxic", "selected"])


def grade(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", min_tail: float = 0.5) -> DataFrame:
    """One row for each document: expected grade, probability of the top grade, of the lowest, selection."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Grade(docs.sparkSession.sparkContext.broadcast(model), min_tail), GRADED)
