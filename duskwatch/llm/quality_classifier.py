"""Quality classifier: naive Bayes support vectors.

N-gram indicators (words and word pairs, hashed) are scaled by the log-count ratio of the two classes,
then a linear hinge loss is fitted by dual coordinate descent in numpy on all labelled rows: on more than
``SAMPLE`` in shards, whose weights are averaged. Scoring runs in Spark tasks over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import answer, at_cut, best_cut, collected, counted, fitted_by_shard, hashed, scored, training_shards
from .store import discard, documents
from .words import shingle_hashes

#: Labelled rows of one shard, so that a task's memory doesn't grow with the corpus; all rows take part.
SAMPLE = 4000
BUCKETS = 1 << 18
FOLDS, HELD_OUT = 5, 0


def indicators(words: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams (n = 1, 2) of each row: bucket ids by row, and each row's first place (n_rows + 1)."""
    pair, where = shingle_hashes(words, rows, 2, short=False)
    same = pair[:0], where[:0]
    if len(words) > 1:  # pairs of the same word twice share one bucket more
        i = np.flatnonzero((rows[:-1] == rows[1:]) & (words[:-1] == words[1:]))
        same = np.full(len(i), 7, np.uint64), rows[i]
    ids = np.concatenate([words % np.uint64(BUCKETS), pair % np.uint64(BUCKETS), same[0]]).astype(np.int64)
    key = np.unique(np.concatenate([rows, where, same[1]]) * BUCKETS + ids)
    return key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(n_rows + 1))


class Model:
    """Weights by bucket, with a logistic map of the margin and the threshold that becomes 0.3."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float, cut: float):
        self.weights, self.bias, self.slope, self.shift, self.cut = weights.astype(np.float32), bias, slope, shift, cut

    def margins(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        ids, at = indicators(words, rows, n_rows)
        sums = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
        length = np.maximum(np.diff(at), 1)
        return (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(length) + self.bias

    def score(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        raw = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(words, rows, n_rows) + self.shift, -50, 50)))
        return at_cut(raw, self.cut)


def log_count_ratio(ids: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log of (share of the bucket in class 1) / (share in class 0), counts smoothed by one."""
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    return _ratio(np.bincount(ids[y[doc] > 0], minlength=BUCKETS), np.bincount(ids[y[doc] == 0], minlength=BUCKETS))


def _ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = p + 1.0, q + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    return np.where(p + q > 3, ratio, 0.0)  # a bucket of one document says nothing about others


def dual_coordinate_descent(ids: np.ndarray, at: np.ndarray, ratio: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 norm: updates one dual variable at a time, 0 <= a <= c by class weight."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = c * np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    w, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(11)
    scale = 1 / np.sqrt(np.maximum(np.diff(at), 1))
    norm = np.array([scale[i] ** 2 * np.square(ratio[ids[at[i] : at[i + 1]]]).sum() for i in range(len(y))]) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            own = ids[at[i] : at[i + 1]]
            x = ratio[own] * scale[i]
            gradient = sign[i] * (w[own] @ x + bias) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), weight[i])
            if new != dual[i]:
                w[own] += (new - dual[i]) * sign[i] * x
                bias += (new - dual[i]) * sign[i]
                dual[i] = new
    return w * ratio, bias


def _logistic(margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map by Newton steps on smoothed targets; each margin stands for ``n`` rows."""
    n1, n0 = (y * n).sum(), ((1 - y) * n).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * n * margin).sum() + 1e-3 * (a - 1), ((p - target) * n).sum()])
        v = n * (p * (1 - p) + 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Fit on four fifths of the sample, set the logistic map and the threshold on the fifth part.

    Without examples of both classes every text scores the same: the share of class 1, or 0.5.
    """
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 4.0 if len(y) and y.mean() == 1 else -4.0 if len(y) else 0.0, 0.3)
    part = np.arange(len(y)) % 5 == 4
    sets = []
    for chosen in (~part, part):
        own = [t for t, c in zip(texts, chosen, strict=True) if c]
        sets.append((*hashed(own), len(own), y[chosen]))
    words, rows, n, own = sets[0]
    ids, at = indicators(words, rows, n)
    ratio = log_count_ratio(ids, at, own)
    weights, bias = dual_coordinate_descent(ids, at, ratio, own)
    model = Model(weights, bias, 1.0, 0.0, 0.3)
    words, rows, n, own = sets[1]
    margin = model.margins(words, rows, n)
    _calibrate(model, margin, own, np.ones(n))
    return model


def _calibrate(model: Model, margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    if 0 < (y * n).sum() < n.sum():
        model.slope, model.shift = _logistic(margin, y, n)
        model.cut = best_cut(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -50, 50))), y, n)


def fit_by_shard(rows: DataFrame) -> Model:
    """As ``fit``, over any number of ``training_shards``: n-grams are counted over all, each shard gives weights, and their mean counts."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                y, texts = (c.to_pylist() for c in batch.slice(i, 64).columns)
                ids, at = indicators(*hashed(texts), len(texts))
                label = np.repeat(np.array(y), np.diff(at))
                for k in (0, 1):
                    held[k] += np.bincount(ids[label == k], minlength=BUCKETS)
        some = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[0][some]), pa.array(held[1][some])], ["bucket", "q", "p"])

    learn = rows.where("NOT test")
    c = learn.select("y", "text").mapInArrow(counts, "bucket long, q long, p long").groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).toPandas()  # a row for each bucket
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    p[c["bucket"]], q[c["bucket"]] = c["p"], c["q"]
    ratio = _ratio(p, q)

    def one(texts: list[str], y: np.ndarray) -> np.ndarray:
        weights, bias = dual_coordinate_descent(*indicators(*hashed(texts), len(texts)), ratio, y)
        return np.append(weights, bias)

    mean = fitted_by_shard(learn, one)
    model = Model(mean[:-1], float(mean[-1]), 1.0, 0.0, 0.3)
    _, margin, y, count = counted(rows.where("test"), lambda texts: (np.zeros(len(texts), np.int64), model.margins(*hashed(texts), len(texts))))
    _calibrate(model, margin, y, count)
    return model


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model of all labelled rows: those of one shard are fitted at once, more of them in tasks."""
    rows = training_shards(docs, labels, "quality", FOLDS, HELD_OUT, size)
    n, positive = rows.selectExpr("count(*)", "coalesce(sum(y), 0)").first()
    if n <= size:
        model = fit(*collected(rows))
    else:
        model = fit_by_shard(rows) if 0 < positive < n else fit([], np.array([float(positive > 0)]))
    discard(rows)
    return model


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts score like a text without any n-gram. Repeated rows give repeated rows, null
    ids stay null, an empty table gives an empty table; columns other than doc_id and text are not read. A very
    long text is scored whole; a score just at the threshold becomes 0.3.
    """
    model = fitted(docs, labels, sample)
    return answer(scored(docs, model.score, 2 << 20), FOLDS, HELD_OUT)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its quality, whether it was held out of training, and the prediction at 0.3, as in ``classify``.

    Empty texts score as one without any n-gram; repeated rows give repeated rows; null ids stay null and count as held out;
    an empty table gives an empty one; a very long text is scored whole; scores equal to the threshold are predicted 1.
    """
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
