"""Toxicity: a convolutional text classifier in numpy.

Hashed word embeddings, filters over one to three words, max pooling over the whole text and a
logistic layer, trained with Adam on all labelled rows: on more than ``SAMPLE`` in shards, whose networks
are averaged after every pass. Thresholds are calibrated by language; the language is told from the text's own function words, never from a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .labelled import answer, at_cut, best_cut, collected, counted, fitted_by_shard, hashed, scored, training_shards
from .store import discard, documents

#: Labelled rows of one shard, so that a task's memory doesn't grow with the corpus; all rows take part.
SAMPLE = 6000
BUCKETS = 1 << 15
#: Lengths in bytes of the beginnings of words that have embeddings of their own.
PREFIXES = (5, 7)
DIM, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
FOLDS, HELD_OUT = 4, 2

#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was with",
    "de": "der die das und ist nicht ein mit zu den",
    "fr": "le la les des et est dans pour une du",
    "es": "el los las que y en por con una del",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def _language_tables() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(h, k) for k, lang in enumerate(LANGUAGES) for h in hashed([FUNCTION_WORDS[lang]])[0].tolist()]
    pairs.sort()
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


def language(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the language with most function words in each row; the first of equals, also without any."""
    table, kind = _language_tables()
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    hit = table[at] == words
    votes = np.bincount(rows[hit] * len(LANGUAGES) + kind[at[hit]], minlength=n_rows * len(LANGUAGES))
    return votes.reshape(n_rows, -1).argmax(1)


class Network:
    """Parameters, and the pooled features of a batch of hashed texts.

    A word's embedding is the sum of those of its hash and of the hashes of its beginnings, so
    inflected and compound words share what they begin with.
    """

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.2, (BUCKETS, DIM)), "v": rng.normal(0, 0.1, FILTERS * len(WIDTHS)), "c": np.zeros(1)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.4 / np.sqrt(w), (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.cuts = np.full(len(LANGUAGES), 0.5)

    def pooled(self, ids: np.ndarray, rows: np.ndarray, n_rows: int, places: bool = False):
        """Pooled activations (n_rows, filters); with ``places``, also the word at which each maximum begins (-1: none)."""
        out = np.zeros((n_rows, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(out.shape, -1, np.int64)
        embedded = sum(self.p["E"][line] for line in ids)
        for j, w in enumerate(WIDTHS):
            m = len(rows) - w + 1
            if m <= 0:
                continue
            value = embedded[:m] @ self.p[f"W{w}"][0]
            for k in range(1, w):
                value += embedded[k : k + m] @ self.p[f"W{w}"][k]
            value += self.p[f"b{w}"]
            ok = np.flatnonzero(rows[:m] == rows[w - 1 :])
            if not len(ok):
                continue
            value, own = value[ok], rows[ok]
            begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            most = np.maximum.reduceat(value, begin, axis=0)
            span = slice(j * FILTERS, (j + 1) * FILTERS)
            out[own[begin], span] = np.maximum(most, 0)
            if places:
                end = np.append(begin[1:], len(own))
                for b, e in zip(begin, end, strict=True):
                    block = value[b:e]
                    at = block.argmax(0)
                    where[own[b], span] = np.where(block[at, np.arange(FILTERS)] > 0, ok[b + at], -1)
        return out, where

    def chance(self, ids: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        pooled, _ = self.pooled(ids, rows, n_rows)
        return 1 / (1 + np.exp(-np.clip((pooled @ self.p["v"] + self.p["c"][0]).astype(np.float64), -50, 50)))

    def score(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        return at_cut(self.chance(buckets(words), rows, n_rows), self.cuts[language(words[0], rows, n_rows)])


def buckets(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(BUCKETS)).astype(np.int32)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of some texts side by side, and the text of each word."""
    return np.concatenate(texts, axis=1), np.repeat(np.arange(len(texts)), [t.shape[1] for t in texts])


def _step(net: Network, ids: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted logistic loss of one batch."""
    n = len(y)
    pooled, where = net.pooled(ids, rows, n, places=True)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.p["v"] + net.p["c"][0], -50, 50)))
    d = ((p - y) * weight / n).astype(np.float32)
    g = {k: np.zeros_like(x) for k, x in net.p.items()}
    g["v"], g["c"][0] = pooled.T @ d, d.sum()
    back = d[:, None] * net.p["v"][None, :]
    for j, w in enumerate(WIDTHS):
        span = slice(j * FILTERS, (j + 1) * FILTERS)
        row, f = np.nonzero(where[:, span] >= 0)
        at, value = where[:, span][row, f], back[:, span][row, f]
        np.add.at(g[f"b{w}"], f, value)
        for k in range(w):
            for line in ids[:, at + k]:
                np.add.at(g["E"], line, value[:, None] * net.p[f"W{w}"][k].T[f])
                np.add.at(g[f"W{w}"][k].T, f, value[:, None] * net.p["E"][line])
    return g


def _numbers(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of each text and its language, a few texts at a time: only numbers stay."""
    own, lang = [], np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), 64):
        words, rows = hashed(texts[at : at + 64], PREFIXES)
        n = min(64, len(texts) - at)
        lang[at : at + n] = language(words[0], rows, n)
        own += np.split(buckets(words), np.searchsorted(rows, np.arange(1, n)), axis=1)
    return own, lang


def _passes(net: Network, own: list[np.ndarray], y: np.ndarray, balance: np.ndarray, learn: np.ndarray, epochs: int, batch: int, rate: float, seed: int = 3) -> None:
    """Adam over the texts ``learn``, in an order of its own each time."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            g = _step(net, *_joined([own[i] for i in some]), y[some], balance[some])
            t += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-6)


def _calibrate(net: Network, lang: np.ndarray, raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    whole = best_cut(raw, y, n)
    for k in range(len(LANGUAGES)):
        own = lang == k
        all_, hit = n[own].sum(), (n * y)[own].sum()
        net.cuts[k] = best_cut(raw[own], y[own], n[own]) if 0 < hit < all_ and all_ >= 20 else whole


def train(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02) -> Network:
    """Train on four fifths of the rows and calibrate each language's threshold by F1 on the fifth part.

    Without examples of both classes the network stays as drawn and all thresholds are 0.5.
    """
    net = Network()
    if not 0 < y.sum() < len(y):
        return net
    own, lang = _numbers(texts)
    test = np.arange(len(y)) % 5 == 4
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    _passes(net, own, y, balance, np.flatnonzero(~test), epochs, batch, rate)
    raw = np.array([net.chance(*_joined([own[i]]), 1)[0] for i in np.flatnonzero(test)])
    _calibrate(net, lang[test], raw, y[test], np.ones(int(test.sum())))
    return net


def train_by_shard(rows: DataFrame, n: int, positive: int, epochs: int = 8, batch: int = 32, rate: float = 0.02) -> Network:
    """As ``train``, over any number of ``training_shards``: each pass trains a copy in every shard, and their mean goes on."""
    net = Network()
    weights = (n / (2 * max(n - positive, 1)), n / (2 * max(positive, 1)))
    shapes = {k: x.shape for k, x in net.p.items()}

    def unpack(flat: np.ndarray) -> Network:
        out, at = Network(), 0
        for k, shape in shapes.items():
            size_ = int(np.prod(shape))
            out.p[k] = flat[at : at + size_].reshape(shape).astype(np.float32)
            at += size_
        return out

    for epoch in range(epochs):

        def fit(texts: list[str], y: np.ndarray, net: Network = net, epoch: int = epoch) -> np.ndarray:
            _passes(net, _numbers(texts)[0], y, np.where(y > 0, weights[1], weights[0]), np.arange(len(y)), 1, batch, rate, 3 + epoch)
            return np.concatenate([x.ravel() for x in net.p.values()])

        net = unpack(fitted_by_shard(rows.where("NOT test"), fit))

    def values(texts: list[str], net: Network = net) -> tuple[np.ndarray, np.ndarray]:
        own, lang = _numbers(texts)
        return lang, net.chance(*_joined(own), len(texts))

    lang, raw, y, count = counted(rows.where("test"), values)
    _calibrate(net, lang, raw, y, count)
    return net


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Network:
    """The network of all labelled rows: those of one shard are fitted at once, more of them in tasks."""
    rows = training_shards(docs, labels, "toxic", FOLDS, HELD_OUT, size)
    n, positive = rows.selectExpr("count(*)", "coalesce(sum(y), 0)").first()
    net = Network() if not 0 < positive < n else train(*collected(rows)) if n <= size else train_by_shard(rows, n, positive)
    discard(rows)
    return net


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts score as the network's bias alone. Repeated rows give repeated rows, null ids
    stay null, an empty table gives an empty table; columns other than doc_id and text are not read. A very long
    text is scored in pieces of bounded memory; a score just at its language's threshold becomes 0.3.
    """
    net = fitted(docs, labels, sample)
    return answer(scored(docs, net.score, 1 << 20, PREFIXES), FOLDS, HELD_OUT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its toxicity, whether it was held out of training, and the prediction at 0.3, as in ``classify``.

    Empty texts score as the network's bias; repeated rows give repeated rows; null ids stay null and count as not held out;
    an empty table gives an empty one; a very long text is scored piece by piece, the greatest of each filter counting.
    """
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
