"""What the two classifiers share: the split, the training rows, fits by shard and scoring in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, cut, keyed_rows
from .words import row_groups, text_buffer, word_hashes


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, shards: int, n_labels: int) -> DataFrame:
    """(h, doc_id, y, text, test, shard) of all labelled rows outside the held-out fold, dealt to shards by a hash of the id, and a fifth to test on.

    Of an id's rows one text, that of least hash, is taken; none of it depends on the order of rows. Null labels, ids and texts are left out.
    Texts are exchanged once: they and the labels go to their shard side by side and are matched where they lie. If the
    ``n_labels`` labels fit a broadcast, texts without a label stay behind.
    """
    outside = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)
    known = labels.where(F.col(label).isNotNull() & outside).select("doc_id", F.lit(None).cast("string").alias("text"), F.col(label).cast("int").alias("y"))
    texts = docs.select("doc_id", "text", F.lit(None).cast("int").alias("y")).where(F.col("text").isNotNull() & outside)
    texts = keyed_rows(texts, known, "doc_id", n_labels) if n_labels <= BROADCAST_ROWS else texts
    both = texts.unionByName(known).withColumn("h", F.xxhash64(F.lit("training rows"), "doc_id"))
    both = both.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(shards, "shard")
    text = F.min_by("text", F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), "text"))).alias("text")
    own = both.groupBy("shard", "h", "doc_id").agg(text, F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("ys")).where("text IS NOT NULL")
    rows = own.select("h", "doc_id", F.explode("ys").alias("y"), "text", "shard").where("y IS NOT NULL")
    return rows.select("h", "doc_id", "y", "text", (F.pmod(F.shiftright("h", 20), F.lit(5)) == 4).alias("test"), "shard")


def collected(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of few rows, by id."""
    some = rows.select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return some["text"].tolist(), some["y"].to_numpy(np.float64)


#: Parameters travel in slices of so many; values are counted in steps of 1 / ``STEPS``.
SLICE, STEPS = 1 << 12, 1000


def training_shards(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, size: int) -> DataFrame:
    """``training_rows`` in the shared folder, dealt once to shards of about ``size`` rows that lie together in its files."""
    n = labels.where(F.col(label).isNotNull()).count()
    rows = training_rows(docs, labels, label, folds, held_out, max(1, -(-n // size)), n)
    return cut(rows.sortWithinPartitions("shard", "doc_id", "y"))


def fitted_by_shard(rows: DataFrame, fit: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of the parameters that ``fit`` gives for the texts and labels of each shard, weighted by its rows. Shards are fitted in the
    tasks that read them and averaged slice by slice behind a shuffle: one set of parameters comes to the driver, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(texts: list[str], y: list[int]) -> pa.RecordBatch:
            own = np.asarray(fit(texts, np.array(y, np.float64)), np.float32)
            parts = [own[i : i + SLICE].tolist() for i in range(0, len(own), SLICE)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([len(y)] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float32()))], ["part", "n", "own"])

        shard, texts, y = None, [], []
        for batch in batches:
            for s, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and texts:
                    yield done(texts, y)
                    texts, y = [], []
                shard = s
                texts.append(text)
                y.append(label)
        if texts:
            yield done(texts, y)

    def added(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        mean = sum(k * x.values.to_numpy().astype(np.float64) for k, x in zip(n.tolist(), group["own"], strict=True)) / n.sum()
        return pa.table({"part": group["part"].slice(0, 1), "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})

    each = rows.select("shard", "text", "y").mapInArrow(run, "part int, n long, own array<float>")
    mean = each.groupBy("part").applyInArrow(added, "part int, mean array<double>").collect()
    return np.concatenate([np.array(r["mean"]) for r in sorted(mean, key=lambda r: r["part"])])


def counted(rows: DataFrame, values: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, value, label, number) of all ``rows``, values in steps of 1 / ``STEPS``; ``values`` gives kinds and values of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                kind, value = values(some["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), some["y"], pa.array(np.rint(value * STEPS), pa.int64())], ["kind", "y", "at"])

    t = rows.select("y", "text").mapInArrow(run, "kind int, y int, at long").groupBy("kind", "y", "at").agg(F.count("*").alias("n")).toPandas().sort_values(["kind", "y", "at"])
    return t["kind"].to_numpy(), t["at"].to_numpy() / STEPS, t["y"].to_numpy(np.float64), t["n"].to_numpy(np.float64)


def hashed(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and rows of whole texts."""
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    parts = [(h, r + lo) for lo, hi in row_groups(offsets) for h, r in [word_hashes(buf, offsets, lo, hi, True, prefixes)]]
    none = np.zeros((1 + len(prefixes), 0), np.uint64)
    return np.concatenate([p[0] for p in parts] or [none if prefixes else none[0]], axis=-1), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray, int], np.ndarray], most: int, prefixes: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, score) per row: ``score`` gets the word hashes and rows of ``most`` bytes of whole texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in row_groups(offsets, most):
                words, rows = word_hashes(buf, offsets, lo, hi, True, prefixes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score(words, rows, hi - lo), pa.float64())], ["doc_id", "score"])

    data = docs.select("doc_id", "text")
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, score double")


def answer(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def at_cut(raw: np.ndarray, threshold: np.ndarray | float) -> np.ndarray:
    """Map scores so that ``threshold`` becomes 0.3, keeping 0, 1 and the order."""
    low = 0.3 * raw / np.maximum(threshold, 1e-9)
    high = 0.3 + 0.7 * (raw - threshold) / np.maximum(1 - threshold, 1e-9)
    return np.clip(np.where(raw < threshold, np.minimum(low, np.nextafter(0.3, 0)), high), 0.0, 1.0)


def best_cut(raw: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of best F1, half-way between two scores, each standing for ``n`` rows; 0.5 without both classes."""
    n = np.ones(len(y)) if n is None else n
    if not 0 < (y * n).sum() < n.sum():
        return 0.5
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum((y * n)[order])
    f1 = 2 * hit / (np.cumsum(n[order]) + (y * n).sum())
    best = float(f1.max())
    top = np.flatnonzero(f1 >= best - 1e-12)
    at = top[len(top) // 2]
    below = raw[order[at + 1]] if at + 1 < len(y) else 0.0
    return float(np.clip((raw[order[at]] + below) / 2, 1e-6, 1 - 1e-6))
