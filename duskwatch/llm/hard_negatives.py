"""Hard negatives by slot-decomposed selection.

An anchor's positives ask for overlapping windows of scores: not above their upper limits, not below their lower
ones. The upper limits, sorted downwards, split the scores into disjoint slots. Each task keeps the first k rows
per (anchor, slot) of its part, a shuffle by (anchor, slot) keeps the first k of those, and a window's answer is
the merge of the slots from its own downwards, cut at its lower limit: rows below it rank after all rows above.

Anchors are taken in blocks of a bounded size, each sent to the tasks that hold the rows: two passes over the rows
a block, one for the positives, one for the negatives. Scores are integer products of matrices.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

#: Anchors of a block, rows of a task, and rows and anchors of one product of matrices.
ANCHORS, ROWS, STEP, WIDE = 8192, 1 << 18, 2048, 512
BLOCK_BYTES = 64 << 20
_KEPT = "anchor_key long, anchor_id long, slot int, id long, key long, score long"
_NAMES = ["anchor_key", "anchor_id", "slot", "id", "key", "score"]
_LAST = 2**63 - 1
#: Wide enough for a hundred times a long.
WIDER = "decimal(22,0)"


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, key): the rows that take part, with their new labels and whole-number components, each distinct one once."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = vectors.where(usable).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))
    return rows.distinct().withColumn("key", F.xxhash64("vec_id", "label", "v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as lines of a matrix of float64, short ones filled up with zeros, longer ones cut (zeros face what is cut)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < width
    out[line[fits], place[fits]] = flat[fits]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as int64: by float64 where every partial sum is exact, else by Python's integers (held within 64 bits)."""
    largest = (np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0)) * max(rows.shape[1], 1)
    if largest < 2**53:
        return (rows @ anchors.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    full = exact(rows).dot(exact(anchors).T) if rows.shape[1] else np.zeros((len(rows), len(anchors)), object)
    return np.vectorize(lambda x: min(max(x, -(2**63)), 2**63 - 1), otypes=[np.int64])(full)


def _first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of the k best allowed rows of each column; rows come in the order in which ties are broken."""
    least = -(2**63)
    kept = np.where(allowed, score, least)
    at = max(len(kept) - k, 0)
    limit = np.partition(kept, at, axis=0)[at] if len(kept) else np.zeros(score.shape[1], np.int64)
    above, level = kept > limit, allowed & (kept == limit)
    room = k - above.sum(axis=0)
    return np.nonzero((above & allowed) | level & (np.cumsum(level, axis=0) <= room))


def _select(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The first k rows per (anchor, slot) of a task's rows. For positives there is one slot, the anchor's own label."""
    block = shared.value
    best: list[np.ndarray] | None = None
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            ids = part.column(0).fill_null(_LAST).to_numpy()
            labels, keys = part.column(1).to_numpy(), part.column(3).to_numpy()
            order = np.lexsort((keys, ids))
            ids, labels, keys, rows = ids[order], labels[order], keys[order], _matrix(part.column(2), block["v"].shape[1])[order]
            new = []
            for left in range(0, len(block["key"]), WIDE):
                own = slice(left, left + WIDE)
                score = products(rows, block["v"][own])
                alike = labels[:, None] == block["label"][own]
                if same:
                    spots = [(0, alike & (keys[:, None] != block["key"][own]))]
                else:
                    upper = block["upper"][own]  # of the positives, downwards
                    fits = ~alike & (score >= block["lower"][own])
                    under = (score[:, :, None] <= upper).sum(axis=2)  # limits that the row is not above: its slot
                    spots = [(s, fits & (under == s)) for s in range(1, upper.shape[1] + 1)]
                for slot, allowed in spots:
                    r, a = _first(score, allowed, k)
                    new.append([a + left, np.full(len(a), slot), ids[r], keys[r], score[r, a]])
            every = [np.concatenate(x) for x in zip(*new, *([best] if best else []))] if new else None
            if every is not None:
                a, slot, i, key, score = every
                order = np.lexsort((key, i, -score, slot, a))
                a, slot = a[order], slot[order]
                fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (slot[1:] != slot[:-1]))) if len(a) else np.zeros(0, bool)
                place = np.arange(len(a)) - np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
                order = order[place < k]
                best = [x[order] for x in every]
    if best and len(best[0]):
        a, slot, i, key, score = best
        ids = pa.array(i, pa.int64(), mask=i == _LAST)
        yield pa.RecordBatch.from_arrays([pa.array(block["key"][a]), pa.array(block["id"][a]), pa.array(slot.astype(np.int32)), ids, pa.array(key), pa.array(score)], _NAMES)


def _ranked(kept: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows of each group; Spark's group limit cuts each task's part before the shuffle as well."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, embedding, label).

    Rows that ``anchors`` selects are the anchors; the first ``positives`` other rows of an anchor's label are its
    positives, and per positive the first ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score its negatives. Higher scores come first, ties by smaller vec_id (null
    last). Rows with a null label, a null vector or a null or non-finite component take no part; rows equal in
    all three columns count once, others that share an id are rows of their own. Shorter vectors are filled up
    with zeros. A row without an id is no anchor. No anchors, no pairs or an empty table give an empty table;
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(prepared(vectors.select("vec_id", "embedding", "label")))
    chosen = rows.where(F.expr(anchors)).where("vec_id IS NOT NULL")
    n_rows, n_anchors = rows.count(), chosen.count()
    width = chosen.agg(F.max(F.size("v"))).first()[0] or 1
    parts = max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS))
    n_blocks = max(1, -(-n_anchors // min(block, max(WIDE, BLOCK_BYTES // (8 * width)))))
    spread = rows.select("vec_id", "label", "v", "key").coalesce(parts)  # few tasks with long parts: the first k of each part travel
    if n_blocks == 1:
        return _block(spark, chosen, spread, positives, negatives, low, high)
    answers = [cut(_block(spark, chosen.where(F.pmod("key", F.lit(n_blocks)) == b), spread, positives, negatives, low, high)) for b in range(n_blocks)]
    return functools.reduce(DataFrame.unionByName, answers)


def _block(spark: SparkSession, own: DataFrame, rows: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The answers for one block of anchors."""
    table = own.orderBy("vec_id", "key").toArrow()  # about ``block`` rows of the anchors
    widest = int(max(table.column("v").combine_chunks().value_lengths().to_pylist(), default=0)) if table.num_rows else 0
    anchors = {"id": table.column("vec_id").to_numpy(), "key": table.column("key").to_numpy(), "label": table.column("label").to_numpy(), "v": _matrix(table.column("v"), widest)}
    shared = spark.sparkContext.broadcast(anchors)
    first = rows.mapInArrow(lambda b: _select(b, shared, positives, True), _KEPT)
    found = cut(_ranked(first, positives, "anchor_key").select("anchor_key", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    best = found.toArrow()  # ``positives`` rows for each anchor of the block
    at = {key: i for i, key in enumerate(anchors["key"].tolist())}
    upper = np.full((len(at), positives), -(2**63))
    lower = np.full(len(at), _LAST)
    for key, place, score in zip(*(best.column(c).to_pylist() for c in ("anchor_key", "place", "positive_score"))):
        if low * score <= high * score:  # else its window is empty
            upper[at[key], place - 1] = high * score // 100
            lower[at[key]] = min(lower[at[key]], -(-low * score // 100))
    limits = spark.sparkContext.broadcast(anchors | {"upper": -np.sort(-upper, axis=1), "lower": lower})
    second = rows.mapInArrow(lambda b: _select(b, limits, negatives, False), _KEPT)
    slots = _ranked(second, negatives, "anchor_key", "slot")
    entry = F.struct((-F.col("score").cast(WIDER)).alias("down"), F.coalesce("id", F.lit(_LAST)).alias("at"), "key", "id", "score")
    merged = slots.groupBy("anchor_key").agg(F.sort_array(F.collect_list(entry)).alias("down"))  # slots x negatives entries at most
    own_score = F.col("positive_score").cast(WIDER)
    fits = F.filter("down", lambda x: (-x["down"] * 100).between(own_score * low, own_score * high))
    window = found.join(merged, "anchor_key").withColumn("own", F.slice(fits, 1, negatives))
    pairs = window.select("anchor_id", "positive_id", "positive_score", F.posexplode("own").alias("at", "n"))
    return pairs.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive of ``embeddings``, with the parameters of ``mine``.

    Nulls, ties, repeated rows, an empty table and further columns as stated there; there are no texts.
    """
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) <= 10
"""
