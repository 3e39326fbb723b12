"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are first dealt to source partitions by a hash. The matrix says how many rows of each partition
go to each shard: it is drawn from the multivariate hypergeometric law, so that it is distributed as a
uniform permutation's. Each partition is permuted locally, cut by its line of the matrix, exchanged,
and each shard is permuted again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import documents

SHARDS = 24
#: Rows of a source partition, about; and of a run that is sorted within a shard.
PARTITION_ROWS = 1 << 18
SEED = 20240607


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad without replacement; by numpy below 10^9, else by inversion from the mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad and draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, p_up, p_down = rng.random(), mode, mode, p, p
    u -= p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; lines sum to ``partitions``, columns to ``shards``."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    matrix = []
    for size in partitions:
        line, need, room = [], size, sum(left)
        for j, free in enumerate(left):
            room -= free
            take = need if j == len(left) - 1 else hypergeometric(rng, free, room, need)
            line.append(take)
            need -= take
        left = [a - b for a, b in zip(left, line, strict=True)]
        matrix.append(line)
    return matrix


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row; shard counts differ by one at most.

    Null texts have no bytes; null ids are rows like others. Rows equal in id and text are
    interchangeable, each gets its own place. An empty table gives an empty table; columns other than
    doc_id and text are not read. The same rows and seed give the same shards on every run.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("key"))
    n = docs.count()
    n_parts = max(16, min(1 << 16, -(-n // PARTITION_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n_parts)).cast("int"))
    counts = dict(rows.groupBy("part").count().collect())  # a number for each partition
    parts = [counts.get(p, 0) for p in range(n_parts)]
    matrix = communication_matrix(parts, [n // shards + (j < n % shards) for j in range(shards)], seed)
    ends = [f"[{','.join(map(str, np.cumsum(line).tolist()))}]" for line in matrix]
    # the matrix has n_parts x shards numbers
    lines = docs.sparkSession.createDataFrame(list(enumerate(ends)), "part int, line string").select("part", F.from_json("line", "array<bigint>").alias("ends"))
    local = W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key", "doc_id", "size")
    rows = rows.withColumn("at", F.row_number().over(local)).join(lines, "part")
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at")))).drop("ends", "at")
    # the second permutation: by a fresh hash; runs of a shard are sorted apart and set one after another
    runs = max(1, min(1 << 16, -(-n // (shards * PARTITION_ROWS))))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(seed + 2), "key", "part"))
    rows = rows.withColumn("run", F.least(F.floor((F.shiftrightunsigned("turn", 1) / F.lit(float(1 << 63))) * runs).cast("int"), F.lit(runs - 1)))
    before = rows.groupBy("shard", "run").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    order = W.partitionBy("shard", "run").orderBy("turn", "key", "doc_id", "size")
    rows = rows.withColumn("own", F.row_number().over(order)).join(before.drop("count"), ["shard", "run"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shard of 24 and its place there, by the law of equal rows, as in ``shard``.

    Null texts count no bytes, null ids are rows like others, repeated rows get places of their own, an empty table gives an
    empty one, other columns are not read, a very long text is only measured.
    """
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
