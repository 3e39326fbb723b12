"""Many strings looked for in many texts, whatever the case, without a nested loop.

Each string is looked for by its rarest part of three characters (or by itself, if shorter), where rare is
counted over the texts. Only the parts that strings were given are kept of the texts. Parts that many texts
hold are split: their texts are dealt to as many buckets as their count needs, and the strings go to all of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored

#: Texts of one part in one bucket, about.
BUCKET = 1 << 14
#: Parts that a broadcast may hold.
BROADCAST_ROWS = 1 << 20


def _parts(text: Column, n: int) -> Column:
    """The distinct substrings of n characters; none of a shorter text."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def _few(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys


def found_in(values: DataFrame, texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(value, text): the distinct values (value) and the distinct texts (text) that hold them, compared in lower case.

    Nulls and empty values or texts meet nothing.
    """
    values = values.select("value").where("value <> ''").distinct().withColumn("_low", F.lower("value"))
    values = stored(values.withColumn("_size", F.least(F.lit(3), F.length("_low"))))
    texts = stored(texts.select("text").where("text <> ''").distinct().select("text", F.lower("text").alias("_low"), F.xxhash64("text").alias("_id")))
    sizes = [r[0] for r in values.select("_size").distinct().collect()]  # three at most
    parts = values.select("value", "_low", F.explode(F.when(F.col("_size") == 3, _parts(F.col("_low"), 3)).otherwise(F.array("_low"))).alias("part"))
    wanted = stored(parts.select("part").distinct())
    held = texts.select("_id", F.explode(F.flatten(F.array(*[_parts(F.col("_low"), n) for n in sizes] or [F.array().cast("array<string>")]))).alias("part"))
    held = stored(held.join(_few(wanted, wanted.count()), "part", "left_semi"))
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    chosen = parts.join(counts, "part", "left").groupBy("value", "_low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("best")).where("best.n > 0")
    chosen = stored(chosen.select("value", "_low", F.col("best.part").alias("part"), F.ceil(F.col("best.n") / bucket).cast("int").alias("buckets")))
    keys = chosen.select("part", "buckets").distinct()
    dealt = held.join(_few(keys, keys.count()), "part").withColumn("bucket", F.pmod("_id", F.col("buckets")).cast("int"))
    asked = chosen.select("value", F.col("_low").alias("_value"), "part", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    return asked.join(dealt, ["part", "bucket"]).join(texts, "_id").where(F.col("_low").contains(F.col("_value"))).select("value", "text")
