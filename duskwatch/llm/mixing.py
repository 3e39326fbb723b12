"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / size of the source times: once or twice for certain, and once
more with the fraction left. Fractions are settled in pairs: mass (words) moves at random from one
document to the other until one of them is integral, so the words taken stay what they should be and
each document keeps its expectation. Blocks of documents are folded by a higher-order function; the one
undecided document of each block goes on to the next level of a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut, documents, words_of

#: Weights of the sources in order of code points, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK = 128
SEED = 4711


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    All targets together are ``SHARE`` of all words. A target stops at ``MOST`` times its source's words
    and the excess goes to the others by weight until none is above: the level at which this ends is
    found by ordering sources by the level at which each is full.
    """
    # UTF-8 bytes sort as code points do
    by_name = W.orderBy(F.asc_nulls_last("source"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))).cast("int")
    s = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in WEIGHTS]), place)).withColumn("full", F.lit(float(MOST)) * F.col("source_size"))
    s = s.withColumn("level", F.col("full") / F.col("weight"))
    up = W.orderBy("level", F.asc_nulls_last("source"))
    s = s.withColumns({"filled": F.coalesce(F.sum("full").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)), "all": F.sum("source_size").over(W.partitionBy())})
    s = s.withColumn("common", (F.lit(SHARE) * F.col("all") - F.col("filled")) / F.col("open"))
    level = F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "common"))).over(W.partitionBy())
    return s.withColumn("common", level["common"]).select("source", "source_size", F.least("full", F.col("weight") * F.col("common")).alias("target"))


def _chance(a: Column, b: Column) -> Column:
    """A number in [0, 1) from two document keys and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), a, b), 11) / F.lit(float(1 << 53))


def _fold(items: Column) -> Column:
    """Settle an array of (key, size, p): (decided array of (key, up), the undecided one)."""
    item = "struct<key:bigint,size:double,p:double>"
    start = F.struct(F.array().cast("array<struct<key:bigint,up:int>>").alias("done"), F.lit(None).cast(item).alias("now"))

    def as_item(key: Column, size: Column, p: Column) -> Column:
        return F.struct(key.alias("key"), size.alias("size"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["now"]
        gain = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # words that may move from x to a
        loss = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # words that may move from a to x
        to_a = _chance(a["key"], x["key"]) * (gain + loss) < loss
        a_full = (1 - a["p"]) * a["size"] <= x["p"] * x["size"]
        a_none = a["p"] * a["size"] <= (1 - x["p"]) * x["size"]
        a_ends = F.when(to_a, a_full).otherwise(a_none)
        a_new = F.when(to_a, a["p"] + gain / a["size"]).otherwise(a["p"] - loss / a["size"])
        x_new = F.when(to_a, x["p"] - gain / x["size"]).otherwise(x["p"] + loss / x["size"])
        ended = F.when(a_ends, F.struct(a["key"].alias("key"), to_a.cast("int").alias("up"))).otherwise(F.struct(x["key"].alias("key"), (~to_a).cast("int").alias("up")))
        stays = F.when(a_ends, as_item(x["key"], x["size"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), x_new)))).otherwise(as_item(a["key"], a["size"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), a_new))))
        moved = F.struct(F.concat(acc["done"], F.array(ended)).alias("done"), stays.alias("now"))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), as_item(x["key"], x["size"], x["p"]).alias("now"))).otherwise(moved)

    return F.aggregate(items, start, step)


def settle(items: DataFrame) -> DataFrame:
    """(source, key, up) from (source, key, size, p) with 0 < p < 1 and size > 0: up is 0 or 1.

    The last undecided document of a source is rounded to the nearer side, so the words taken miss the
    target by half of one document at most. Each level leaves one document for each block of about
    ``BLOCK``; a hot source has many blocks, a source's number of blocks is counted first.
    """
    decided, level = None, 0
    while True:
        blocks = items.groupBy("source").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        dealt = items.join(blocks, items["source"].eqNullSafe(blocks["source"])).drop(blocks["source"])
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + level), "key"), F.col("blocks")).cast("int"))
        # falling sizes: what stays undecided to the end is small
        folded = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("xs"))
        folded = cut(folded.select("source", _fold(F.transform("xs", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["p"].alias("p")))).alias("f")))
        done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.key", "d.up")
        decided = done if decided is None else decided.union(done)
        left = folded.select("source", "f.now.*")
        if most == 1:
            return decided.union(left.select("source", "key", (F.col("p") >= 0.5).cast("int").alias("up")))
        items, level = left, level + 1
    return items.select("source", "key", F.lit(0).alias("up"))


def mix(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row of ``docs`` with size, source_size, target, copies and taken.

    The size is the number of words; documents without words (null or blank) are taken with no words and
    no copies. Null sources are one source, the last. Rows of the same id and text are told apart by
    their number among equals, so each is settled alone. An empty table gives an empty table; other
    columns are not read unless named.
    """
    words = F.size(words_of(docs["text"])).cast("long")
    rows = docs.select(F.struct(*columns).alias("row"), F.col("source").alias("source"), words.alias("size"), F.xxhash64("doc_id", "text", "source").alias("hash"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"))
    whole = cut(rows)  # the parts are fixed from here on
    rows = whole.drop("row")  # what a row holds is exchanged once, at the end
    # equal rows are numbered within their part, behind those of the parts before it: no task has all copies of a row
    counts = rows.groupBy("hash", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("hash").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("hash", "part", "before")
    rows = rows.withColumn("nr", F.row_number().over(W.partitionBy("hash", "part").orderBy("rid"))).join(before, ["hash", "part"])
    rows = rows.withColumn("key", F.xxhash64("hash", F.col("before") + F.col("nr"))).drop("nr", "before", "part")
    total = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    rows = rows.join(total.withColumnRenamed("source", "_s"), rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    wanted = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("wanted", wanted).withColumn("certain", F.floor("wanted").cast("int")).withColumn("p", F.col("wanted") - F.col("certain"))
    open_ = rows.where("size > 0 AND p > 0").select("source", "key", F.col("size").cast("double").alias("size"), "p")
    # one verdict for each key of a source: two keys that are equal by chance can't multiply rows
    up = settle(open_).groupBy(F.col("source").alias("_s"), F.col("key").alias("_k")).agg(F.max("up").alias("up"))
    rows = rows.join(up, (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_k").withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + F.coalesce("up", F.lit(0))).otherwise(0))
    rows = rows.select("rid", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    return whole.select("rid", "row").join(rows, "rid").select("row.*", "size", "source_size", "target", "copies", "taken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and how many words the mix takes of it, as in ``mix``.

    Null and blank texts have no words and are not taken, null sources are one source, repeated rows are drawn each for
    itself, an empty table gives an empty one, other columns are not read, a very long text is only counted.
    """
    return mix(documents(spark, sf_dir)).drop("copies")
