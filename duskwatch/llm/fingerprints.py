"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once; the hash's top bits name its bin and the bin keeps its least
hash. An empty bin takes the value of the first filled bin of a random walk of its own (the same walk
for all documents), which is optimal densification. Of each value the low eight bits are kept, and the
likeness corrects for the chance of their being equal.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import documents, rest, words_of

BINS, BIN_BITS, LOW_BITS = 128, 7, 8
_rng = random.Random(77)
_WALK_START = [_rng.randrange(BINS) for _ in range(BINS)]
_WALK_STEP = [_rng.randrange(BINS // 2) * 2 + 1 for _ in range(BINS)]
#: The largest value of each bin marks it as empty.
_EMPTY = [((b - BINS // 2 + 1) << (64 - BIN_BITS)) - 1 for b in range(BINS)]


#: Steps of a walk that are tried one by one before the whole walk is laid out.
FIRST_STEPS = 8


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def with_shingles(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add hashes of the five-word windows of a column of word hashes; of one to four words, one hash of all.

    Windows are built by doubling (2, 4, 4 + 1), so that each costs three hashes of two numbers.
    """
    two, four = f"{out}_2", f"{out}_4"
    mixed = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn(two, F.zip_with(words, rest(F.col(words), 1), mixed))
    df = df.withColumn(four, F.zip_with(two, rest(F.col(two), 2), mixed))
    whole = F.transform(F.array(F.array_join(F.transform(words, lambda x: x.cast("string")), " ")), lambda x: F.xxhash64(x))
    windows = F.slice(F.zip_with(four, rest(F.col(words), 4), mixed), 1, F.greatest(F.size(words) - 4, F.lit(0)))
    none = F.array().cast("array<bigint>")
    return df.withColumn(out, F.when(F.size(words) >= 5, windows).when(F.size(words) > 0, whole).otherwise(none)).drop(two, four)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of a text column as an array of ``BINS`` bytes (low bits minus 128).

    Null, empty and blank texts get an empty array. Case is ignored.
    """
    w, s, arr, mins = f"{out}_w", f"{out}_s", f"{out}_a", f"{out}_m"
    df = df.withColumn(w, F.transform(words_of(F.lower(text)), lambda x: F.xxhash64(x)))
    df = with_shingles(df, w, s)
    df = df.withColumn(arr, F.when(F.size(s) > 0, F.sort_array(F.concat(F.col(s), _longs(_EMPTY)))).otherwise(F.array().cast("array<bigint>")))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    # the hash before each one comes by zipping with the array moved on by one
    moved = F.concat(F.array(F.lit(None).cast("long")), F.col(arr))
    first = F.zip_with(arr, F.slice(moved, 1, F.size(arr)), lambda x, y: F.when(y.isNull() | (bin_of(x) != bin_of(y)), x))
    df = df.withColumn(mins, F.array_compact(first))
    empty = _longs(_EMPTY)
    df = df.withColumn(mins, F.transform(mins, lambda x, b: F.nullif(x, F.get(empty, b))))
    start, step = _ints(_WALK_START), _ints(_WALK_STEP)

    def rest_of_walk(b: Column) -> Column:
        walk = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(F.col(mins), (F.get(start, b) + j * F.get(step, b)).bitwiseAND(BINS - 1)))
        return F.get(F.array_compact(walk), F.lit(0))

    def filled_bin(x: Column, b: Column) -> Column:
        steps = [F.get(F.col(mins), F.get(_ints([(p + j * q) % BINS for p, q in zip(_WALK_START, _WALK_STEP, strict=True)]), b)) for j in range(FIRST_STEPS)]
        return F.coalesce(x, *steps, rest_of_walk(b))

    filled = F.transform(mins, filled_bin)
    low = F.transform(filled, lambda x: (x.bitwiseAND((1 << LOW_BITS) - 1) - 128).cast("tinyint"))
    return df.withColumn(out, low).drop(w, s, arr, mins)


def packed(fingerprint: Column) -> Column:
    """The bytes as lowercase hexadecimal, two digits for each bin; an empty string for no shingle."""
    digits = F.split(F.lit(" ".join(f"{v:02x}" for v in range(256))), " ")
    return F.array_join(F.transform(fingerprint, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of equal bytes less what chance makes equal.

    Two empty fingerprints are alike (1), an empty one is unlike any other (0).
    """
    chance = 1.0 / (1 << LOW_BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row: the general form."""
    return with_fingerprint(docs.select("doc_id", F.col("text").alias("_t")), "_t", "_f").select("doc_id", packed(F.col("_f")).alias("fingerprint"))


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """A bucket of about equal rows for each id, rising with it; null ids come first. At most 4,096 bounds reach the driver."""
    n = max(32, min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bounds = sorted(set(bounds or []))
    edges = F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(edges, lambda e: e < F.col("doc_id")))), n


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the next one by descending id (after the last comes the first).

    Rows are dealt by ranges of ids and read in order within each; only the first row of each range is
    handed to the range before. Null ids come last; rows of the same id follow by a hash of the text.
    Null texts are empty, an empty table gives an empty one, other columns are not read, very long texts travel whole.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket, _ = _buckets(base)
    base = base.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket)
    firsts = base.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("k"))  # a row for each bucket
    around = W.orderBy(F.desc("bucket"))
    firsts = firsts.select(F.coalesce(F.lag("bucket").over(around), F.first_value("bucket").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("of"), F.col("k.doc_id").alias("first_id"), F.col("k.h").alias("first_h"))
    after = base.join(firsts, base["doc_id"].eqNullSafe(F.col("first_id")) & (base["h"] == F.col("first_h"))).groupBy("of").agg(F.min("text").alias("after_text"))
    after = with_fingerprint(after, "after_text", "after_fp")
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("h"), "text")
    rows = with_fingerprint(base, "text", "fp")
    rows = rows.withColumns({"lead_text": F.lead("text").over(order), "lead_fp": F.lead("fp").over(order)})
    rows = rows.withColumn("of", F.when(F.col("lead_text").isNull(), F.col("bucket")))
    rows = rows.join(after, (rows["bucket"] == after["of"]) & rows["of"].isNotNull(), "left").drop("of")
    return rows.select("doc_id", "text", "fp", F.coalesce("lead_text", "after_text").alias("next_text"), F.coalesce("lead_fp", "after_fp").alias("next_fp"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likeness, and that to the next document.

    Null and empty texts have an empty fingerprint; two of those are alike. Rows without an id come last in the order of ids,
    rows of one id follow by a hash of the text, so repeated rows are next to each other. One row is next to itself,
    an empty table gives an empty one, other columns are not read, very long texts are taken whole.
    """
    rows = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
