"""Lineage cuts: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (key) that an explicit broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20


_local: list[str] = []
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master (tests) gets one temporary
    folder for the process, and a cluster an error: its executors share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="duskwatch-"))
    return _local[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor then costs no
    recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written to the shared folder; the tables that it cut on its way are then deleted."""
    _scopes.append([])
    try:
        out = make()
    finally:
        made = _scopes.pop()
    out = cut(out)
    discard(*made)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def keyed_rows(df: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys`` (null matches null): by a broadcast when the
    counted keys fit ``BROADCAST_ROWS``, else by a shuffled semi join."""
    keys = keys.select(F.col(key).alias("_key"))
    keys = F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys
    return df.join(keys, df[key].eqNullSafe(F.col("_key")), "left_semi")


def text_digests() -> list[Column]:
    """k1 and k2, two digests of the text: with doc_id they tell rows apart whose texts differ."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]


def keyed(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, id, k1, k2, ...): whole rows of ``docs`` packed in one column, so that no name of theirs can
    clash, beside their keys and the columns ``more``, which are worked out before any exchange."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), *text_digests(), *[c.alias(n) for n, c in more.items()])


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (id, k1, k2, ...) with the further columns of ``found`` (doc_id, k1, k2, ...) for equal id and text, else null."""
    own = found.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *[c for c in found.columns if c not in ("doc_id", "k1", "k2")])
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    return rows.join(own, same, "left").drop("_id", "_k1", "_k2")


def unpacked(rows: DataFrame, names: list[str], text: Column) -> DataFrame:
    """The packed rows with a new ``text``; n_chars, where present, follows."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names])  # the names of ``rows`` may be any


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rest(a: Column, k: int) -> Column:
    """The array without its first k elements."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
