"""Reading and writing event tables."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA
from ..store import stored


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """All event Parquet files of a folder, each row with the name of its file; unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path).withColumn("_source_parquet", F.col("_metadata.file_name"))


def conform(df: DataFrame) -> DataFrame:
    """The 36 columns of the event schema, by name and cast; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT_SCHEMA])


def sink_events(df: DataFrame, path: str) -> None:
    conform(df).write.mode("overwrite").parquet(path)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_ioc_csv(iocs: DataFrame, path: str, least: int = 50) -> None:
    """All indicators, and those of at least ``least`` points, as CSV with a header."""
    iocs.write.mode("overwrite").option("header", "true").csv(f"{path}/all")
    iocs.where(F.col("score") >= least).write.mode("overwrite").option("header", "true").csv(f"{path}/high")


#: A file up to this size is one value of a row, which takes several times its size of memory; a longer one is read piece by piece.
WHOLE = 16 << 20
PIECE = 1 << 20


def _pieces(uri: str, java: str | None, classes: str | None, conf: str | None) -> Iterator[bytes]:
    """A file's bytes in pieces. What lies in no file system of this machine is read by Hadoop's `fs -cat` in a process beside the
    task, with the executor's classes and the session's settings, so it can lie in any store that Spark reads."""
    if uri.startswith("file:"):
        with open(re.sub("^file:(//)?(?=/)", "", uri), "rb") as f:
            while piece := f.read(PIECE):
                yield piece
        return
    with tempfile.TemporaryDirectory() as own:  # only its owner can read it
        Path(own, "core-site.xml").write_text(conf)
        Path(own, "log4j2.properties").write_text("rootLogger.level = off\n")  # else messages may go where the file goes
        java_args = ["-Xmx128m", "-XX:+UseSerialGC", "-XX:-UsePerfData", f"-Dlog4j2.configurationFile={own}/log4j2.properties"]
        literal = re.sub(r"([\\*?\[\]{}])", r"\\\1", uri)  # -cat takes patterns
        with open(f"{own}/said", "wb") as said, subprocess.Popen(
            [f"{java}/bin/java", *java_args, "-cp", f"{own}:{classes}:{SparkFiles.getRootDirectory()}/*", "org.apache.hadoop.fs.FsShell", "-conf", f"{own}/core-site.xml", "-cat", literal], env=os.environ | {"LC_ALL": "C.UTF-8"}, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=said
        ) as cat:
            while piece := cat.stdout.read(PIECE):
                yield piece
        if cat.returncode:
            raise OSError(f"{uri} can't be read: {Path(own, 'said').read_text(errors='replace')[-2000:]}")


def _digest(pieces: Iterator[bytes], size: int) -> str:
    """SHA-256 of the first ``size`` bytes: those of a file that grew since it was listed are left out, fewer are an error."""
    sha, left = hashlib.sha256(), size
    for piece in pieces:
        sha.update(piece[:left])
        left -= min(left, len(piece))
    if left:
        raise OSError(f"a file of {size} bytes ended {left} bytes too early")
    return sha.hexdigest()


def _digests(conf: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            found = [_digest(_pieces(r["uri"], r["java"], r["classes"], conf), r["size"]) for r in b.select(["uri", "size", "java", "classes"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], b["size"], b["modified"], pa.array(found, "string")], ["path", "size", "modified", "sha256"])

    return run


def manifest(spark: SparkSession, path: str, largest: int | None = None, whole: int = WHOLE) -> DataFrame:
    """(path, size, modified, sha256) of each file below a folder, by its path from there. Each has a digest, of whatever size it is, but those of more than ``largest`` bytes if that
    is given; files of more than ``whole`` bytes are read in pieces. Empty files are not listed, as Spark reads none."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = [F.substring_index(F.col("path"), f"{root}/", -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    most = whole if largest is None else min(whole, largest)
    out = files.where(F.col("length") <= most).select(*own, F.sha2("content", 256).alias("sha256"))
    settings = spark._jsc.sc().hadoopConfiguration()
    conf, at_task = None, [F.lit(None).cast("string"), F.lit(None).cast("string")]
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(settings).getUri().getScheme() != "file":
        xml = spark._jvm.java.io.StringWriter()
        settings.writeXml(xml)
        conf, at_task = xml.toString(), [F.reflect(F.lit("java.lang.System"), F.lit("getProperty"), F.lit(name)) for name in ("java.home", "java.class.path")]
    # without their content, files are still dealt to tasks by their sizes
    long = files.where(F.col("length") > most if largest is None else F.col("length").between(most + 1, largest))
    long = long.select(*own, F.col("path").alias("uri"), at_task[0].alias("java"), at_task[1].alias("classes"))
    out = out.unionByName(long.mapInArrow(_digests(conf), "path string, size long, modified timestamp, sha256 string"))
    if largest is None:
        return out
    return out.unionByName(files.where(F.col("length") > largest).select(*own, F.lit(None).cast("string").alias("sha256")))


def verify_manifest(known: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of the files of two manifests that differ: ``added``, ``missing`` or ``changed``, by path, so that files of one
    name in two folders are told apart; without a digest on either side, sizes are compared."""
    j = known.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_known")).join(now.select("path", "size", "sha256", F.lit(True).alias("_now")), "path", "full_outer")
    same = F.when(F.col("_sha").isNull() | F.col("sha256").isNull(), F.col("_size") == F.col("size")).otherwise(F.col("_sha") == F.col("sha256"))
    state = F.when(F.col("_known").isNull(), "added").when(F.col("_now").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "changed")
    return j.select("path", state.alias("state")).where("state IS NOT NULL")


def altered(files: DataFrame) -> DataFrame:
    """A manifest as it was before: without the table of nations, with another digest for the regions and one file more."""
    past = files.where("path NOT LIKE 'nation%'").withColumn("sha256", F.when(F.col("path").startswith("region"), "0").otherwise(F.col("sha256")))
    return past.unionByName(files.orderBy("path").limit(1).withColumn("path", F.lit("sub/gone.parquet")))


QUERIES = {
    "hash_manifest": lambda s, d: manifest(s, d).select("path", "size", "sha256"),
    "verify_manifest": lambda s, d: verify_manifest(altered(now := stored(manifest(s, d))), now),
}
ORACLES = {"verify_manifest": "SELECT 'nation.parquet' AS path, 'added' AS state UNION ALL SELECT 'region.parquet', 'changed' UNION ALL SELECT 'sub/gone.parquet', 'missing'"}
