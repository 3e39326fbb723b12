"""Cuts of lineage for loops: tables in the folder that driver and executors share, outside the training-data part."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, one temporary folder on a local master, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="duskwatch-"))
    return _local[0]


def stored(df: DataFrame, over: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``over``, an earlier result that nothing will read
    again, is deleted. With ``by``, one folder for each value of that column: a filter on it reads only its own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    if over is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(over._stored_at)
        old.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(old, True)
    return back
