"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local session without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/vecloom-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # with the application
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written to a table and read again: what follows does not compute it anew."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def bucketed(df: DataFrame, by: str, buckets: int, spread: bool = True) -> DataFrame:
    """df as a table in so many buckets of ``by``: joins and groups by it do not shuffle it.

    spread deals the rows out first, so that a bucket is one file; leave it out where they lie so already.
    """
    name = f"vecloom_{uuid.uuid4().hex}"
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    rows = df.repartition(buckets, by) if spread else df
    rows.write.bucketBy(buckets, by).format("parquet").option("path", path).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._vecloom_path, out._vecloom_table = path, name
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut() and bucketed() wrote and that nothing reads any more."""
    for df in frames:
        if name := getattr(df, "_vecloom_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_vecloom_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
