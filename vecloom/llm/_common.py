"""What the operators share: row identity, scratch tables, word classes."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: White space as the contracts have it: U+0020 and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Only a session without it (a local test) gets a
    temporary folder of this machine.
    """
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
    """df, written as a table in the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, and what a scan computes is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_vecloom_path", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def forget() -> None:
    """Drop what packing remembers in this worker, as workers are kept from one operator's tasks to the next one's."""
    if module := sys.modules.get(f"{__package__}.packing"):
        module._WORKERS.clear()


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first variation of it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column that tells all its rows apart, repeated ones too, and that column's name.

    A plain Parquet scan takes the file and the row's place in it, which no retry changes. Any other
    input is written to a scratch table first, as numbers given on the fly could change in a retry.
    """
    key = free_name(df, "_row")
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
            return df.select("*", place.alias(key)), key
        except AnalysisException:  # not Parquet
            pass
    numbered = F.struct(F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("r"))
    return cut(df.select("*", numbered.alias(key))), key


def drop_rows(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows of df whose key is not among gone's, without the key column."""
    return df.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").drop(key)


def n_words(text: Column) -> Column:
    """Words in a text, long; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
