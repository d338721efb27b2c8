"""Exact dedup by a tree-merge of sorted digest runs. Native: DataFrame functions only.

Every input partition is a run: its rows' digests, sorted, one entry a digest. Runs then merge in
binomial rounds: in each, ``fan_in`` partner runs (two, or a small power of two) exchange their entries
and become one run, so that a round leaves a ``fan_in``-th of the runs, and as many rounds follow one
another as the number of partitions asks for, until one run is left. Partners meet by (merged run,
digest), Spark sorts what meets, and one pass over the sorted streams keeps the smallest identifier
and adds up the counts. A run is a sorted sequence, not a task: its entries lie in as many tasks as
there are. Every level compares entries by SHA-256, length and an independent 64-bit checksum
together, so an identifier only wins over texts that all three verify.

A text that a third of all rows share is one entry a run and at most ``fan_in`` entries a merge. The
winners travel back only for groups of two rows or more: first to the run entries, then from each
run's entry to its own rows, so that the rows of a hot group stay spread over as many keys as the
input has partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, cut, drop_rows, with_row_key

DIGEST = ("sha", "chars", "sum64")
#: Runs that merge into one in a round.
FAN_IN = 4


def digest_runs(df: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its run, digest columns, identifier and row key."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return df.select(F.col(key).alias("row"), F.col(id_col).alias("id"), text.alias("t")).select(
        "row",
        "id",
        F.spark_partition_id().alias("run"),
        F.sha2("t", 256).alias("sha"),
        F.length("t").alias("chars"),
        F.xxhash64("t").alias("sum64"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Merge fan_in partner runs each into one: the smallest entry and the count of every digest, sorted."""
    up = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    return runs.groupBy(up, *DIGEST).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_tree(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> list[DataFrame]:
    """Every level of the tree, from the runs on; the last one is a single run."""
    levels = [runs]
    while n_runs > 1:
        levels.append(merge_round(levels[-1], fan_in))
        n_runs = -(-n_runs // fan_in)
    return levels


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of df: row (its key), id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space becomes one space; a null text is
    the empty text. Of a group, the row with the smallest id stays (ids may be of any type that sorts);
    a null id comes after all others, and of rows with the same id (repeated rows) one stays. keep_id
    is null only where a group has no id at all. An empty table gives an empty result; other columns
    are not read.
    """
    return resolve(*with_row_key(df), id_col, text_col, fan_in)


def resolve(base: DataFrame, key: str, id_col: str, text_col: str, fan_in: int = FAN_IN) -> DataFrame:
    """exact_dedup() of a table whose column key tells its rows apart."""
    rows = cut(digest_runs(base, key, id_col, text_col))
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    runs = cut(rows.groupBy("run", *DIGEST).agg(F.min(entry).alias("best"), F.count("*").alias("n")).sortWithinPartitions("run", *DIGEST))
    merged = merge_tree(runs, n_runs, fan_in)[-1]
    groups = merged.filter("n > 1").select(*DIGEST, "best", F.col("n").alias("group_size"))
    back = runs.select("run", *DIGEST).join(groups, list(DIGEST)).select("run", *DIGEST, "best", "group_size")
    alone = F.col("group_size").isNull()
    return rows.join(back, ["run", *DIGEST], "left").select(
        "row",
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the copies: all columns of the rows that stay.

    Which rows are copies, and which one of them stays, exact_dedup() says, for null ids and texts,
    ties and repeated rows too. An empty table stays empty; columns may have any names.
    """
    base, key = with_row_key(df)
    gone = resolve(base, key, id_col, text_col).filter("not kept")
    return drop_rows(base, key, gone, "row")
