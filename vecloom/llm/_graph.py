"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not the smallest of its component.

    Each round hangs a node's larger neighbours, then its smaller ones, under the smallest node known
    to either; the rounds end when every component is a star, after about log of the longest path.
    State is one row an edge; rounds write it to the shared folder, and the smallest neighbours too: so the
    join with them is one of two plain shuffles, which Spark splits where a node has very many edges.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        discard(now, near)
        now, seen = after, mark
