"""Draws by Zipf's law, for query loads with hot items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items whose cumulated probabilities are broadcast, at most (8 bytes each).
ITEMS = 1_000_000
BITS = 52


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, BITS // 4), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << BITS))


def draw(df: DataFrame, key: str, items: int, exponent: float) -> DataFrame:
    """df with item, 1 to items: item i comes up in proportion to 1 / i ** exponent.

    A row's draw follows from its key. The cumulated probabilities are a bounded table; a row finds its
    place in it by bisection, without a shuffle. A null key draws nothing (null).
    """
    if not 0 < items <= ITEMS:
        raise ValueError(f"items must be from 1 to {ITEMS}")
    total, upto = sum(i**-exponent for i in range(1, items + 1)), []
    at = 0.0
    for i in range(1, items + 1):
        at += i**-exponent
        upto.append(at / total)
    table = df.sparkSession.createDataFrame([(upto,)], "_upto array<double>")
    steps = max(1, items.bit_length())
    low = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("a"), F.lit(items - 1).alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).when(
            F.get("_upto", F.floor((s["a"] + s["b"]) / 2).cast("int")) > F.col("_u"), F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b"))).otherwise(
            F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))), lambda s: s["a"])
    rows = df.withColumn("_u", uniform(F.col(key))).join(F.broadcast(table), F.lit(True))
    return rows.withColumn("item", F.when(F.col("_u").isNotNull(), low + 1)).drop("_u", "_upto")
