"""Mixing sources to target weights by a time-varying curriculum. Native: DataFrame functions only.

Each source has a target in words and a schedule: how heavily it is drawn at each point of training
(0 to 1). The integral of the schedule times the target is the source's cumulative demand; inverting
it at the words that precede a document, in the source's own hash order, gives the document's
training position. Documents are then range-sorted by position. A source whose target exceeds its
size is read again from its start until the demand is met.

Running sums never gather a source in one task: a source's hash order is dealt into buckets by its
leading hex digits, the number of digits follows the number of rows, and only bucket totals are
summed along a source. A bucket that stays large, as many rows of it have one id, is dealt again by the
hash of the rows' places in the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, n_words, with_row_key

#: Weights by the sources' rank, repeating, and their schedules: knots (progress, relative weight).
#: A schedule is scaled so that its integral is 1.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
ROWS_PER_BUCKET = 20_000


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(integral before, start, weight at the start, slope) of each piece of a scaled schedule."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((before, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def inverse_demand(y: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The progress at which the integral of a schedule reaches y."""
    at = F.lit(None).cast("double")
    for before, start, weight, slope in segments(knots):
        d = y - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2 * slope) * d))
        step = F.when(d == 0, F.lit(0.0)).otherwise(F.lit(2.0) * d / (F.lit(weight) + root))
        at = F.when(y >= before, F.lit(start) + step).otherwise(at)
    return at


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (no_source, source, source_size) with rank, target: demand dealt by weight below caps.

    Sources stop at cap times their size and the excess goes to the others by weight: a water level.
    In the order of cap over weight, a source is full if the level of what is left reaches its cap.
    """
    by_name = Window.orderBy("no_source", "source")
    everything = Window.partitionBy()
    by_cap = Window.orderBy("full_at", "rank")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = F.when(F.col("full_at") > F.col("level"), F.col("level"))
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("demand", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("demand") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(level).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .select("no_source", "source", "source_size", "rank", "target")
    )


def plan_mix(base: DataFrame, key: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = 1.5, cap: float = 2.0, whole: bool = False) -> DataFrame:
    """One row a document: row, id, size, source_size, target, taken, takes.

    takes lists the passes over the document: (pass, position, words); taken adds them up. The last one
    that a source's demand reaches ends within the document, or, with ``whole``, takes all of it or
    nothing, whichever is nearer to the demand. Ids may be of any type. See mix().
    """
    no_source = F.col(source_col).isNull()
    rows = cut(base.select(
        F.col(key).alias("row"), F.col(id_col).alias("id"), no_source.alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_words(F.col(text_col)).alias("size"),
    ).withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.col("row").cast("string")))))
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / ROWS_PER_BUCKET, 16)))
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    of = ["no_source", "source"]
    more = F.ceil(F.log(16.0, F.col("n") / ROWS_PER_BUCKET)).cast("int").alias("more")
    large = cut(rows.groupBy(*of, "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * ROWS_PER_BUCKET).select(*of, "bucket", more))
    if large.take(1):
        finer = F.concat("place", F.substr(F.md5(F.col("row").cast("string")), F.lit(1), F.col("more")))
        rows = rows.join(large, [*of, "bucket"], "left").withColumn("bucket", F.when(F.col("more").isNull(), F.col("bucket")).otherwise(finer)).drop("more")
    buckets = rows.groupBy(*of, "bucket").agg(F.sum("size").alias("words"))
    dealt = targets(buckets.groupBy(*of).agg(F.sum("words").alias("source_size")), weights, share, cap)
    along = Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).join(dealt, of).drop("words")
    within = Window.partitionBy(*of, "bucket").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, [*of, "bucket"])
    out = out.withColumn("start", F.col("before") + F.col("inside")).withColumn("demand", F.floor(F.col("target") + 0.5))
    kind = F.pmod(F.col("rank") - 1, F.lit(len(schedules)))
    takes = []
    for again in range(math.ceil(cap)):
        begin = F.col("start") + F.lit(again) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - begin)).cast("bigint")
        if whole:
            words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("bigint")
        y = begin / F.col("demand")
        position = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            position = F.when(kind == i, inverse_demand(y, knots)).otherwise(position)
        takes.append(F.when(words > 0, F.struct(F.lit(again).alias("pass"), position.alias("position"), words.alias("words"))))
    out = out.withColumn("takes", F.filter(F.array(*takes), lambda t: t.isNotNull()))
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda total, t: total + t["words"])
    return out.select("row", "id", "size", "source_size", "target", taken.alias("taken"), "takes")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = 1.5, cap: float = 2.0, whole: bool = False) -> DataFrame:
    """The mixture, in training order: df's columns, a row for every pass over a document.

    Sources in code point order, null last, take weights and schedules in turn. They share ``share``
    times all words; none takes more than ``cap`` times its own. A document's pass that the demand
    cuts keeps its words up to there; with ``whole`` it stays whole or goes, whichever is nearer. Texts that are null or without a word take no place in the mix
    and are left out; rows without an id are placed by their place in the input, which spreads them,
    and repeated rows count one by one, in its order. An empty table gives an empty mixture. Columns pass through under any name.
    """
    base, key = with_row_key(df)
    plan = plan_mix(base, key, id_col, source_col, text_col, weights, schedules, share, cap, whole)
    passes = plan.select("row", "size", F.explode("takes").alias("take")).select(
        F.col("row").alias(key), F.struct("size", "take.pass", "take.position", "take.words").alias(f"{key}take"))
    take, text = F.col(f"{key}take"), F.col(text_col)
    cut_text = F.when(take["words"] < take["size"], first_words(text, take["words"])).otherwise(text)
    joined = base.join(passes, key).withColumn(text_col, cut_text)
    ordered = joined.repartitionByRange(take["position"], F.col(key)).sortWithinPartitions(take["position"], F.col(key), take["pass"])
    return ordered.select(*[F.col(f"`{c}`") for c in df.columns])
