"""Sharding by extendible hashing.

A document's hash is a string of bits. The directory is indexed by the leading ``depth`` bits; a bucket
is a shorter prefix, and only a bucket whose documents exceed the byte limit splits on its next bit.
The buckets are found bottom up in one aggregation: cells of ``depth`` bits are summed into all their
prefixes, and each cell belongs to its shortest prefix that fits. Cells that are still too large are
looked at again, deeper, with the rows of those cells only.

The leading bits are those of the id's hash, after them come as many of the row's place in the input: rows
with one id lie together as long as they fit and split like any others where they do not, however many
they are. Rows without an id have the bits of their place alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, free_name, with_row_key

#: Production limit of a shard's text; readers that a table is to be dealt to, at least.
SHARD_BYTES = 64 << 20
READERS = 16
#: Bits of an id's hash, and of a place's, which come after them.
BITS = 60
#: Bits that each look goes deeper than evenly filled buckets would need.
SPARE_BITS = 3


def hash_bits(value: Column) -> Column:
    """The leading 60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(bits: Column, depth) -> Column:
    return F.shiftright(bits, F.lit(BITS) - depth) if not isinstance(depth, int) else F.shiftright(bits, BITS - depth)


def directory(rows: DataFrame, shallow: int, depth: int, limit: int) -> DataFrame:
    """Cells of depth bits with the bucket each belongs to: before, cell, local_depth, bucket, bytes, docs.

    Rows have the bits that were used ``before`` and those looked at now. Buckets have at least
    ``shallow`` of these. One that holds a single row is not split, whatever its size; a cell that does
    not fit even at ``depth`` has a bucket of its own, too large.
    """
    cells = rows.groupBy("before", prefix(F.col("bits"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    up = cells.select("*", F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("local_depth"))
    up = up.withColumn("bucket", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    sums = up.groupBy("before", "local_depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    fits = sums.filter((F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("local_depth") == depth))
    found = up.select("before", "cell", "local_depth", "bucket").join(fits, ["before", "local_depth", "bucket"])
    return found.groupBy("before", "cell").agg(F.min(F.struct("local_depth", "bucket", "bytes", "docs")).alias("of")).select("before", "cell", "of.*")


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, readers: int = 1) -> DataFrame:
    """One row per row of df: row (its key), id, bytes, shard, local_depth, shard_bytes, shard_docs.

    bytes is the text's length in UTF-8 (null: 0). A shard holds at most ``limit`` bytes, and at most
    its part of all bytes if they are dealt to so many readers. shard is the bucket's bits as a string
    of 0 and 1, empty if all fits into one shard. Ids may be of any type. Rows with the same id lie in
    one shard if they fit; those without an id are dealt by their place in the input. Only a single
    row that is larger than the limit makes a shard larger than it (or rows whose ids and places agree
    in all 60 bits of both hashes). An empty table gives an empty result; other columns are not read.
    """
    base, key = with_row_key(df)
    return place(base, key, id_col, text_col, limit, readers)


def place(base: DataFrame, key: str, id_col: str, text_col: str, limit: int, readers: int = 1) -> DataFrame:
    of_id, of_row = hash_bits(F.col(id_col).cast("string")), hash_bits(F.col(key).cast("string"))
    rows = cut(base.select(
        F.col(key).alias("row"), F.col(id_col).alias("id"), F.lit(-1).cast("bigint").alias("before"), F.coalesce(of_id, of_row).alias("bits"), of_row.alias("after"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    limit = min(limit, total // readers)
    shallow, used, done, out = 0, 0, [], rows
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / max(1, limit))))) + SPARE_BITS)
    while True:
        found = cut(directory(out, shallow, depth, limit))
        over = found.filter((F.col("bytes") > limit) & (F.col("docs") > 1))
        last = used and depth == BITS or not over.take(1)
        of = ["before", "cell"]
        final = found if last else found.join(over.select(*of), of, "left_anti")
        celled = out.withColumn("cell", prefix(F.col("bits"), depth))
        done.append(celled.join(final.withColumnRenamed("bytes", "shard_bytes"), of).withColumn("used", F.lit(used)))
        if last:
            break
        out = celled.join(over.select(*of), of, "left_semi").drop("cell")
        if depth == BITS:  # rows of one id, or nearly so: on by their places
            out = cut(out.withColumn("before", F.col("bits")).withColumn("bits", F.col("after")))
            shallow, used, depth = 0, BITS, 4 * SPARE_BITS
        else:
            shallow, depth = depth, min(BITS, depth + 4 * SPARE_BITS)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    bits = F.when(F.col("local_depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bucket), local_depth, '0')"))
    name = F.when(F.col("used") > 0, F.concat(F.lpad(F.bin("before"), BITS, "0"), bits)).otherwise(bits)
    return result.select("row", "id", "bytes", name.alias("shard"), (F.col("local_depth") + F.col("used")).alias("local_depth"), "shard_bytes", F.col("docs").alias("shard_docs"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, readers: int = 1) -> None:
    """Write df's rows in one folder a shard, each by one task, under path/shard=b<bits>.

    Null ids, ties and repeated rows are placed as assign_shards() says and written like any other row.
    An empty table writes no shard. With a column named shard the folders are called shard_=b<bits>.
    """
    base, key = with_row_key(df)
    name = free_name(df, "shard")
    shards = place(base, key, id_col, text_col, limit, readers).select(F.col("row").alias(key), F.concat(F.lit("b"), "shard").alias(name))
    base.join(shards, key).drop(key).repartitionByRange(name).write.partitionBy(name).parquet(path)
