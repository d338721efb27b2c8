"""Prefix trie of conversations by distributed MSD radix partitioning and multikey quicksort.

Turns (role, text) are dictionary-encoded, so that a conversation is a sequence of numbers; equal
sequences are one class, with its members counted and their ids hashed. A bucket holds the classes that
share a prefix, at first all of them. In each round Spark takes every large bucket apart: the smallest
and the largest sequence give the prefix that all have in common (a chain of nodes without branches),
and the turn after it is the radix that deals the bucket's classes to its children. Buckets that have
become small enough for a task are finished there: multikey quicksort divides the rows by their turn at
one depth into smaller, equal and larger ones, and what is equal is a child node, sorted by the next
turn. What nodes sum over their subtrees then goes up again, round by round.

A node's key is its smallest member and its depth. Large buckets always branch, so rounds end; each
holds one row a class, whatever a bucket's size, and no bucket over the limit reaches a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard

#: Turns of a bucket that one task finishes: at most, and (where that is less, a share of all) at least.
LOCAL_TURNS, LEAST_TURNS = 1 << 16, 1 << 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
_END = -1


def sequences(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids, bytes: of each conversation the numbers of its turns, in order, and the UTF-8 bytes of their texts.

    Numbers are those of a dictionary of all distinct (role, text), in that order. Turns go by turn_col,
    null first, equal ones by role and text; null roles and texts are empty, rows without an id are left out.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = cut(df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")))
    words = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    known = cut(words.select("role", "text", F.monotonically_increasing_id().alias("id"), F.octet_length("text").cast("bigint").alias("bytes")))
    turns = rows.join(known, ["role", "text"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "bytes"))).alias("t"))
    return turns.select("conv_id", F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"))


def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def classes(seqs: DataFrame) -> DataFrame:
    """ids, bytes, n, first, ends: one row a distinct sequence; how many have it, the smallest, and a hash of all in order.

    Members are joined up in ranges of ids first, so that a sequence that very many have is a row a range.
    """
    of = seqs.schema["conv_id"].dataType
    ranges = seqs.repartitionByRange("conv_id").select("*", F.spark_partition_id().alias("range"))
    members = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ranges.groupBy("ids", "range").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("first"), members.alias("members"))

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now = None
            for ids, sizes, n, first, members in rows_of(parts):
                if now is None or ids != now[0]:
                    if now is not None:
                        yield (*now[:4], ends.hexdigest())
                    now, ends = [ids, sizes, n, first], hashlib.sha256(members.encode())
                else:
                    now[2] += n
                    ends.update(b"," + members.encode())
            if now is not None:
                yield (*now[:4], ends.hexdigest())

        return batched(rows(), arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    lists = pa.list_(pa.int64())
    arrow = pa.schema([("ids", lists), ("bytes", lists), ("n", pa.int64()), ("first", to_arrow_type(of)), ("ends", pa.string())])
    ordered = chunks.select("ids", "bytes", "n", "first", "members").repartition("ids").sortWithinPartitions("ids", "first")
    return ordered.mapInArrow(merge, f"ids array<bigint>, bytes array<bigint>, n bigint, first {of.simpleString()}, ends string")


class Local:
    """The nodes of one bucket, by multikey quicksort of its classes (ids, bytes, n, first, ends)."""

    def __init__(self, rows: list[tuple], depth: int) -> None:
        self.rows, self.top = rows, depth
        self.conv, self.depth, self.parent, self.n, self.children, self.own, self.ends = [], [], [], [], [], [], []
        self.todo = []
        self.node(rows, depth, -1)
        while self.todo:
            self.divide(*self.todo.pop())

    def node(self, rows: list[tuple], depth: int, parent: int) -> None:
        """Rows share their first depth turns: that is a node, whose children sorting will find."""
        n = sum(r[2] for r in rows)
        self.conv.append(min(r[3] for r in rows))
        self.depth.append(depth)
        self.parent.append(parent)
        self.n.append(n)
        self.children.append(0)
        self.own.append((n - 1) * rows[0][1][depth - 1] if depth else 0)
        self.ends.append(NO_ENDS)
        if parent >= 0:
            self.children[parent] += 1
        self.todo.append((rows, depth, len(self.n) - 1))

    def divide(self, rows: list[tuple], depth: int, node: int) -> None:
        """Three ways by the turn at this depth: equal rows go down as a child, the others on at this depth."""
        symbol = lambda r: r[0][depth] if len(r[0]) > depth else _END
        pivot = sorted((symbol(rows[0]), symbol(rows[len(rows) // 2]), symbol(rows[-1])))[1]
        less, equal, more = [], [], []
        for r in rows:
            s = symbol(r)
            (less if s < pivot else more if s > pivot else equal).append(r)
        for rest in (less, more):
            if rest:
                self.todo.append((rest, depth, node))
        if pivot == _END:
            self.ends[node] = equal[0][4]  # classes are distinct: one of them ends here
        else:
            self.node(equal, depth + 1, node)

    def output(self, parent: object, tag: object) -> Iterator[tuple]:
        """Rows of all nodes; parent: what the bucket hangs under, tag: goes with its top row."""
        leaves, saved = [int(c == 0) for c in self.children], list(self.own)
        for i in range(len(self.n) - 1, 0, -1):  # children come after their parents
            leaves[self.parent[i]] += leaves[i]
            saved[self.parent[i]] += saved[i]
        for i in range(len(self.n)):
            above = parent if i == 0 else self.conv[self.parent[i]]
            yield self.conv[i], self.depth[i], above, self.n[i], self.children[i], leaves[i], saved[i], self.ends[i], tag if i == 0 else None


def finish(small: DataFrame) -> DataFrame:
    """All nodes of the small buckets (bucket, depth, parent, step, ids, bytes, n, first, ends); step stays on a bucket's top row."""
    from pyspark.sql.pandas.types import to_arrow_type

    of = small.schema["first"].dataType
    one, number = to_arrow_type(of), pa.int64()
    arrow = pa.schema([("conv_id", one), *[(c, number if c != "parent_conv_id" else one) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("step", number)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            head, held = None, []
            for bucket, depth, parent, step, *row in rows_of(parts):
                if head is not None and bucket != head[0]:
                    yield from Local(held, head[1]).output(*head[2:])
                    held = []
                head = (bucket, depth, parent, step)
                held.append(tuple(row))
            if held:
                yield from Local(held, head[1]).output(*head[2:])

        return batched(rows(), arrow)

    id_type = of.simpleString()
    ordered = small.select("bucket", "depth", "parent", "step", "ids", "bytes", "n", "first", "ends").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, f"conv_id {id_type}, depth bigint, parent_conv_id {id_type}, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, step bigint")


def common(low: Column, high: Column) -> Column:
    """How many elements two arrays begin with in common."""
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b))
    return F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)).cast("bigint")


def trie_nodes(seqs: DataFrame, local_turns: int | None = None) -> DataFrame:
    """The trie of seqs (conv_id, ids, bytes), one row a node.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (nodes without children in the subtree), saved_tokens (summed over the subtree, each node's members but
    one times the bytes of its last text), ends_sha256 (of the ids that end at the node, ascending and joined
    by commas). Subtrees include their top. Ids must be distinct and not null; a sequence may be empty, which
    then ends at the root. No sequences give no nodes.
    """
    spark, id_type = seqs.sparkSession, seqs.schema["conv_id"].dataType.simpleString()
    done = cut(classes(seqs))
    first, turns = done.agg(F.min("first"), F.sum(F.size("ids"))).first()
    columns = f"conv_id {id_type}, depth bigint, parent_conv_id {id_type}, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if first is None:
        return spark.createDataFrame([], columns)
    if local_turns is None:
        parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        local_turns = min(LOCAL_TURNS, max(LEAST_TURNS, turns // parts))
    now = done.select(F.lit(first).cast(id_type).alias("bucket"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast(id_type).alias("parent"), "*")
    heads, locals_, step = [], None, 0
    while True:  # the root is always dealt out by Spark, then each bucket that is over the limit
        ends = now.groupBy("bucket").agg(
            F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n").alias("n"), F.min(F.struct("ids", "bytes", "ends")).alias("low"), F.max("ids").alias("hi"))
        head = cut(ends.withColumn("common", common(F.col("low.ids"), F.col("hi"))).drop("hi"))
        heads.append(head)
        rows = now.drop("depth", "parent")  # the root is one bucket: its head needs no join
        rows = rows.join(head.select("bucket", "common"), "bucket") if step else rows.withColumn("common", F.lit(head.first()["common"]).cast("bigint"))
        keyed = cut(rows.filter(F.size("ids") > F.col("common")).withColumn("radix", F.col("ids")[F.col("common").cast("int")]))
        kids = keyed.groupBy("bucket", "radix").agg(F.min("first").alias("child"), F.count("*").alias("classes"), F.sum(F.size("ids")).alias("turns"))
        dealt = cut(keyed.join(kids, ["bucket", "radix"]).select(
            F.col("child").alias("bucket"), (F.col("common") + 1).alias("depth"), F.col("bucket").alias("parent"), "ids", "bytes", "n", "first", "ends",
            ((F.col("classes") > 1) & (F.col("turns") > local_turns)).alias("large")))
        small = dealt.filter("not large").drop("large").withColumn("step", F.lit(step).cast("bigint"))
        locals_ = small if locals_ is None else locals_.unionByName(small)
        discard(keyed)
        now = dealt.filter("large").drop("large")
        if not now.take(1):
            break
        step += 1
    leaves = cut(finish(locals_))
    out = leaves.drop("step")
    above = None
    for at in range(step, -1, -1):
        found = leaves.filter(F.col("step") == at).select(F.col("parent_conv_id").alias("bucket"), "n_leaves", "saved_tokens")
        if above is not None:
            found = found.unionByName(above)
        sums = found.groupBy("bucket").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("kids"))
        chain = cut(heads[at].join(sums, "bucket", "left").select("*", F.explode(F.sequence("depth", "common")).alias("at")))
        whole = F.aggregate(F.slice("low.bytes", F.greatest("at", F.lit(1)).cast("int"), (F.col("common") - F.greatest("at", F.lit(1)) + 1).cast("int")), F.lit(0).cast("bigint"), lambda a, b: a + b)
        last = F.col("at") == F.col("common")
        nodes = chain.select(
            F.col("bucket").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") > F.col("depth"), F.col("bucket")).otherwise(F.col("parent")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.coalesce("kids", F.lit(0))).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * whole).cast("bigint").alias("saved_tokens"),
            F.when(last & (F.size("low.ids") == F.col("common")), F.col("low.ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
        above = chain.filter(F.col("at") == F.col("depth")).select(F.col("parent").alias("bucket"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * whole).cast("bigint").alias("saved_tokens"))
        out = out.unionByName(nodes)
    return out


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations in df (one row a turn); sequences() says what becomes of nulls and ties, trie_nodes() what a node is.

    Repeated rows are repeated turns. An empty table has no nodes; other columns are not read.
    """
    return trie_nodes(cut(sequences(df, id_col, turn_col, role_col, text_col)))
