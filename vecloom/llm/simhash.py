"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
two bits agree on a whole segment (pigeonhole), and within the next segment they differ in at most
two bits: then some word is at most one bit from either. Decoding, by the perfect [23,12,7] Golay
code, a segment and its one-bit variations therefore gives both a codeword index in common. So a
fingerprint has, for each of the three clean segments, that segment's bits with one to six codeword
indices of the next: about 16 keys of 34 bits. Distinct fingerprints that share a key are joined and
verified bit by bit.

A key that many fingerprints share (a large group of near copies) is not joined with itself. Its
fingerprints meet instead at the words one bit away: those that differ in at most two bits share such
a word, any two that share one differ in at most two, and at most 65 fingerprints can share one.
Links, not pairs of copies, go on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop_rows, with_row_key
from ._graph import components

#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11
#: Offset and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that share a key are joined with each other up to this many.
JOINED = 16
SEED = 42
#: Words hashed at a time: long texts need no more memory than this many.
BLOCK = 1 << 16


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error pattern of up to three bits of each syndrome."""
    bit = np.zeros(LENGTH, dtype=np.int64)
    for i in range(LENGTH):
        r = 1 << i
        for j in range(i, CHECK_BITS - 1, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - CHECK_BITS)
        bit[i] = r
    leader = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            leader[np.bitwise_xor.reduce(bit[list(places)])] = sum(1 << p for p in places)
    return bit, leader


def codewords(words: np.ndarray, width: int) -> np.ndarray:
    """The codeword indices of each word and of its one-bit variations: one row a word, with repeats."""
    bit, leader = golay()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for i in range(width):
        syndrome ^= (words >> i & 1) * bit[i]
    near = [(words ^ leader[syndrome]) >> CHECK_BITS]
    near += [(words ^ (1 << i) ^ leader[syndrome ^ bit[i]]) >> CHECK_BITS for i in range(width)]
    return np.stack(near, axis=1)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key): each key once a fingerprint."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    segment = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    owners, keys = [], []
    for clean in range(3):
        after = (clean + 1) % 3
        near = np.sort(codewords(segment[after], SEGMENTS[after][1]), axis=1)
        first = np.ones(near.shape, dtype=bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        owner, column = np.nonzero(first)
        owners.append(owner)
        keys.append(clean << 40 | segment[clean][owner] << 12 | near[owner, column])
    return np.concatenate(owners), np.concatenate(keys)


@cache
def lanes() -> np.ndarray:
    """Of each byte, its eight bits in the eight byte lanes of a 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    spread = lanes()[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)  # a lane holds up to 255
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    width, total, counts, digest = min(shingle, len(words)), 0, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, BLOCK):
        block = words[at : at + BLOCK + width - 1]
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), dtype=np.int64, count=len(block)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(block) - width] + 1))
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]
        counts += bit_counts(np.array(hashes, dtype=np.uint64))
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(base: DataFrame, key: str, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """row, id, fp (a signed long), run (the partition: a fingerprint that many rows have stays spread)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(2).cast(pa.binary())
            found = pa.array((fingerprint(x.as_py() or b"", shingle) for x in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["row", "id", "fp"])

    rows = base.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(batches, f"row struct<f:bigint,r:bigint>, id {rows.schema['id'].dataType.simpleString()}, fp bigint")
    return out.withColumn("run", F.spark_partition_id())


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints fp of nodes at two or fewer differing bits."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = part.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                owner, keys = golay_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[owner])], ["key", "fp"])

    keyed = cut(nodes.select("fp").mapInArrow(batches, "key bigint, fp bigint"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))  # a table: Spark splits the join's hot keys
    members = cut(keyed.join(shared, "key"))
    few = members.filter(F.col("n") <= JOINED)
    joined = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b")
    joined = joined.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), i)) for i in range(64)])
    many = members.filter(F.col("n") > JOINED).select("fp").distinct()
    meeting = many.select("fp", F.explode(near).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return joined.unionByName(star)


def near_classes(base: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """near_dedup() of a table whose column key tells its rows apart."""
    rows = cut(fingerprints(base, key, id_col, text_col, shingle))
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    runs = cut(rows.groupBy("run", "fp").agg(F.min(entry).alias("best")))
    nodes = cut(runs.groupBy("fp").agg(F.min("best").alias("best")))
    roots = components(links(nodes))
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("best").alias("best"))
    classes = linked.select("fp", "root").join(best, "root").select("fp", "best")
    back = runs.select("run", "fp").join(classes, "fp")
    return rows.join(back, ["run", "fp"]).select(
        "row", "id", "fp", F.col("best.id").alias("component_id"), (F.col("best.row") == F.col("row")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of df: row (its key), id, fp, component_id, kept.

    fp is the 64-bit fingerprint as a signed long; fingerprints at two or fewer differing bits are
    linked, and component_id is the smallest id that links reach. One row of a component is kept: that
    with the smallest id. A null id comes after all others; a null text is the empty text, whose
    fingerprint is zero; repeated rows are copies like any other. An empty table gives an empty
    result; other columns are not read.
    """
    return near_classes(*with_row_key(df), id_col, text_col, shingle)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """df with one row of each component: all columns of the rows that stay.

    near_dedup() says which rows are linked and which one stays, for null ids and texts, ties and
    repeated rows too. An empty table stays empty; columns may have any names.
    """
    base, key = with_row_key(df)
    gone = near_classes(base, key, id_col, text_col, shingle).filter("not kept")
    return drop_rows(base, key, gone, "row")
