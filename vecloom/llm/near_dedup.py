"""SimHash near-dedup at a similarity of shingles: every pair at the threshold or over is found.

A text is the set of the hashes of its runs of five words (a shorter text is one run). Candidates come
from two sides, and all of them are verified on their whole sets.

The SimHash fingerprints of the sets give some by the keys of nearby Golay codewords, as in simhash:
those within two bits. Most near copies lie further apart, too far for the code at any choice of
segments, so the sets themselves give the rest, and none is lost. Two sets of Jaccard similarity 0.8 or
more share so many of their first members, in any order that is the same for all texts (prefix
filtering). That is used twice:

1. In the order of the hashes, a quarter of each set's members is counted over all texts. A text of whose
   first members too few occur elsewhere has no near copy; most texts end here.
2. The sets of the others are written as a table, and all their members are counted. In the order of these
   counts, rare ones first, two near sets share one of the first fifth: those members are the keys. What
   occurs once needs no key, so texts that share a passage, and little beside it, do not meet. Texts that
   share a key are candidates if their sizes, and what can be left of either set after the first common
   key, allow the similarity.

All counts are over all texts, at any size, and are joined as tables.

A key that many texts share is not joined with itself. Its texts are compared with a few of them
first, those that have it earliest and so hold the least of their own; after that, pairs that these
links connect already need no comparison, and all others get it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, drop_rows, forget, free_name, with_row_key
from ._graph import components
from .simhash import bit_counts, links

#: Words of a shingle; Jaccard similarity of near copies, in fifths.
WIDTH, FIFTHS = 5, 4
#: Texts that share a key are joined with each other up to this many; else compared with so many of them first.
JOINED, HUBS = 16, 2
#: Parts that the texts of a key that many share are dealt to.
SALTS = 16
#: How much longer the first prefix is, which is counted over all texts: one part in so many.
LONGER = 4
SEED = 42
#: Bits of a bitmap that goes to the workers (8 MiB).
BITMAP_BITS = 1 << 26
#: Words hashed at a time, entries in a batch.
BLOCK, ENTRIES = 1 << 16, 1 << 17


def shingles(text: bytes) -> np.ndarray:
    """The set of a text's shingle hashes, sorted. All texts without words have the same one."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    width, found = min(WIDTH, len(words)), []
    if not words:
        return np.array([digest(b"", SEED)], dtype=np.uint64)
    for at in range(0, len(words) - width + 1, BLOCK):
        block = words[at : at + BLOCK + width - 1]
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), dtype=np.int64, count=len(block)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(block) - width] + 1))
        found.append(np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, as an array of one."""
    ones = sum(bit_counts(found[at : at + BLOCK]) for at in range(0, len(found), BLOCK))
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def marks(values: DataFrame, column: str):
    """A bitmap of the hashes of a column, broadcast: its size is fixed, whatever the number of values."""
    words = values.select(place_of(column).alias("h")).select(F.shiftright("h", 5).alias("at"), F.expr("shiftleft(1L, cast(h & 31 as int))").alias("bits"))
    out = np.zeros(BITMAP_BITS >> 5, dtype=np.uint32)
    for r in words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return values.sparkSession.sparkContext.broadcast(out)


def hits(bits, hashes: pa.Array) -> np.ndarray:
    """Which places are in the bitmap: those of all that went into it, and few others while it is not full."""
    at = hashes.to_numpy()
    return (bits.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def place_of(column: str) -> Column:
    return F.xxhash64(column).bitwiseAND(BITMAP_BITS - 1)


def only(df: DataFrame, bits, column: str, marked: bool = True) -> DataFrame:
    """The rows of df whose column is in the bitmap, or not in it."""
    name = free_name(df, "_place")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(hits(bits, part.column(part.num_columns - 1)) == marked)).select(part.schema.names[:-1])

    return df.withColumn(name, place_of(f"`{column}`")).mapInArrow(batches, df.schema)


def needed(n: np.ndarray) -> np.ndarray:
    """How many members two near sets share among the first(n) of each, where the smaller has n."""
    return 1 + (n - (FIFTHS * n + 4) // 5 + 1) // LONGER


def first(n: np.ndarray) -> np.ndarray:
    """So many members of a set of n are its first prefix."""
    return np.minimum(n, n - (FIFTHS * n + 4) // 5 + needed(n))


def sketches(rows: DataFrame) -> DataFrame:
    """key, doc, need, row: the first members of each text by hash, and the text's number.

    One row a text has its fingerprint as key and the text's row, which is null elsewhere; need is how many
    of its members must occur in other texts as well, if it has a near copy.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        begin, seen = TaskContext.get().partitionId() << 33, 0

        def batch() -> pa.RecordBatch:
            many, n = np.array([len(k) for k in keys]), np.array(sizes, dtype=np.int64)
            last = np.zeros(many.sum(), dtype=bool)
            last[np.cumsum(many) - 1] = True
            doc = begin + seen + np.repeat(np.array(at, dtype=np.int64), many)
            need = np.repeat(needed((FIFTHS * n + 4) // 5), many)  # a near set has at least so many members
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(doc), pa.array(need.astype(np.int32)), part.column(0).take(pa.array(np.repeat(at, many), mask=~last))], ["key", "doc", "need", "row"])

        for part in parts:
            keys, at, sizes, held = [], [], [], 0
            for i, text in enumerate(part.column(1).cast(pa.binary())):
                found = shingles(text.as_py() or b"")
                keys.append(np.concatenate((found[: int(first(np.int64(len(found))))], fingerprint(found))))
                at.append(i)
                sizes.append(len(found))
                held += len(keys[-1])
                if held > ENTRIES:
                    yield batch()
                    keys, at, sizes, held = [], [], [], 0
            if keys:
                yield batch()
            seen += part.num_rows

    return rows.mapInArrow(batches, f"key bigint, doc bigint, need int, row {rows.schema['row'].dataType.simpleString()}")


def repeated(entries: DataFrame) -> DataFrame:
    """key, n: the keys that several entries have, as a table."""
    return cut(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))


def known_sets(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, set of docs (doc, row), as a table. Texts that are not among them are not moved."""
    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                some = some.filter(pa.array(hits(bits, some.column(2))))
                held = [shingles(text.as_py() or b"").view(np.int64) for text in some.column(1).cast(pa.binary())]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held) if held else np.zeros(0, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["row", "set"])

    bits = marks(docs, "row")
    found = rows.select("row", "text", place_of("row").alias("place")).mapInArrow(sets, f"row {rows.schema['row'].dataType.simpleString()}, set array<bigint>")
    out = cut(found.join(docs, "row").select("doc", "set"))
    bits.unpersist()
    return out


def prefix_keys(sets: DataFrame) -> DataFrame:
    """key, doc, about: the keys of each set, and about = size * 2 ** 32 + how much of the set begins at the key."""
    entries = sets.select("doc", F.size("set").alias("size"), F.explode("set").alias("key"))
    often = repeated(entries)
    of = entries.join(often, "key").groupBy("doc").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))  # bounded by the set
    alone = F.col("size") - F.size("shared")
    prefix = F.col("size") - F.floor((FIFTHS * F.col("size") + 4) / 5) + 1
    keys = F.slice("shared", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))
    each = of.select("doc", "size", F.size("shared").alias("rest"), F.posexplode(keys).alias("at", "k"))
    about = F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR((F.col("rest") - F.col("at")).cast("bigint"))
    return each.select(F.col("k.key").alias("key"), "doc", about.alias("about"))


def side(members: DataFrame, name: str, *more: str) -> DataFrame:
    return members.select("key", *(["salt"] if "salt" in members.columns else []), *[F.col(c).alias(f"{c}_{name}") for c in ("doc", "about", *more)])


def dealt(members: DataFrame) -> DataFrame:
    """members, each in one of SALTS parts of its key."""
    return members.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(SEED)), F.lit(SALTS)).cast("int"))


def everywhere(df: DataFrame) -> DataFrame:
    """df, once for each part of its key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def size_of(about: str) -> Column:
    return F.shiftright(about, 32)


def rest_of(about: str) -> Column:
    return F.col(about).bitwiseAND((1 << 32) - 1)


def may_be_near() -> Column:
    """Whether the sets of two sides can be near if the key is the first that they have in common."""
    return 9 * F.least(rest_of("about_a"), rest_of("about_b")) >= FIFTHS * (size_of("about_a") + size_of("about_b"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (doc, set) are near; those of docs without a set are not."""
    of = lambda name: sets.select(F.col("doc").alias(name), F.col("set").alias(f"set_{name}"))
    common = F.size(F.array_intersect("set_a", "set_b")).alias("common")
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", (F.size("set_a") + F.size("set_b")).alias("sizes"), common)
    return cut(both.filter(5 * F.col("common") >= FIFTHS * (F.col("sizes") - F.col("common"))).select("a", "b"))


def alike_prints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of docs (doc, fp) that connect all fingerprints within two bits, found by their Golay keys."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc").alias("first")))
    same = prints.join(nodes, "fp").filter("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    of = lambda name: nodes.select(F.col("fp").alias(f"fp_{name}"), F.col("first").alias(name))
    close = links(nodes).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.unionByName(close.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b"))


def near_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, docs): a, b that connect the docs of every pair of near texts, and no others; doc, row of every text."""
    found = cut(sketches(rows))
    docs = cut(found.filter("row is not null").select("doc", "row", F.col("key").alias("fp")))
    close = cut(alike_prints(docs.select("doc", "fp")))
    entries = found.filter("row is null").select("key", "doc", "need")
    shared = repeated(entries)
    bits = marks(shared, "key")
    met = only(entries, bits, "key").join(shared, "key").groupBy("doc", "need").agg(F.count("*").alias("n")).filter("n >= need")
    open_docs = cut(docs.select("doc", "row").join(met.select("doc"), "doc"))
    bits.unpersist()
    discard(found, shared)
    sets = known_sets(rows, open_docs)
    keys = cut(prefix_keys(sets))
    members = cut(keys.join(repeated(keys), "key"))
    discard(keys, open_docs)
    few, hot = members.filter(F.col("n") <= JOINED), dealt(members.filter(F.col("n") > JOINED))
    pair = (F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    pairs = side(few, "a").join(side(few, "b"), "key").filter((F.col("doc_a") < F.col("doc_b")) & may_be_near()).select(*pair)
    place = F.struct((size_of("about") - rest_of("about")).alias("before"), F.xxhash64("doc").alias("h"), "doc", "about")
    chosen = [F.min(place).alias("hub0"), *[F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), "doc", "about")).alias(f"hub{i}") for i in range(1, HUBS)]]
    hubs = hot.groupBy("key").agg(*chosen).select("key", F.explode(F.array_distinct(F.array(*[F.struct(f"hub{i}.doc", f"hub{i}.about") for i in range(HUBS)]))).alias("hub")).select("key", "hub.*")
    first = side(hot, "a").join(side(everywhere(hubs), "b"), ["key", "salt"]).filter((F.col("doc_a") != F.col("doc_b")) & may_be_near()).select(*pair)
    tested = cut(ordered(pairs.unionByName(first).unionByName(close)))
    near = verified(sets, tested)
    roots = components(near)
    labelled = cut(hot.join(roots, hot["doc"] == roots["node"], "left").select("key", "salt", "doc", "about", F.coalesce("root", "doc").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("label", "n").alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("key", "most")
    open_ = labelled.join(everywhere(most), ["key", "salt"])
    rest = side(everywhere(open_.filter("label != most").drop("salt")), "a", "label").join(side(open_, "b", "label"), ["key", "salt"])
    rest = ordered(rest.filter((F.col("label_a") != F.col("label_b")) & may_be_near()).select(*pair))
    more = verified(sets, cut(rest.join(tested, ["a", "b"], "left_anti")))
    discard(members, labelled, tested, close, sets)
    return near.unionByName(more), docs


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each set of texts that near copies connect: all columns of the rows that stay.

    The row with the smallest id stays; a null id comes after all others, a null text is empty, and
    texts without words are copies of one another. Ids may be of any type that sorts. An empty table
    gives an empty result; columns may have any names.
    """
    base, key = with_row_key(df)
    edges, docs = near_links(base.select(F.col(key).alias("row"), F.col(text_col).alias("text")))
    roots = components(edges)
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    linked = cut(docs.join(linked, docs["doc"] == linked["node"]).select("row", "root"))
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    best = base.select(F.col(key).alias("row"), F.col(id_col).alias("id")).join(linked, "row").groupBy("root").agg(F.min(entry)["row"].alias("best"))
    gone = cut(linked.join(best, "root").filter("row != best").select("row"))
    bits = marks(gone, "row")  # rows that surely stay are not moved
    return only(base, bits, key, False).drop(key).unionByName(drop_rows(only(base, bits, key), key, gone, "row"))
