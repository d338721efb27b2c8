"""Exact top-k by inner product with a three-phase uniform threshold.

The dimensions are split into lists; a vector's score is the sum of its scores in the lists. For a
block of queries:

1. every list gathers its own highest scores; the vectors found are scored in full, and the k-th
   highest of these is a bound that no result can be below;
2. the bound over the number of lists is the cutoff, broadcast to all: a vector below it in every
   list is below the bound in total. Each list collects its entries from the cutoff up. Vectors
   collected from all lists have their score; any other is at most what it has plus the cutoff less
   one for each list it is missing from, and goes if that is below the bound, which rises meanwhile;
3. the scores still open are resolved from the whole vectors, and the k highest remain.

Equal vectors have equal scores, so the search is over classes of equal vectors, of which each holds
only its smallest ids: a vector that a third of all rows share is one entry of a list. The ids come
back at the end, to the k best classes of a query.

Scores are integers and nothing is approximated. Queries go in blocks of at most ``QUERY_BLOCK``
vectors, so that what is broadcast (the block and its cutoffs) does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

QUERY_BLOCK = 4096
#: Vectors multiplied at a time with a block of queries.
ROWS = 1024
LOWEST = np.iinfo(np.int64).min


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * x) of every component of the rows that take part.

    Rows without an id and vectors that are null, empty or hold a null or non-finite component do not.
    """
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(whole(x), F.lit(False)))
    return df.filter(ok).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: F.floor(x * scale)).alias("v"))


def ask(df: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """query (a number from 0), query_id, v: the query rows, one an id."""
    ids = vectors(df.filter(is_query), id_col, vector_col, scale).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))
    return cut(ids.select(F.monotonically_increasing_id().alias("query"), "query_id", "v"))


def classes(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, scale: int, k: int) -> DataFrame:
    """cls, v, members, own: one row a distinct vector.

    members are the k + 1 smallest ids that have the vector, each with the number of its rows (k at
    most): no query needs more of them. own is the query that the only id is, whose candidate the class
    is not; -1 for all others.
    """
    rows = vectors(df, id_col, vector_col, scale).groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    held = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))
    held = held.withColumn("sole", F.when(F.size("members") == 1, F.col("members")[0]["id"]))
    owned = held.join(queries.select(F.col("query_id").alias("sole"), "query"), "sole", "left")
    return cut(owned.select(F.monotonically_increasing_id().alias("cls"), "v", "members", F.coalesce("query", F.lit(-1)).alias("own")))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; beyond 64 bits, the nearest of them."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


def by_width(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, matrix) of up to ROWS vectors of one width."""
    ids, widths, flat = ids.to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield int(width), ids[some], flat[(ends[some] - width)[:, None] + np.arange(width)]


class Block:
    """A block of queries: their numbers, and the matrix of each width with its rows' places in them."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r.query for r in rows], dtype=np.int64)
        widths = np.array([len(r.v) for r in rows])
        self.of = {int(w): (np.flatnonzero(widths == w), np.array([r.v for r in rows if len(r.v) == w], dtype=np.int64)) for w in np.unique(widths)}

    def part(self, width: int, n_lists: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        places, matrix = self.of.get(width, (np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.int64)))
        return places, matrix[:, slice(*bounds(width, n_lists, which))]


def bounds(width: int, n_lists: int, which: int) -> tuple[int, int]:
    return width * which // n_lists, width * (which + 1) // n_lists


def list_part(vector: Column, n_lists: int, which: int) -> Column:
    low = F.floor(F.size(vector) * which / n_lists).cast("int")
    high = F.floor(F.size(vector) * (which + 1) / n_lists).cast("int")
    return F.slice(vector, low + 1, high - low)


def list_scores(block: Block, n_lists: int, which: int, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, classes, scores in the list), a query's own classes at the lowest score."""
    widths = part.column(3).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        mine = part.filter(pa.array(widths == width))
        places, queries = block.part(int(width), n_lists, which)
        if len(places):
            ids, own = mine.column(0).to_numpy(), mine.column(1).to_numpy()
            for _, some, rows in by_width(pa.array(np.arange(len(ids))), mine.column(2)):
                scores = dot(queries, rows)
                scores[block.ids[places][:, None] == own[some][None, :]] = LOWEST
                yield places, ids[some], scores


def gather(block, n_lists: int, which: int, depth: int) -> Callable:
    """Phase 1: of each query, the partition's highest scores in a list."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best, who = np.full((len(b.ids), depth), LOWEST), np.zeros((len(b.ids), depth), dtype=np.int64)
        for part in parts:
            for places, ids, scores in list_scores(b, n_lists, which, part):
                all_scores = np.concatenate((best[places], scores), axis=1)
                all_ids = np.concatenate((who[places], np.broadcast_to(ids, scores.shape)), axis=1)
                top = np.argpartition(all_scores, -depth, axis=1)[:, -depth:]
                best[places], who[places] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        query, column = np.nonzero(best > LOWEST)
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[query]), pa.array(who[query, column]), pa.array(best[query, column])], ["query", "cls", "score"])

    return batches


def collect_from(block, cutoffs, n_lists: int, which: int) -> Callable:
    """Phase 2: every entry of a list from the query's cutoff up."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, least = block.value, cutoffs.value
        for part in parts:
            for places, ids, scores in list_scores(b, n_lists, which, part):
                query, column = np.nonzero((scores >= least[places][:, None]) & (scores > LOWEST))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[places][query]), pa.array(ids[column]), pa.array(scores[query, column])], ["query", "cls", "score"])

    return batches


def resolve(pairs: DataFrame, corpus: DataFrame, block) -> DataFrame:
    """The full scores of pairs (query, cls)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        order = np.argsort(b.ids)
        where = {w: (np.full(len(b.ids), -1), m) for w, (_, m) in b.of.items()}
        for w, (places, _) in b.of.items():
            where[w][0][places] = np.arange(len(places))
        for part in parts:
            queries, ids, vectors = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
            place = order[np.searchsorted(b.ids, queries, sorter=order)]
            numbered = pa.array(np.arange(len(ids)))
            for width, rows, matrix in by_width(numbered, vectors):
                at, known = where[width]
                left = known[at[place[rows]]]
                most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(matrix.astype(float)).max(initial=0)) * width
                if most < 2.0**62:
                    scores = np.einsum("ij,ij->i", left, matrix)
                else:
                    scores = np.array([dot(x[None], y[None])[0, 0] for x, y in zip(left, matrix)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(queries[rows]), pa.array(ids[rows]), pa.array(scores)], ["query", "cls", "score"])

    return pairs.join(corpus.select("cls", "v"), "cls").select("query", "cls", "v").mapInArrow(batches, "query bigint, cls bigint, score bigint")


def highest(scores: DataFrame, k: int, *ties: str, by: str = "query") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(corpus: DataFrame, rows: list, k: int, n_lists: int, depth: int) -> DataFrame:
    """The classes that can hold the k highest scores of a block of queries: query, cls, score."""
    spark = corpus.sparkSession
    schema, block = "query bigint, cls bigint, score bigint", spark.sparkContext.broadcast(Block(rows))
    lists = [corpus.select("cls", "own", list_part(F.col("v"), n_lists, j).alias("part"), F.size("v").alias("width")) for j in range(n_lists)]

    local = None
    for j, entries in enumerate(lists):
        found = highest(entries.mapInArrow(gather(block, n_lists, j, depth), schema), depth, "cls")
        local = found if local is None else local.unionByName(found)
    probed = cut(resolve(local.select("query", "cls").distinct(), corpus, block))
    kth = highest(probed, k, "cls").groupBy("query").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
    bound = {r["query"]: r.bound for r in kth.collect() if r.n == k}  # a row a query of the block
    places = block.value.ids
    cutoffs = np.array([-(-bound[q] // n_lists) if q in bound else LOWEST for q in places.tolist()], dtype=np.int64)
    least = spark.createDataFrame([(q, int(c), bound.get(q)) for q, c in zip(places.tolist(), cutoffs.tolist())], "query bigint, cutoff bigint, bound bigint")
    shared = spark.sparkContext.broadcast(cutoffs)

    entries = None
    for j, some in enumerate(lists):
        found = some.mapInArrow(collect_from(block, shared, n_lists, j), schema)
        entries = found if entries is None else entries.unionByName(found)
    sums = cut(entries.groupBy("query", "cls").agg(F.sum("score").alias("score"), F.count("*").cast("int").alias("lists")))
    whole = sums.filter(F.col("lists") == n_lists).drop("lists")
    kth = highest(whole, k, "cls").filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    limit = F.greatest(F.coalesce("bound", F.lit(LOWEST)), F.coalesce("kth", F.lit(LOWEST)))
    bounded = sums.join(F.broadcast(least), "query").join(F.broadcast(kth), "query", "left")
    most = F.when(F.col("bound").isNotNull(), F.col("score") + (F.lit(n_lists) - F.col("lists")) * (F.col("cutoff") - 1))
    rest = bounded.filter((F.col("lists") < n_lists) & (most.isNull() | (most >= limit))).select("query", "cls")
    done = bounded.filter((F.col("lists") == n_lists) & (F.col("score") >= limit)).select("query", "cls", "score")
    return done.unionByName(resolve(rest, corpus, block))


def expand(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ids behind query, cls, score: query_id, rank, vec_id, score.

    Of equally high classes those with the smaller first id come first, so k classes are enough.
    """
    own = queries.select("query", "query_id")
    others = F.filter("members", lambda m: m["id"] != F.col("query_id"))
    rows = found.join(own, "query").join(corpus.select("cls", "members"), "cls").select("query_id", "score", others.alias("members"))
    best = highest(rows.withColumn("first", F.col("members")[0]["id"]), k, "first", by="query_id")
    each = best.select("query_id", "score", F.explode("members").alias("m")).select("query_id", "score", F.col("m.id").alias("vec_id"), F.explode(F.expr("sequence(1, m.n)")))
    return highest(each, k, "vec_id", by="query_id").select("query_id", "rank", "vec_id", "score")


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: int = 256, n_lists: int = 2, depth: int = 32) -> DataFrame:
    """The k highest inner products of each query row of df with all other rows.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a query with
    fewer candidates returns them all. is_query is a condition on ``id_col``; ids may be of any type.
    Vectors are compared as floor(scale * x), and only with vectors of the same width; see vectors()
    for the rows that take no part. Repeated rows are candidates one by one, but rows with the query's
    own id are none; a query id that several rows have asks with its smallest vector. An empty table
    gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    queries = ask(df, is_query, id_col, vector_col, scale)
    corpus = classes(df, queries, id_col, vector_col, scale, k)
    found, rows = [], []
    for row in queries.select("query", "v").orderBy("query").toLocalIterator():
        rows.append(row)
        if len(rows) == QUERY_BLOCK:
            found.append(cut(search_block(corpus, rows, k, n_lists, max(k, depth))))
            rows = []
    if rows:
        found.append(search_block(corpus, rows, k, n_lists, max(k, depth)))
    out = spark.createDataFrame([], "query bigint, cls bigint, score bigint")
    for more in found:
        out = out.unionByName(more)
    return expand(out, corpus, queries, k)
