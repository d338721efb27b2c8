"""Proximity graphs: building, inspecting, sampling, sharding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.distance import l2, replicate
from ..plans.scratch import bucketed, cut, discard
from .knn import exact_knn, usable

PAGE_BYTES = 4096
#: Vectors in a cell of cell_graph(), at most: what one task holds.
CELL_ROWS = 20_000
#: Slices that a cell can be cut into.
SLICES = 256
#: Vectors whose distances to all centres a task holds at a time.
ASSIGNED = 1024
#: Classes of hashes that nav_sample() counts, a power of 16.
SAMPLE_CLASSES = 16**4
#: Parts of a leaf that bounded_shards() splits, and bytes of centres that it broadcasts at a time.
SPLIT, CENTRE_BYTES = 64, 1 << 26
#: Edges of a graph that hops may shuffle whole, and of a bucket of a larger one; hops that become one table.
HOP_EDGES, HOP_TABLES = 1_000_000, 16
#: Rows whose distances to their cell prune() holds at a time.
PRUNE_ROWS = 256


def knn_graph(corpus: DataFrame, degree: int) -> DataFrame:
    """src, dst, rk: the exact nearest neighbours of every vector, its own id left out.

    Work grows with the square of the corpus; beyond some 10^5 vectors use cell_graph().
    """
    found = exact_knn(corpus.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), corpus, degree, skip_self=True)
    return found.select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), "rk")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, nbrs in rank order; a node's degree is bounded, so is the list."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "dst"))), lambda x: x["dst"]).alias("nbrs"))


def prune(ids: np.ndarray, m: np.ndarray, degree: int, alpha: float) -> list[tuple[int, int, int]]:
    """Edges of one cell: near neighbours, without those that another kept neighbour makes redundant.

    Distances are computed for PRUNE_ROWS rows at a time, so that memory grows with the cell, not its square.
    """
    edges, squares, wide = [], (m * m).sum(1), min(4 * degree, len(ids) - 1)
    for at in range(0, len(ids) if wide > 0 else 0, PRUNE_ROWS):
        block = m[at : at + PRUNE_ROWS]
        near = np.maximum(squares[at : at + PRUNE_ROWS, None] + squares[None] - 2 * block @ m.T, 0)
        near[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        cut_off = np.partition(near, wide - 1, axis=1)[:, wide - 1]
        for i, row in enumerate(near):
            close = np.flatnonzero(row <= cut_off[i])
            close = close[np.lexsort((ids[close], row[close]))][:wide]
            among = np.maximum(squares[close, None] + squares[close][None] - 2 * m[close] @ m[close].T, 0)
            kept: list[int] = []
            for j in range(len(close)):
                if len(kept) == degree:
                    break
                if not kept or (alpha * among[j, kept] > row[close[j]]).all():
                    kept.append(j)
            edges += [(int(ids[at + i]), int(ids[close[j]]), r) for r, j in enumerate(kept, 1)]
    return edges


def cells(corpus: DataFrame, overlap: int = 2, seed: int = 7, within: Column | None = None) -> DataFrame:
    """shard, cell, part, vec_id, v: corpus dealt to overlapping cells that a task can hold.

    Centres are a bounded sample (4096 at most); every vector goes to the cells of its ``overlap`` nearest
    centres, so that cells join up. A cell that is too large is cut into slices of like size across a
    direction of its own, so that near vectors stay together at any size of the corpus. shard is ``within``,
    which parts cells further. Rows without an id or a whole vector take no part.
    """
    corpus = usable(corpus, "v", "vec_id")
    n = corpus.count()
    many = max(1, min(4096, n * overlap * 2 // CELL_ROWS))
    centres = [np.array(r.v) for r in corpus.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(many).collect()]
    shared = corpus.sparkSession.sparkContext.broadcast(np.array(centres))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        across = np.random.default_rng(seed).normal(size=c.shape)
        for part in (p[at : at + ASSIGNED] for p in parts for at in range(0, len(p), ASSIGNED)):
            m = np.array(part["v"].tolist(), dtype=np.float64)
            near = (m * m).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * m @ c.T
            for which in np.argsort(near, axis=1, kind="stable")[:, :overlap].T:
                yield part.assign(cell=which.astype(np.int64), along=((m - c[which]) * across[which]).sum(1))

    rows = corpus.select("vec_id", "v", (F.lit(0) if within is None else within).cast("bigint").alias("shard"))
    placed = cut(rows.mapInPandas(assign, "vec_id bigint, v array<double>, shard bigint, cell bigint, along double"))
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > CELL_ROWS).select("shard", "cell", F.ceil(F.col("n") / (CELL_ROWS // 2)).cast("int").alias("slices"))
    cuts = placed.join(F.broadcast(large), ["shard", "cell"]).groupBy("shard", "cell").agg(
        F.first("slices").alias("slices"), F.percentile_approx("along", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts"))
    # a cell's slices are runs of the finest ones; beyond SLICES of them, rows of a slice are dealt by hash
    fine = F.size(F.filter("cuts", lambda x: x <= F.col("along")))
    of = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.floor(fine * F.least("slices", F.lit(SLICES)) / SLICES))
    deal = F.pmod(F.xxhash64("vec_id"), F.greatest(F.ceil(F.coalesce("slices", F.lit(1)) / SLICES), F.lit(1)))
    return placed.join(F.broadcast(cuts), ["shard", "cell"], "left").select("shard", "cell", F.struct(of.alias("slice"), deal.alias("deal")).alias("part"), "vec_id", "v")


def cell_graph(corpus: DataFrame, degree: int, alpha: float = 1.2, overlap: int = 2, seed: int = 7, within: Column | None = None) -> DataFrame:
    """src, dst, rk: an alpha-pruned graph of each cell's nearest neighbours, with reverse edges, degree at most.

    Cheaper than vamana.vamana_graph(), whose searches lead further. Edges stay within groups of equal ``within``.
    """
    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        return pd.DataFrame(prune(part["vec_id"].to_numpy(), np.array(part["v"].tolist(), dtype=np.float64), degree, alpha), columns=["src", "dst", "rk"])

    edges = cells(corpus, overlap, seed, within).groupBy("shard", "cell", "part").applyInPandas(build, "src bigint, dst bigint, rk bigint")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rk")).groupBy("src", "dst").agg(F.min("rk").alias("rk"))
    order = Window.partitionBy("src").orderBy("rk", "dst")
    return both.withColumn("rk", F.row_number().over(order).cast("bigint")).filter(F.col("rk") <= degree)


def bounded_shards(corpus: DataFrame, rows: int, seed: int = 11, fan_out: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(vec_id, shard) of every whole vector, and (shard, v) of the centres: near vectors share a shard, which has ``rows`` at most.

    A tree of centres: leaves that are too large are dealt to centres of their own, a sample of them, level
    after level, until all are small enough; one that its centres do not divide (copies of one vector) is dealt
    by hash. Small neighbours in the tree then share a shard. A level's centres are about twice as many as
    full shards; they are broadcast by blocks of CENTRE_BYTES. centres are the means of the shards.
    """
    spark = corpus.sparkSession
    placed = cut(usable(corpus, "v", "vec_id").select("vec_id", "v", F.lit("").alias("leaf")))
    before: dict[str, int] = {}
    while True:
        sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf: about as many as shards
        large = {leaf: n for leaf, n in sizes.items() if n > rows}
        if not large:
            break
        stuck = {leaf for leaf, n in large.items() if leaf and before.get(leaf.rpartition(".")[0]) == n}
        many = {leaf: min(fan_out, max(2, -(-2 * n // rows))) for leaf, n in large.items()}
        known = spark.createDataFrame([(leaf, n, many[leaf], leaf in stuck) for leaf, n in large.items()], "leaf string, n bigint, many int, stuck boolean")
        open_ = placed.join(F.broadcast(known), "leaf")
        hashed = F.pmod(F.xxhash64("vec_id", F.lit(seed + len(before))), F.lit(1 << 30))
        place = F.row_number().over(Window.partitionBy("leaf").orderBy("h", "vec_id"))
        some = open_.filter("not stuck").withColumn("h", hashed).filter(F.col("h") / (1 << 30) * F.col("n") < 4 * F.col("many") + 64)  # some more than needed
        chosen = some.withColumn("place", place).filter(F.col("place") <= F.col("many")).select("leaf", "v", "place").orderBy("leaf", "place")
        dealt = open_.filter("stuck").select("vec_id", "v", F.concat("leaf", F.lit("."), F.lpad(F.pmod(hashed, F.col("many")).cast("string"), 4, "0")).alias("leaf"))
        for block in _centre_blocks(chosen):
            shared = spark.sparkContext.broadcast(block)
            dealt = dealt.unionByName(open_.filter(F.col("leaf").isin(list(block))).select("vec_id", "v", "leaf").mapInPandas(_to_centres(shared), "vec_id bigint, v array<double>, leaf string"))
        old, placed = placed, cut(placed.join(F.broadcast(known.select("leaf")), "leaf", "left_anti").select("vec_id", "v", "leaf").unionByName(dealt))
        discard(old)
        before = sizes
    shard_of, shard, held = [], -1, rows
    for leaf in sorted(sizes):
        shard, held = (shard, held + sizes[leaf]) if held + sizes[leaf] <= rows else (shard + 1, sizes[leaf])
        shard_of.append((leaf, shard))
    shards = spark.createDataFrame(shard_of, "leaf string, shard bigint")
    named = cut(placed.join(F.broadcast(shards), "leaf").select("vec_id", "shard", "v"))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for p in parts if len(p)):
            for which, mine in part.groupby("shard"):
                yield pd.DataFrame({"shard": [which], "n": [len(mine)], "s": [np.array(mine["v"].tolist()).sum(axis=0).tolist()]})

    total = named.select("shard", "v").mapInPandas(sums, "shard bigint, n bigint, s array<double>").select("shard", "n", F.posexplode("s").alias("i", "x"))
    means = total.groupBy("shard", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    centres = means.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return named.select("vec_id", "shard"), cut(centres)


def _centre_blocks(chosen: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """leaf -> its centres, as many leaves at a time as CENTRE_BYTES hold."""
    block: dict[str, list] = {}
    held = 0
    for r in chosen.toLocalIterator():
        if r.leaf not in block and held > CENTRE_BYTES:
            yield {leaf: np.array(m) for leaf, m in block.items()}
            block, held = {}, 0
        block.setdefault(r.leaf, []).append(r.v)
        held += 8 * len(r.v)
    if block:
        yield {leaf: np.array(m) for leaf, m in block.items()}


def _to_centres(shared) -> Callable:
    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for p in parts if len(p)):
            for leaf, mine in part.groupby("leaf"):
                c, m = shared.value[leaf], np.array(mine["v"].tolist(), dtype=np.float64)
                near = ((c * c).sum(1)[None] - 2 * m @ c.T).argmin(axis=1)
                yield mine.assign(leaf=[f"{leaf}.{i:04d}" for i in near])

    return assign


def centre_shards(corpus: DataFrame, shards: int, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(vec_id, shard) of every whole vector, and (shard, v) of the centres: a shard holds what is nearest to its centre.

    Centres are a sample, 4096 at most, so that they can be broadcast; bounded_shards() bounds what a shard holds.
    """
    corpus = usable(corpus, "v", "vec_id").select("vec_id", "v")
    chosen = corpus.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(min(4096, shards)).collect()
    shared = corpus.sparkSession.sparkContext.broadcast(np.array([r.v for r in chosen], dtype=np.float64))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for part in (p for p in parts if len(p)):
            m = np.array(part["v"].tolist(), dtype=np.float64)
            yield pd.DataFrame({"vec_id": part["vec_id"], "shard": ((c * c).sum(1)[None] - 2 * m @ c.T).argmin(axis=1)})

    centres = corpus.sparkSession.createDataFrame([(i, list(map(float, r.v))) for i, r in enumerate(chosen)], "shard bigint, v array<double>")
    return corpus.mapInPandas(assign, "vec_id bigint, shard bigint"), centres


def shard_graph(corpus: DataFrame, degree: int, shards: int, alpha: float = 1.2, shard_of: DataFrame | None = None) -> DataFrame:
    """src, dst, rk: an alpha-pruned graph within each shard, as the batch search deals the corpus.

    Shards go by id, or as shard_of (vec_id, shard) says. A shard is built in cells of its own (cell_graph's centres are shared by all), so no task holds more than a cell.
    """
    if shard_of is not None:
        return cell_graph(corpus.join(shard_of, "vec_id"), degree, alpha, within=F.col("shard"))
    return cell_graph(corpus, degree, alpha, within=F.pmod(F.col("vec_id"), F.lit(shards)))


def centroid(corpus: DataFrame) -> DataFrame:
    """centroid: one row, the mean vector."""
    means = corpus.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def medoid(corpus: DataFrame) -> DataFrame:
    """vec_id, dist: the vector nearest to the centroid."""
    return corpus.join(F.broadcast(centroid(corpus)), F.lit(True)).select("vec_id", l2(F.col("v"), F.col("centroid")).alias("dist")).orderBy("dist", "vec_id").limit(1)


def degree_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"), F.count("*").alias("nodes"))


def dangling_edges(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """Edges that lead to no vector."""
    return edges.join(corpus.select(F.col("vec_id").alias("dst")), "dst", "left_anti").select("src", "dst")


def hop_from(frontier: DataFrame, links: DataFrame, apart: bool = False) -> DataFrame:
    """node: what links (src, dst) lead to from the frontier's nodes, each once.

    With ``apart`` links are bucketed by src, and only the frontier is shuffled.
    """
    asked = frontier.select(F.col("node").alias("at"))
    return links.join(asked.hint("shuffle_hash") if apart else asked, F.col("at") == F.col("src")).select(F.col("dst").alias("node")).distinct()


def bfs_hops(edges: DataFrame, entry: int, most: int = 9, small: int = HOP_EDGES) -> DataFrame:
    """node, hop: fewest edges from the entry, up to ``most``; unreached nodes are absent.

    More than ``small`` edges are written bucketed by their source, once, so that a hop shuffles nodes and
    never the graph. A hop is a table; every HOP_TABLES of them become one, so that plans stay short however
    deep the graph is.
    """
    links = cut(edges.select("src", "dst"))
    n = links.count()
    apart = n > small
    if apart:
        plain, links = links, bucketed(links, "src", -(-n // HOP_EDGES))
        discard(plain)
    seen = cut(links.sparkSession.createDataFrame([(entry, 0)], "node bigint, hop int"))
    tables = [seen]
    for hop in range(1, most + 1):
        frontier = tables[-1].filter(F.col("hop") == hop - 1)
        found = Observation()  # counts what is written, so that a hop is one job
        met = hop_from(frontier, links, apart).join(seen, "node", "left_anti")
        fresh = cut(met.withColumn("hop", F.lit(hop)).observe(found, F.count("*").alias("n")))
        if not found.get["n"]:
            discard(fresh)
            break
        seen = seen.unionByName(fresh)
        tables.append(fresh)
        if len(tables) == HOP_TABLES:
            seen = cut(seen)
            discard(*tables)
            tables = [seen]
    discard(links)
    return seen


def hop_histogram(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """hop, n over nodes (vec_id); hop is null for what was not reached."""
    return nodes.join(hops, nodes["vec_id"] == hops["node"], "left").groupBy("hop").agg(F.count("*").alias("n"))


def nav_sample(corpus: DataFrame, n: int) -> DataFrame:
    """nav_id, vec_id: the n vectors with the smallest MD5 of their id, numbered from 0 in that order.

    Hashes are counted in SAMPLE_CLASSES classes first, which say up to where they are needed; what is left
    is sorted by ranges, and ranges number their rows from where the one before ends. No task sees the whole
    sample.
    """
    rows = corpus.select(F.md5(F.col("vec_id").cast("string")).alias("key"), "vec_id")
    of = F.conv(F.substring("key", 1, len(f"{SAMPLE_CLASSES - 1:x}")), 16, 10).cast("int")
    upto, total = 0, 0
    for r in rows.groupBy(of.alias("class")).agg(F.count("*").alias("n")).orderBy("class").collect():  # a row a class
        if total >= n:
            break
        upto, total = r["class"], total + r["n"]
    ranged = cut(rows.filter(of <= upto).repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").withColumn("part", F.spark_partition_id()))
    before, first = 0, []
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        first.append((r["part"], before))
        before += r["n"]
    known = ranged.sparkSession.createDataFrame(first, "part int, before bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "vec_id")) - 1
    numbered = ranged.join(F.broadcast(known), "part").select((F.col("before") + place).cast("bigint").alias("nav_id"), "vec_id")
    return numbered.filter(F.col("nav_id") < n)


def page_layout(vec_id: Column, record_bytes: int) -> tuple[Column, Column]:
    """Page (from 1; page 0 is the header) and byte offset of a fixed-size record."""
    per_page = PAGE_BYTES // record_bytes
    return (F.floor(vec_id / per_page) + 1).cast("bigint"), (F.pmod(vec_id, F.lit(per_page)) * record_bytes).cast("bigint")


def shard_assign(page: Column, shards: int) -> tuple[Column, Column]:
    """Round robin: shard, and the page's place in it."""
    return F.pmod(page, F.lit(shards)).cast("bigint"), F.floor(page / shards).cast("bigint")


def replicate_dims(corpus: DataFrame, times: int) -> DataFrame:
    return corpus.select("vec_id", replicate(F.col("v"), times).alias("v"))


def stripe_skew(pages: DataFrame, devices: int) -> DataFrame:
    """round, device, reads, share of a round's reads (round, page) of each device when page p lies on device p mod n."""
    reads = pages.groupBy("round", F.pmod("page", F.lit(devices)).cast("bigint").alias("device")).agg(F.count("*").alias("reads"))
    return reads.withColumn("share", F.col("reads") / F.sum("reads").over(Window.partitionBy("round")))


def access_frequency(trace: DataFrame) -> DataFrame:
    """How often a search's trace (qid, round, node) visits nodes, round by round: distinct nodes, most, median, deciles.

    Visits are counted by round and node first, so that a node that all queries pass is one row.
    """
    visits = trace.groupBy("round", "node").agg(F.count("*").alias("n"))
    tenths = [F.expr(f"percentile(n, {i / 10})").alias(f"p{i * 10}") for i in range(1, 10)]
    return visits.groupBy("round").agg(F.count("*").alias("nodes"), F.max("n").alias("most"), *tenths)
