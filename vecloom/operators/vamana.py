"""Proximity graphs built by search: each vector looks for its own place in the graph as it stands.

A cell (what one task holds) is built in batches: every vector of a batch is searched for in the present
graph from the cell's medoid, with a beam of ``width``; of the nodes that its search expanded, and of its
neighbours so far, those stay that no nearer one makes redundant (by a factor ``alpha``), ``degree`` at
most; then it is put among their neighbours, which are pruned where they become too many. A first pass
inserts the vectors, with alpha 1, in batches that double; a second goes over all again. At last, nodes
that the medoid does not reach hang under the nearest reached node that has room.

Larger corpora are dealt to overlapping cells by nearness. Their edges are put together and pruned node by
node, and what the medoid of all does not reach is joined up by the same rule, by Spark.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, discard
from .graph import bfs_hops, cells, medoid
from .knn import exact_knn, lean, rows_of
from .walk import Nodes, Walks, matrix_of

#: Vectors of a batch at most, and the share of a cell that one is at most in the second pass (one in so many).
BATCH, SHARE = 512, 50
#: Neighbours while a cell is built, in degrees; nodes pruned at a time.
SLACK, PRUNED = 1.3, 128
#: Nodes whose edges one task prunes after cells were put together.
MERGE_NODES = 2_000
#: Edges whose vectors are held at a time when a cell's edges are ranked.
EDGES = 16_384


def robust_prune(m: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row of candidates (places in m, -1 fills up) for the vector of[row], those that stay: nearest first, ties by place.

    One goes if a nearer one that stays is nearer to it than the vector is, by a factor alpha in squared distances;
    with an infinite alpha none does.
    """
    if not candidates.size:
        return np.full((len(of), degree), -1, dtype=np.int64)
    v = m[candidates]
    near = np.where(candidates < 0, np.inf, ((v - m[of][:, None]) ** 2).sum(axis=2))
    order = np.lexsort((candidates, near), axis=1)
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    squares = (v * v).sum(axis=2)
    out, rows = np.full((len(of), degree), -1, dtype=np.int64), np.arange(len(of))
    open_ = np.isfinite(near)
    for slot in range(degree):
        first = open_.argmax(axis=1)
        rows = rows[open_[rows, first[rows]]]
        if not len(rows):
            break
        c = first[rows]
        out[rows, slot] = candidates[rows, c]
        apart = np.maximum(squares[rows] + squares[rows, c][:, None] - 2 * np.einsum("rcd,rd->rc", v[rows], v[rows, c]), 0)
        if np.isfinite(alpha):
            open_[rows] &= alpha * apart > near[rows]
        open_[rows, c] = False
    return out


def padded(lists: list[np.ndarray]) -> np.ndarray:
    return matrix_of(lists, max(1, max(map(len, lists))))


class Cell:
    """The graph of one cell, by places in the order of ids: neighbours as rows of a matrix, -1 where a row ends.

    While it is built, a node may have SLACK times as many neighbours as in the end.
    """

    def __init__(self, m: np.ndarray, degree: int, width: int, alpha: float, seed: int = 7) -> None:
        self.m, self.degree, self.width = m, degree, width
        self.nbrs = np.full((len(m), int(SLACK * degree)), -1, dtype=np.int64)
        self.entry = int(np.argmin(((m - m.mean(axis=0)) ** 2).sum(axis=1)))
        order = np.random.default_rng(seed).permutation(len(m))
        order = np.concatenate(([self.entry], order[order != self.entry]))
        at, size = 1, 1
        while at < len(order):
            self.insert(order[at : at + size], 1.0)
            at, size = at + size, min(2 * size, BATCH)
        size = max(1, min(BATCH, len(order) // SHARE))
        for at in range(0, len(order), size):
            self.insert(order[at : at + size], alpha)
        full = np.flatnonzero((self.nbrs >= 0).sum(axis=1) > degree)
        self.prune(full, self.nbrs[full], alpha)
        self.nbrs = self.nbrs[:, :degree].copy()
        self.join_up()

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """Give nodes what stays of their candidates, a row each."""
        for at in range(0, len(nodes), PRUNED):
            some, held = nodes[at : at + PRUNED], candidates[at : at + PRUNED]
            held = held[:, (held >= 0).any(axis=0)]
            self.nbrs[some] = -1
            self.nbrs[some, : self.degree] = robust_prune(self.m, some, held, self.degree, alpha)

    def insert(self, batch: np.ndarray, alpha: float) -> None:
        every = np.arange(len(self.m))
        walks = Walks(self.m[batch], np.full(len(batch), self.entry), self.width)
        walks.run(Nodes(every, self.m, self.nbrs, lambda w, lanes, rows, slots: w.by_vectors(lanes, self.m[self.nbrs[rows, slots]])))
        candidates = np.sort(np.concatenate((walks.seen, self.nbrs[batch]), axis=1), axis=1)[:, ::-1]
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == batch[:, None]] = -1
        self.prune(batch, candidates, alpha)
        lane, slot = np.nonzero(self.nbrs[batch] >= 0)
        p, q = batch[lane], self.nbrs[batch][lane, slot]
        new = ~(self.nbrs[q] == p[:, None]).any(axis=1)
        order = np.lexsort((p[new], q[new]))
        p, q = p[new][order], q[new][order]
        nodes, first, count = np.unique(q, return_index=True, return_counts=True)
        have, rank = (self.nbrs[nodes] >= 0).sum(axis=1), np.arange(len(q)) - np.repeat(first, count)
        fits = np.repeat(have + count <= self.nbrs.shape[1], count)
        self.nbrs[q[fits], (np.repeat(have, count) + rank)[fits]] = p[fits]
        over = have + count > self.nbrs.shape[1]
        if over.any():
            candidates = np.full((int(over.sum()), self.nbrs.shape[1] + int(count[over].max())), -1, dtype=np.int64)
            candidates[:, : self.nbrs.shape[1]] = self.nbrs[nodes[over]]
            candidates[np.repeat(np.arange(len(candidates)), count[over]), self.nbrs.shape[1] + rank[~fits]] = p[~fits]
            self.prune(nodes[over], candidates, alpha)

    def join_up(self) -> None:
        """Every node gets reached: edges that first reach a node are kept, others give way where there is no room."""
        reached, tree = np.zeros(len(self.m), dtype=bool), np.zeros(self.nbrs.shape, dtype=bool)

        def spread(start: int) -> None:
            reached[start] = True
            queue = deque([start])
            while queue:
                p = queue.popleft()
                for slot, q in enumerate(self.nbrs[p].tolist()):
                    if q >= 0 and not reached[q]:
                        reached[q] = tree[p, slot] = True
                        queue.append(q)

        spread(self.entry)
        for u in range(len(self.m)):
            if not reached[u]:
                room = np.flatnonzero(reached & ~tree.all(axis=1))
                host = room[((self.m[room] - self.m[u]) ** 2).sum(axis=1).argmin()]
                slot = int(np.flatnonzero(~tree[host])[-1]) if (self.nbrs[host] >= 0).all() else int((self.nbrs[host] < 0).argmax())
                self.nbrs[host, slot], tree[host, slot] = u, True
                spread(u)

    def edges(self, ids: np.ndarray) -> pd.DataFrame:
        """src, dst, rk by distance."""
        src, slot = np.nonzero(self.nbrs >= 0)
        dst = self.nbrs[src, slot]
        near = np.empty(len(src))
        for at in range(0, len(src), EDGES):
            some = slice(at, at + EDGES)
            near[some] = ((self.m[src[some]] - self.m[dst[some]]) ** 2).sum(axis=1)
        order = np.lexsort((dst, near, src))
        src, dst = src[order], dst[order]
        return pd.DataFrame({"src": ids[src], "dst": ids[dst], "rk": np.arange(len(src)) - np.searchsorted(src, src) + 1})


def search_graph_cells(corpus: DataFrame, degree: int, width: int, alpha: float, overlap: int, within: Column | None) -> tuple[DataFrame, bool]:
    """(edges src, dst, rk of each cell; whether there is one cell only)."""
    split = cells(corpus, overlap, within=within)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("vec_id").sort_values("vec_id")
        return Cell(np.array(part["v"].tolist(), dtype=np.float64), degree, width, alpha).edges(part["vec_id"].to_numpy())

    split = cut(split)
    one = split.select("shard", "cell", "part").distinct().count() <= 1
    return split.groupBy("shard", "cell", "part").applyInPandas(build, "src bigint, dst bigint, rk bigint"), one


def merge_cells(edges: DataFrame, corpus: DataFrame, degree: int, alpha: float) -> DataFrame:
    """One graph of the cells' edges: a node that has more than ``degree`` of them is pruned.

    A task gets the vectors of its nodes' neighbours, each beside its edge, and the nodes' own as edges to
    themselves: one shuffle of a vector an edge, in single precision where that changes no number.
    """
    both = cut(edges.select("src", "dst").distinct())
    vectors = lean(corpus.select("vec_id", "v")).dropDuplicates(["vec_id"])
    groups = max(1, corpus.count() // MERGE_NODES)
    own = both.select("src").distinct().select("src", F.col("src").alias("dst"))
    of = both.filter("src <> dst").unionByName(own).join(vectors.select(F.col("vec_id").alias("dst"), "v"), "dst")

    def prune(part: pa.Table) -> pa.Table:
        src, dst = (part.column(c).to_numpy() for c in ("src", "dst"))
        ids, first = np.unique(dst, return_index=True)
        m = np.concatenate([rows_of(chunk) for chunk in part.column("v").chunks])[first].astype(np.float64)
        order = np.lexsort((dst, src))
        order = order[src[order] != dst[order]]
        nodes, starts = np.unique(src[order], return_index=True)
        lists = np.split(np.searchsorted(ids, dst[order]), starts[1:])
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64),) * 3]
        for at in range(0, len(nodes), PRUNED):
            some, mine = nodes[at : at + PRUNED], lists[at : at + PRUNED]
            places = np.searchsorted(ids, some)
            few, held = np.array([len(x) <= degree for x in mine]), padded(mine)
            kept = np.full((len(places), degree), -1, dtype=np.int64)
            kept[few], kept[~few] = robust_prune(m, places[few], held[few], degree, np.inf), robust_prune(m, places[~few], held[~few], degree, alpha)
            row, slot = np.nonzero(kept >= 0)
            out.append((some[row], ids[kept[row, slot]], slot + 1))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["src", "dst", "rk"])

    return of.withColumn("part", F.pmod(F.xxhash64("src"), F.lit(groups))).groupBy("part").applyInArrow(prune, "src bigint, dst bigint, rk bigint")


def join_up(edges: DataFrame, corpus: DataFrame, entry: int, degree: int) -> DataFrame:
    """edges (src, dst, rk), so that the entry reaches every vector of corpus, degree at most.

    A node out of reach hangs under the nearest node within reach that has room: one whose edges are not all
    the first way to somewhere. Of those that choose the same node, as many as it has room for come first.
    """
    edges, rows = cut(edges), corpus.select("vec_id", "v")
    while True:
        hops = cut(bfs_hops(edges, entry, most=1 << 30))
        out = rows.join(hops, F.col("vec_id") == F.col("node"), "left_anti")
        if not out.take(1):
            return edges
        at = lambda name: hops.select(F.col("node").alias(name), F.col("hop").alias(f"{name}_hop"))
        first = edges.join(at("src"), "src").join(at("dst"), "dst").filter(F.col("dst_hop") == F.col("src_hop") + 1).groupBy("dst").agg(F.min("src").alias("src"))
        first = cut(first.withColumn("tree", F.lit(True)))
        room = hops.select("node").join(first.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("used")), "node", "left").select("node", (F.lit(degree) - F.coalesce("used", F.lit(0))).alias("room")).filter("room > 0")
        hosts = rows.join(room, F.col("vec_id") == F.col("node")).select("vec_id", "v", "room")
        near = exact_knn(out.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), hosts, 1).join(hosts.select("vec_id", "room"), "vec_id")
        order = F.row_number().over(_by("vec_id", "dist", "qid"))
        added = cut(near.withColumn("n", order).filter(F.col("n") <= F.col("room")).select(F.col("vec_id").alias("src"), F.col("qid").alias("dst"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("rk")))
        held = edges.join(first, ["src", "dst"], "left").select("src", "dst", F.when(F.col("tree"), 0).otherwise(1).alias("kind"), "rk").join(added.select("src", "dst"), ["src", "dst"], "left_anti")
        kept = held.unionByName(added).withColumn("n", F.row_number().over(_by("src", "kind", "rk", "dst"))).filter(F.col("n") <= degree)
        before, edges = edges, cut(kept.select("src", "dst", F.col("n").cast("bigint").alias("rk")))
        discard(before, hops, first, added)


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def vamana_graph(corpus: DataFrame, degree: int, width: int | None = None, alpha: float = 1.2, overlap: int = 2, within: Column | None = None) -> DataFrame:
    """src, dst, rk: a graph built by search, at most ``degree`` neighbours a node, every vector reached from the medoid.

    width is the beam of the build's searches, twice the degree unless given. With ``within`` edges stay in
    groups of equal value, and every cell's nodes are reached from the cell's medoid. Rows without an id or
    a whole vector take no part, nor do further rows with the same id.
    """
    width = 2 * degree if width is None else width
    edges, one = search_graph_cells(corpus, degree, width, alpha, overlap, within)
    edges = cut(edges)
    if one:
        return edges
    merged = merge_cells(edges, corpus, degree, alpha)
    discard(edges)
    if within is not None:
        return cut(merged)  # what reads the graph several times does not put it together again
    first = medoid(corpus).first()
    return merged if first is None else join_up(merged, corpus, first.vec_id, degree)
