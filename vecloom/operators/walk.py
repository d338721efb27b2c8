"""Best-first walks of many queries at once, in arrays: what tasks of the batch forms run.

All queries take a step together: the next node of each is looked up, its neighbours are measured, and
beams are merged by sorting rows of a matrix. The rules are those of beam.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

DIGITS = 9
#: Queries that take steps together, and nodes whose neighbours are looked up at a time.
LANES, CLOSED = 512, 16384


class Nodes:
    """Nodes that a task holds: sorted ids, vectors, and neighbours (ids, -1 where a row is shorter).

    guide(walks, lanes, rows, slots) gives the distances that guide the search: of walks' queries to the
    neighbours in the given slots of the given nodes.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nbrs: np.ndarray, guide: Callable) -> None:
        self.ids, self.vectors, self.nbrs, self.guide = ids, vectors, nbrs, guide

    @classmethod
    def closed(cls, ids: np.ndarray, vectors: np.ndarray, nbrs: np.ndarray, codes: np.ndarray | None = None) -> Nodes:
        """Neighbours are among the nodes, others are left out; codes guide, or the vectors without any."""
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, vectors, nbrs = ids[order], vectors[order], nbrs[order]
            codes = None if codes is None else codes[order]
        place, kept = np.zeros(nbrs.shape, dtype=np.int32), np.full(nbrs.shape, -1, dtype=np.int64)
        for at in range(0, len(ids), CLOSED):
            some = nbrs[at : at + CLOSED]
            place[at : at + CLOSED] = here = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
            kept[at : at + CLOSED] = np.where((some >= 0) & (ids[here] == some), some, -1)
        nbrs = kept

        def guide(walks: Walks, lanes: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
            at = place[rows, slots]
            return walks.by_vectors(lanes, vectors[at]) if codes is None else walks.by_codes(lanes, codes[at])

        return cls(ids, vectors, nbrs, guide)

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Where nodes are; -1 for those that are not here."""
        if not len(self.ids):
            return np.full(len(nodes), -1)
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[at] == nodes, at, -1)


class Walks:
    """The state of walks: beam, expanded nodes in order with their exact distances, next node (-1: ended)."""

    def __init__(self, queries: np.ndarray, entries: np.ndarray, ef: int, tables: list[np.ndarray] | None = None) -> None:
        n = len(queries)
        self.queries, self.ef = queries, ef
        self.tables = tables if tables is None else self.flat(tables)
        self.beam_d, self.beam_id = np.full((n, ef), np.inf), np.full((n, ef), -1, dtype=np.int64)  # expanded nodes stay in the beam
        self.seen, self.exact = np.full((n, 8), -1, dtype=np.int64), np.full((n, 8), np.inf)
        self.seen[:, 0], self.count, self.next = entries, np.ones(n, dtype=np.int64), entries.astype(np.int64).copy()

    @staticmethod
    def flat(tables: list[np.ndarray]) -> np.ndarray:
        """Distances by query, chunk and pivot."""
        out = np.zeros((len(tables[0]), len(tables), max(t.shape[1] for t in tables)))
        for j, t in enumerate(tables):
            out[:, j, : t.shape[1]] = t
        return out

    def by_vectors(self, lanes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.queries[lanes]) ** 2).sum(axis=1)

    def by_codes(self, lanes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.tables[lanes[:, None], np.arange(codes.shape[1]), codes].sum(axis=1)

    def step(self, nodes: Nodes, lanes: np.ndarray, rows: np.ndarray) -> None:
        """Expand the next node of each of the lanes, which nodes hold in the given rows."""
        last = self.count[lanes] - 1
        self.exact[lanes, last] = np.round(((self.queries[lanes] - nodes.vectors[rows]) ** 2).sum(axis=1), DIGITS)
        seen = self.seen[lanes, : int(self.count[lanes].max())]
        near = nodes.nbrs[rows]
        fresh = (near >= 0) & ~(near[:, :, None] == seen[:, None, :]).any(axis=2)
        lane, slot = np.nonzero(fresh)
        dist = np.full(near.shape, np.inf)
        if len(lane):
            dist[lane, slot] = np.round(nodes.guide(self, lanes[lane], rows[lane], slot), DIGITS)
        d, i = np.concatenate((self.beam_d[lanes], dist), axis=1), np.concatenate((self.beam_id[lanes], np.where(fresh, near, -1)), axis=1)
        order = np.lexsort((i, d), axis=1)
        d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        keep = i >= 0
        keep[:, 1:] &= i[:, 1:] != i[:, :-1]  # a node's distance is the same wherever it is met
        place = np.cumsum(keep, axis=1) - 1
        r, c = np.nonzero(keep & (place < self.ef))
        beam_d, beam_id = np.full((len(lanes), self.ef), np.inf), np.full((len(lanes), self.ef), -1, dtype=np.int64)
        beam_d[r, place[r, c]], beam_id[r, place[r, c]] = d[r, c], i[r, c]
        self.beam_d[lanes], self.beam_id[lanes] = beam_d, beam_id
        open_ = (beam_id >= 0) & ~(beam_id[:, :, None] == seen[:, None, :]).any(axis=2)
        first = open_.argmax(axis=1)
        found = np.where(open_.any(axis=1), beam_id[np.arange(len(lanes)), first], -1)
        self.visit(lanes, found)

    def visit(self, lanes: np.ndarray, found: np.ndarray) -> None:
        self.next[lanes] = found
        lanes, found = lanes[found >= 0], found[found >= 0]
        if len(lanes) and self.count[lanes].max() == self.seen.shape[1]:
            self.seen = np.concatenate((self.seen, np.full_like(self.seen, -1)), axis=1)
            self.exact = np.concatenate((self.exact, np.full_like(self.exact, np.inf)), axis=1)
        self.seen[lanes, self.count[lanes]] = found
        self.count[lanes] += 1

    def run(self, nodes: Nodes) -> None:
        """Walk on while next nodes are here. Walks whose next node lies elsewhere stand still."""
        lanes = np.flatnonzero(self.next >= 0)
        while len(lanes):
            rows = nodes.rows(self.next[lanes])
            here = rows >= 0
            lanes, rows = lanes[here], rows[here]
            if not len(lanes):
                return
            self.step(nodes, lanes, rows)
            lanes = lanes[self.next[lanes] >= 0]

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, node, distance) of each walk's k nearest expanded nodes, in order."""
        order = np.lexsort((self.seen, self.exact), axis=1)[:, :k]
        d, i = np.take_along_axis(self.exact, order, 1), np.take_along_axis(self.seen, order, 1)
        lane, column = np.nonzero(np.isfinite(d))
        return lane, i[lane, column], d[lane, column]


def matrix_of(lists: list, width: int | None = None, fill: int = -1) -> np.ndarray:
    """Lists of integers as rows, filled up."""
    width = max((len(x) for x in lists if x is not None), default=0) if width is None else width
    out = np.full((len(lists), width), fill, dtype=np.int64)
    for row, x in zip(out, lists):
        if x is not None:
            row[: len(x)] = x
    return out
