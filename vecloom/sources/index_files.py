"""Readers and writers of graph index files (little-endian).

A paged index keeps fixed-size records, each a vector, its degree (int32) and its neighbours' ids (int32),
in pages of 4096 bytes; no record crosses a page. Page 0 is the header: numbers of rows and columns
(int32), then as 8-byte integers the numbers of nodes and dimensions, the medoid, a record's bytes, records
a page, and three fields that are not used here. An index may be striped over files: page p is page
p // n of file p mod n.

A quantisation model is a file of tables, whose first one gives the byte offsets of the others: pivots,
centroid, chunk boundaries (older files hold a table more before the boundaries). A navigation graph
has 24 bytes of header, the largest degree at byte 8 and the start node at byte 12, then per node its
degree and neighbours; a text file maps its nodes to ids of the corpus, one a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PAGE_BYTES
from ..operators.pq import PQModel
from .vecs import open_at, read_rows, read_vectors, shape, whole_file, write_vectors

#: Component and Spark type of an index's vectors.
ELEMENTS = {"float": ("<f4", "float"), "uint8": ("u1", "smallint")}
PAGES_PER_TASK = 16_384
PAGES_PER_BATCH = 256
#: Records of a navigation graph that a task reads, and that it holds.
NAV_ROWS, NAV_BATCH = 50_000, 4096
#: Pivots a chunk in files; models with fewer are filled up with copies of their last one, which no code names.
FILE_PIVOTS = 256
#: Where the tables of a quantisation file begin.
TABLES_AT = 4096


@dataclass(frozen=True)
class IndexMeta:
    nodes: int
    width: int
    medoid: int
    record_bytes: int
    per_page: int
    vector_bytes: int

    @property
    def degree(self) -> int:
        """The most neighbours that a record holds."""
        return (self.record_bytes - self.vector_bytes) // 4 - 1

    @property
    def pages(self) -> int:
        """Pages of nodes, without the header."""
        return -(-self.nodes // self.per_page)


def meta_of(nodes: int, width: int, medoid: int, degree: int, element: str) -> IndexMeta:
    vector = width * np.dtype(ELEMENTS[element][0]).itemsize
    record = vector + 4 + 4 * degree
    if record > PAGE_BYTES:
        raise ValueError(f"a record of {record} bytes does not fit in a page of {PAGE_BYTES}")
    return IndexMeta(nodes, width, medoid, record, PAGE_BYTES // record, vector)


def read_meta(path: str, element: str = "float") -> IndexMeta:
    """The header of an index (its first stripe); an impossible one raises ValueError."""
    where, name = open_at(path)
    with where.open_input_file(name) as f:
        raw = f.read_at(72, 0)
    if len(raw) < 72:
        raise ValueError(f"{path}: no header")
    nodes, width, medoid, record, per_page = (int(x) for x in np.frombuffer(raw, dtype="<u8", offset=8)[:5])
    meta = IndexMeta(nodes, width, medoid, record, per_page, width * np.dtype(ELEMENTS[element][0]).itemsize)
    if not per_page or per_page * record > PAGE_BYTES or meta.degree < 0 or nodes and medoid >= nodes:
        raise ValueError(f"{path}: its header does not fit {element} vectors")
    return meta


def read_pages(paths: list[str], first: int, n: int) -> np.ndarray:
    """n pages from the first on, as rows of bytes, from all stripes."""
    out = np.zeros((n, PAGE_BYTES), dtype=np.uint8)
    for i, path in enumerate(paths):
        mine = np.arange(first, first + n)
        mine = mine[mine % len(paths) == i]
        if len(mine):
            where, name = open_at(path)
            with where.open_input_file(name) as f:
                raw = f.read_at(len(mine) * PAGE_BYTES, int(mine[0]) // len(paths) * PAGE_BYTES)
            if len(raw) != len(mine) * PAGE_BYTES:
                raise ValueError(f"{path}: shorter than its header says")
            out[mine - first] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, PAGE_BYTES)
    return out


def unpack(records: np.ndarray, ids: np.ndarray, meta: IndexMeta, element: str) -> pa.RecordBatch:
    """node, vector, nbrs of records (rows of bytes)."""
    vectors = np.ascontiguousarray(records[:, : meta.vector_bytes]).view(ELEMENTS[element][0])
    vectors = vectors.astype(np.int16) if element == "uint8" else vectors
    tail = np.ascontiguousarray(records[:, meta.vector_bytes : meta.vector_bytes + 4 + 4 * meta.degree]).view("<i4")
    degrees = tail[:, 0]
    if len(ids) and (degrees.min() < 0 or degrees.max() > meta.degree):
        raise ValueError("a record's degree is out of bounds")
    near = tail[:, 1:][np.arange(meta.degree) < degrees[:, None]].astype(np.int64)
    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * meta.width)
    near_ends = pa.array(np.concatenate(([0], np.cumsum(degrees))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel())), pa.ListArray.from_arrays(near_ends, pa.array(near))], ["node", "vector", "nbrs"])


def pack_records(vectors: pa.Array, nbrs: pa.Array, meta: IndexMeta, element: str) -> np.ndarray:
    """Records (rows of bytes) of vectors and neighbours, whose lists are bounded already; what a record cannot hold raises."""
    flat, near = vectors.flatten(), nbrs.flatten()
    if vectors.null_count or near.null_count or (element == "uint8" and flat.null_count):
        raise ValueError("a vector, one of its bytes or a neighbour is null")
    flat, near = flat.to_numpy(zero_copy_only=False), near.to_numpy(zero_copy_only=False)
    for name, values, dtype in (("component", flat, "u1"), ("neighbour", near, "<i4")):
        if (name == "neighbour" or element == "uint8") and len(values) and not np.iinfo(dtype).min <= values.min() <= values.max() <= np.iinfo(dtype).max:
            raise ValueError(f"a {name} is out of bounds")
    out = np.zeros((len(vectors), meta.record_bytes), dtype=np.uint8)
    out[:, : meta.vector_bytes] = flat.reshape(len(vectors), -1).astype(ELEMENTS[element][0]).view(np.uint8)
    degrees = nbrs.value_lengths().to_numpy(zero_copy_only=False)
    tail = np.zeros((len(vectors), 1 + meta.degree), dtype="<i4")
    tail[:, 0] = degrees
    tail[:, 1:][np.arange(meta.degree) < degrees[:, None]] = near
    out[:, meta.vector_bytes :] = tail.view(np.uint8)
    return out


def _schema(element: str) -> str:
    return f"node bigint, vector array<{ELEMENTS[element][1]}>, nbrs array<bigint>"


def read_index(spark: SparkSession, paths: str | list[str], element: str = "float") -> DataFrame:
    """node, vector, nbrs of every record, read by ranges of pages, a task a range; paths are the stripes in order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    meta = read_meta(paths[0], element)
    tasks = max(1, -(-meta.pages // PAGES_PER_TASK))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for task in part.column(0).to_pylist():
                end = min(meta.pages, (task + 1) * PAGES_PER_TASK)
                for at in range(task * PAGES_PER_TASK, end, PAGES_PER_BATCH):
                    pages = read_pages(paths, at + 1, min(PAGES_PER_BATCH, end - at))
                    records = pages[:, : meta.per_page * meta.record_bytes].reshape(-1, meta.record_bytes)
                    ids = np.arange(at * meta.per_page, min(meta.nodes, at * meta.per_page + len(records)))
                    yield unpack(records[: len(ids)], ids, meta, element)

    return spark.range(0, tasks, 1, tasks).mapInArrow(batches, _schema(element))


def read_nodes(ids: DataFrame, paths: str | list[str], element: str = "float", node: str = "node") -> DataFrame:
    """node, vector, nbrs of the nodes that a column of ids names; null and unknown ids give no row.

    Only the pages that hold them are read: ids are sorted into ranges, so a page is read about once.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    meta = read_meta(paths[0], element)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wanted = part.column(0).to_numpy()
            pages, of = np.unique(wanted // meta.per_page + 1, return_inverse=True)
            held = np.zeros((len(pages), PAGE_BYTES), dtype=np.uint8)
            for stripe, path in enumerate(paths):  # each file is opened once a batch, and read in order
                mine = np.flatnonzero(pages % len(paths) == stripe)
                if len(mine):
                    where, name = open_at(path)
                    with where.open_input_file(name) as f:
                        for i in mine.tolist():
                            raw = f.read_at(PAGE_BYTES, int(pages[i]) // len(paths) * PAGE_BYTES)
                            if len(raw) != PAGE_BYTES:
                                raise ValueError(f"{path}: shorter than its header says")
                            held[i] = np.frombuffer(raw, dtype=np.uint8)
            start = wanted % meta.per_page * meta.record_bytes
            records = held[of[:, None], start[:, None] + np.arange(meta.record_bytes)]
            yield unpack(records, wanted, meta, element)

    known = ids.select(F.col(node).cast("bigint").alias("node")).filter(F.col("node").between(0, meta.nodes - 1))
    return known.repartitionByRange("node").sortWithinPartitions("node").mapInArrow(batches, _schema(element))


def write_index(nodes: DataFrame, path: str, degree: int, medoid: int, element: str = "float", stripes: int = 1) -> list[str]:
    """Write node, vector, nbrs as an index of so many stripes (path, or path.0, path.1, ...); returns their names.

    A stripe is one task's work, which holds a batch of records at a time. Nodes must be numbered from 0 without gaps;
    lists longer than ``degree`` raise, as dropping edges is the caller's choice.
    """
    facts = nodes.agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.size("vector")).alias("width"),
                      F.min(F.size("vector")).alias("least"), F.max(F.size("nbrs")).alias("most")).first()
    if facts.n and (facts.low != 0 or facts.high != facts.n - 1 or facts.width != facts.least):
        raise ValueError("nodes must be numbered from 0 without gaps, with vectors of one width")
    if facts.n and facts.most > degree:
        raise ValueError(f"a node has {facts.most} neighbours, more than {degree}")
    meta = meta_of(facts.n, facts.width or 0, medoid, degree, element)
    names = [path] if stripes == 1 else [f"{path}.{i}" for i in range(stripes)]
    dtype, spark_type = ELEMENTS[element]
    header = np.zeros(PAGE_BYTES, dtype=np.uint8)
    header[:8] = np.array([9, 1], dtype="<i4").view(np.uint8)
    fields = [meta.nodes, meta.width, meta.medoid, meta.record_bytes, meta.per_page, 0, 0, 0, (meta.pages + 1) * PAGE_BYTES]
    header[8:80] = np.array(fields, dtype="<u8").view(np.uint8)

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Batches cut where a stripe ends."""
        for part in parts:
            of = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for at, end in zip(cuts, cuts[1:]):
                if end > at:
                    yield int(of[at]), part.slice(at, end - at)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, mine in groupby(runs(parts), key=lambda r: r[0]):
            with whole_file(names[stripe]) as f:
                written, last, slot, held = 0, 0, -1, None  # the page that may go on in the next batch, and its last record
                for _, part in mine:
                    if part.column(1)[0].as_py() == 0:
                        f.write(header.tobytes())
                        written, part = written + 1, part.slice(1)
                    if not part.num_rows:
                        continue
                    page, node = part.column(1).to_numpy(), part.column(2).to_numpy()
                    at, new = node - (page - 1) * meta.per_page, np.diff(page, prepend=last) != 0
                    wrong = np.flatnonzero(at != np.where(new, 0, np.concatenate(([slot], at[:-1])) + 1))
                    if len(wrong):
                        raise ValueError(f"node {node[wrong[0]]} is there twice, or one before it is missing")
                    if new[0] and held is not None:
                        f.write(held.tobytes())
                        written, held = written + 1, None
                    of = np.cumsum(new) - new[0]
                    out = np.zeros((of[-1] + 1, PAGE_BYTES), dtype=np.uint8)
                    if held is not None:
                        out[0] = held
                    body = pack_records(part.column(3), part.column(4), meta, element)
                    out[of[:, None], at[:, None] * meta.record_bytes + np.arange(meta.record_bytes)] = body
                    f.write(out[:-1].tobytes())
                    written, last, slot, held = written + len(out) - 1, int(page[-1]), int(at[-1]), out[-1].copy()
                if held is not None:
                    f.write(held.tobytes())
                    written += 1
            yield pa.RecordBatch.from_arrays([pa.array([names[stripe]]), pa.array([written])], ["file", "pages"])

    page = (F.floor(F.col("node") / meta.per_page) + 1).cast("bigint")
    head = nodes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("page"), F.lit(-1).cast("bigint").alias("node"),
                                               F.expr(f"cast(array() as array<{spark_type}>)").alias("vector"), F.expr("cast(array() as array<bigint>)").alias("nbrs"))
    placed = head.unionByName(nodes.select(page.alias("page"), F.col("node").cast("bigint").alias("node"), F.col("vector").cast(f"array<{spark_type}>").alias("vector"),
                                           F.coalesce(F.col("nbrs").cast("array<bigint>"), F.expr("cast(array() as array<bigint>)")).alias("nbrs")))
    dealt = placed.select(F.pmod("page", F.lit(stripes)).cast("int").alias("stripe"), "page", "node", "vector", "nbrs")
    dealt.repartition(stripes, "stripe").sortWithinPartitions("stripe", "page", "node").mapInArrow(batches, "file string, pages bigint").collect()
    return names


def edge_list(nodes: DataFrame) -> DataFrame:
    """src, dst, rk of node, nbrs."""
    out = nodes.select(F.col("node").alias("src"), F.posexplode("nbrs").alias("pos", "dst"))
    return out.select("src", "dst", (F.col("pos") + 1).cast("bigint").alias("rk"))


def _table(path: str, kind: str, offset: int) -> np.ndarray:
    s = shape(path, kind, offset)
    return read_rows(path, kind, 0, s.rows, s, offset)


def read_pq_model(path: str) -> PQModel:
    """The model of a pivots file: bounded by 256 vectors, so it is read on the driver."""
    where, name = open_at(path)
    with where.open_input_file(name) as f:
        n, columns = np.frombuffer(f.read_at(8, 0), dtype="<i4").tolist()
        if n not in (4, 5) or columns != 1:
            raise ValueError(f"{path}: {n} tables; 4 or 5 are known")
        at = np.frombuffer(f.read_at(8 * n, 8), dtype="<u8").tolist()
    pivots, centroid = _table(path, "fbin", at[0]), _table(path, "fbin", at[1])
    offsets = _table(path, "ibin", at[3 if n == 5 else 2]).ravel().tolist()
    if len(centroid.ravel()) != pivots.shape[1] or offsets[0] != 0 or offsets[-1] != pivots.shape[1]:
        raise ValueError(f"{path}: its tables do not fit together")
    wide = pivots.astype(np.float64)
    return PQModel(tuple(offsets), tuple(wide[:, a:b] for a, b in zip(offsets, offsets[1:])), centroid.ravel().astype(np.float64))


def write_pq_model(model: PQModel, path: str) -> None:
    width = model.offsets[-1]
    pivots = np.zeros((FILE_PIVOTS, width), dtype="<f4")
    for j, p in enumerate(model.pivots):
        pivots[:, model.offsets[j] : model.offsets[j + 1]] = p[np.minimum(np.arange(FILE_PIVOTS), len(p) - 1)]
    tables = [pivots, np.asarray(model.centroid, dtype="<f4")[:, None], np.array(model.offsets, dtype="<i4")[:, None]]
    blocks = [np.array(t.shape, dtype="<i4").tobytes() + t.tobytes() for t in tables]
    at = np.concatenate(([TABLES_AT], TABLES_AT + np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = np.array([len(at), 1], dtype="<i4").tobytes() + at.tobytes()
    with whole_file(path) as f:
        f.write(head.ljust(TABLES_AT, b"\0"))
        for b in blocks:
            f.write(b)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, code of a codes file."""
    return read_vectors(spark, path, "bbin").select(F.col("pos").alias("vec_id"), F.col("vector").alias("code"))


def write_codes(codes: DataFrame, path: str) -> DataFrame:
    """Write vec_id, code under the folder path, a bbin file a partition; one file of coalesce(1) is what read_codes() takes."""
    return write_vectors(codes, path, "bbin", "vec_id", "code")


def read_nav_start(path: str) -> int:
    """The node that walks of a navigation graph start from, of the file's header."""
    where, name = open_at(path)
    with where.open_input_file(name) as f:
        head = f.read_at(24, 0)
    if len(head) < 24:
        raise ValueError(f"{path}: no header")
    return int(np.frombuffer(head, dtype="<i4")[3])


def nav_places(path: str, rows: int) -> tuple[list[int], int]:
    """Where every so many records of a navigation graph begin, and how many there are: one pass over the degrees."""
    where, name = open_at(path)
    most, node, at, out = 0, 0, 24, []
    with where.open_input_stream(name, buffer_size=1 << 20) as f:
        head = f.read(24)
        if len(head) < 24:
            raise ValueError(f"{path}: no header")
        most = int(np.frombuffer(head, dtype="<i4")[2])
        while len(raw := f.read(4)) == 4:
            n = int.from_bytes(raw, "little", signed=True)
            if not 0 <= n <= most or len(f.read(4 * n)) != 4 * n:
                raise ValueError(f"{path}: node {node} is broken")
            if node % rows == 0:
                out.append(at)
            node, at = node + 1, at + 4 + 4 * n
    return out, node


def nav_records(path: str, at: int, first: int, end: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(nav_ids, neighbours) of the records first .. end - 1, which begin at a byte of the file."""
    where, name = open_at(path)
    with where.open_input_file(name) as f:
        f.seek(at)
        for begin in range(first, end, NAV_BATCH):
            held = []
            for _ in range(begin, min(end, begin + NAV_BATCH)):
                n = int.from_bytes(f.read(4), "little", signed=True)
                held.append(np.frombuffer(f.read(4 * n), dtype="<i4").astype(np.int64))
            yield np.arange(begin, begin + len(held)), held


def read_nav_graph(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """nav_id, nbrs of a navigation graph, read by ranges of so many records: the driver looks at their lengths once."""
    rows = NAV_ROWS if rows is None else rows
    places, end = nav_places(path, rows)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for task in part.column(0).to_pylist():
                for ids, near in nav_records(path, places[task], task * rows, min(end, (task + 1) * rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.list_(pa.int64()))], ["nav_id", "nbrs"])

    return spark.range(0, len(places), 1, max(1, len(places))).mapInArrow(batches, "nav_id bigint, nbrs array<bigint>")


def write_nav_graph(graph: DataFrame, path: str, start: int = 0) -> None:
    """Write nav_id, nbrs, in the order of nav_id, by one task."""
    most = graph.agg(F.max(F.size("nbrs"))).first()[0] or 0

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with whole_file(path) as f:
            f.write(np.array([0, 0, most, start, 0, 0], dtype="<i4").tobytes())
            for part in parts:
                for near in part.column(0).to_pylist():
                    f.write(np.array([len(near or ()), *(near or ())], dtype="<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["file"])

    graph.coalesce(1).sortWithinPartitions("nav_id").select("nbrs").mapInArrow(batches, "file string").collect()


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """nav_id, vec_id of a text file with one id a line; blank lines raise."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                where, name = open_at(path)
                with where.open_input_stream(name) as f:
                    ids = np.array([int(line) for line in f.read().decode("ascii").splitlines()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(ids)], ["nav_id", "vec_id"])

    return spark.range(0, 1, 1, 1).mapInArrow(batches, "nav_id bigint, vec_id bigint")


def write_map(nav: DataFrame, path: str) -> None:
    """Write nav_id, vec_id as one id a line, in the order of nav_id."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with whole_file(path) as f:
            for part in parts:
                f.write("".join(f"{x}\n" for x in part.column(0).to_pylist()).encode("ascii"))
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["file"])

    nav.coalesce(1).sortWithinPartitions("nav_id").select("vec_id").mapInArrow(batches, "file string").collect()


def write_tags(nav: DataFrame, path: str) -> DataFrame:
    """Write the ids of a map as ibin rows of one component, under the folder path."""
    return write_vectors(nav.select("nav_id", F.array("vec_id").alias("tag")).coalesce(1), path, "ibin", "nav_id", "tag")
