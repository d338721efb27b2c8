"""Vector and index files as data sources, read and written: ``spark.read.format("vecs").load(path)``.

* ``vecs`` (option ``kind``, by the file's ending unless given) and ``vecbin`` (option ``dtype``): pos, vector. A
  folder's files are one table, in the order of their names. Options ``offset`` (bytes), ``first``, ``limit`` (rows).
* ``paged``: node, vector, nbrs of a paged index; stripes are joined by commas. Options ``element``, ``pages``
  (of a task), and ``place`` for the page and the byte in it that each record was read from.
* ``truth``: qid, ids, dists; ``pqcodes``: vec_id, code; ``navgraph``: nav_id, nbrs, whose records vary in length:
  one pass over its degrees cuts it into ranges.

Call register() first. Rows are read by ranges, a task a range. Comparisons of the first column with numbers
narrow the ranges, and leave the plan. Load anew for each query: Spark 4.1 keeps the ranges of a DataFrame's
first filters for its later scans.

``df.write.format("vecs").option("kind", ...).mode(...).save(folder)`` writes the column ``vector``, a file a task, in
the order that the rows have in each partition. Files get their names when all tasks are done; those of tasks that
failed or ran twice go. ``vecbin`` writes too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api

from . import index_files as files
from .vecs import FORMATS, ROWS_PER_BATCH, ROWS_PER_TASK, Shape, open_at, read_rows, shape, write_file


class RowRange(api.InputPartition):
    def __init__(self, first: int, end: int, of: int = 0, at: int = 0) -> None:
        self.first, self.end, self.of, self.at = first, end, of, at


class RangeReader(api.DataSourceReader):
    """Rows numbered from 0 in ``key``; filters of it narrow first and end, and an IN what lies between."""

    key: str
    first, end = 0, 0
    RANGES = {
        api.GreaterThan: lambda v: (v + 1, None), api.GreaterThanOrEqual: lambda v: (v, None), api.LessThan: lambda v: (None, v),
        api.LessThanOrEqual: lambda v: (None, v + 1), api.EqualTo: lambda v: (v, v + 1)}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.key,):
                if isinstance(f, api.In) and (numbers := [v for v in f.value if isinstance(v, int)]):
                    self.narrow(min(numbers), max(numbers) + 1)
                elif isinstance(value, int) and (of := self.RANGES.get(type(f))):
                    self.narrow(*of(value))
                    continue  # the range is the filter
            yield f

    def narrow(self, low: int | None, high: int | None) -> None:
        self.first = self.first if low is None else max(self.first, low)
        self.end = self.end if high is None else min(self.end, high)

    def ranges(self, size: int) -> list[RowRange]:
        return [RowRange(at, min(self.end, at + size)) for at in range(self.first, self.end, size)] or [RowRange(0, 0)]


def lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


class VectorReader(RangeReader):
    key = "pos"

    def __init__(self, path: str, kind: str, offset: int = 0, first: int = 0, limit: int | None = None) -> None:
        where, name = open_at(path)
        self.paths, self.kind, self.offset = [path], kind, offset
        if where.get_file_info(name).type == fs.FileType.Directory:
            inside = [f.base_name for f in where.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
            self.paths = [f"{path.rstrip('/')}/{base}" for base in sorted(inside)]
        self.shapes = [shape(p, kind, offset) for p in self.paths]
        self.starts = np.cumsum([0, *[s.rows for s in self.shapes]])
        total = int(self.starts[-1])
        self.first, self.end = first, total if limit is None else min(total, first + limit)

    def partitions(self) -> list[RowRange]:
        out = []
        for i, s in enumerate(self.shapes):
            begin = int(self.starts[i])
            low, high = max(self.first, begin), min(self.end, begin + s.rows)
            out += [RowRange(at - begin, min(high, at + ROWS_PER_TASK) - begin, i, begin) for at in range(low, high, ROWS_PER_TASK)]
        return out or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.end, ROWS_PER_BATCH):
            m = read_rows(self.paths[partition.of], self.kind, at, min(ROWS_PER_BATCH, partition.end - at), self.shapes[partition.of], self.offset)
            m = m.astype(np.int16) if self.kind.startswith("b") else m
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(m)) + partition.at), lists(m)], ["pos", "vector"])


@dataclass
class Written(api.WriterCommitMessage):
    """What a task wrote: its partition, its draft, rows and components."""

    partition: int
    name: str
    rows: int
    width: int


class VectorWriter(api.DataSourceArrowWriter):
    """A file a task: drafts in a folder of the job's own, which get their names at the end."""

    def __init__(self, path: str, kind: str, column: int, overwrite: bool) -> None:
        self.path, self.kind, self.column, self.overwrite = path.rstrip("/"), kind, column, overwrite
        self.drafts = f"{self.path}/.job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.drafts}/{task.partitionId()}-{task.taskAttemptId()}.{self.kind}"
        written = write_file(name, self.kind, (part.column(self.column) for part in iterator))
        return Written(task.partitionId(), name, written.rows, written.width)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if len({m.width for m in done}) > 1:
            self.abort(messages)
            raise ValueError(f"{self.path}: tasks wrote vectors of different widths")
        where, folder = open_at(self.path)
        where.create_dir(folder, recursive=True)
        held = [f for f in where.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
        if self.overwrite:
            for f in held:
                where.delete_file(f.path)
            held = []
        begin = 1 + max((int(f.base_name[5:10]) for f in held if f.base_name.startswith("part-") and f.base_name[5:10].isdigit()), default=-1)
        for i, m in enumerate(done):
            where.move(open_at(m.name)[1], f"{folder}/part-{begin + i:05d}.{self.kind}")
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        where, drafts = open_at(self.drafts)
        if where.get_file_info(drafts).type != fs.FileType.NotFound:
            where.delete_dir(drafts)


class VectorSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def kind(self) -> str:
        kind = self.options.get("kind") or self.options["path"].rpartition(".")[2]
        if kind not in FORMATS:
            raise ValueError(f"option kind must be one of {', '.join(FORMATS)}")
        return kind

    def schema(self) -> str:
        return f"pos bigint, vector array<{FORMATS[self.kind()][1]}>"

    def reader(self, schema) -> VectorReader:
        number = lambda name: int(self.options.get(name, 0))
        limit = self.options.get("limit")
        return VectorReader(self.options["path"], self.kind(), number("offset"), number("first"), None if limit is None else int(limit))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        if "vector" not in schema.names:
            raise ValueError("the column to be written must be called vector")
        return VectorWriter(self.options["path"], self.kind(), schema.names.index("vector"), overwrite)


class TypedSource(VectorSource):
    """format("vecbin"): files with one header, of the component type that option ``dtype`` names."""

    KINDS = {"float": "fbin", "int": "ibin", "uint8": "bbin"}

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def kind(self) -> str:
        if (dtype := self.options.get("dtype", "float")) not in self.KINDS:
            raise ValueError(f"option dtype must be one of {', '.join(self.KINDS)}")
        return self.KINDS[dtype]


class PagedReader(RangeReader):
    key = "node"

    def __init__(self, paths: list[str], element: str, place: bool, pages: int = files.PAGES_PER_TASK) -> None:
        self.paths, self.element, self.place, self.pages, self.meta = paths, element, place, pages, files.read_meta(paths[0], element)
        self.first, self.end = 0, self.meta.nodes

    def partitions(self) -> list[RowRange]:
        return self.ranges(self.pages * self.meta.per_page)

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        each, size = self.meta.per_page, self.meta.record_bytes
        first_page, last_page = partition.first // each, -(-partition.end // each)
        for at in range(first_page, last_page, files.PAGES_PER_BATCH):
            pages = files.read_pages(self.paths, at + 1, min(files.PAGES_PER_BATCH, last_page - at))
            ids = np.arange(at * each, (at + len(pages)) * each)
            keep = (ids >= partition.first) & (ids < partition.end)
            records = pages[:, : each * size].reshape(-1, size)[keep]
            out = files.unpack(records, ids[keep], self.meta, self.element)
            if self.place:
                slot = np.flatnonzero(keep)
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(slot // each + at + 1), pa.array(slot % each * size)], [*out.schema.names, "page", "byte_offset"])
            yield out


class PagedSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def options_of(self) -> tuple[list[str], str, bool, int]:
        of = self.options
        return of["path"].split(","), of.get("element", "float"), of.get("place", "false").lower() == "true", int(of.get("pages", files.PAGES_PER_TASK))

    def schema(self) -> str:
        _, element, place, _ = self.options_of()
        return f"node bigint, vector array<{files.ELEMENTS[element][1]}>, nbrs array<bigint>" + (", page bigint, byte_offset bigint" if place else "")

    def reader(self, schema) -> PagedReader:
        return PagedReader(*self.options_of())


class TruthReader(RangeReader):
    key = "qid"

    def __init__(self, path: str) -> None:
        self.path, self.shape = path, shape(path, "ibin")
        self.first, self.end = 0, self.shape.rows

    def partitions(self) -> list[RowRange]:
        return self.ranges(ROWS_PER_TASK)

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        width, (where, name) = self.shape.width, open_at(self.path)
        for at in range(partition.first, partition.end, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, partition.end - at)
            ids = read_rows(self.path, "ibin", at, n, self.shape)
            with where.open_input_file(name) as f:
                raw = f.read_at(4 * width * n, 8 + 4 * width * (self.shape.rows + at))
            if len(raw) != 4 * width * n:
                raise ValueError(f"{self.path}: shorter than its header says")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists(ids), lists(np.frombuffer(raw, dtype="<f4").reshape(n, width))], ["qid", "ids", "dists"])


class TruthSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "truth"

    def schema(self) -> str:
        return "qid bigint, ids array<int>, dists array<float>"

    def reader(self, schema) -> TruthReader:
        return TruthReader(self.options["path"])


class CodeReader(VectorReader):
    key = "vec_id"

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        return (part.rename_columns(["vec_id", "code"]) for part in super().read(partition))


class CodeSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "pqcodes"

    def schema(self) -> str:
        return "vec_id bigint, code array<smallint>"

    def reader(self, schema) -> CodeReader:
        return CodeReader(self.options["path"], "bbin")


class NavReader(RangeReader):
    key = "nav_id"

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows
        self.places, self.end = files.nav_places(path, rows)

    def partitions(self) -> list[RowRange]:
        out = []
        for i, at in enumerate(self.places):
            begin = i * self.rows
            low, high = max(self.first, begin), min(self.end, begin + self.rows)
            out += [RowRange(low, high, begin, at)] if low < high else []
        return out or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        for ids, near in files.nav_records(self.path, partition.at, partition.of, partition.end):
            keep = ids >= partition.first
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([x for x, k in zip(near, keep) if k], pa.list_(pa.int64()))], ["nav_id", "nbrs"])


class NavSource(api.DataSource):
    """format("navgraph"); option ``rows``: nodes a task."""

    @classmethod
    def name(cls) -> str:
        return "navgraph"

    def schema(self) -> str:
        return "nav_id bigint, nbrs array<bigint>"

    def reader(self, schema) -> NavReader:
        return NavReader(self.options["path"], int(self.options.get("rows", files.NAV_ROWS)))


SOURCES = (VectorSource, TypedSource, PagedSource, TruthSource, CodeSource, NavSource)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let Spark push filters down to them (it refuses sources that take any otherwise)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)


__all__ = ["SOURCES", "Shape", "VectorReader", "VectorWriter", "register"]
