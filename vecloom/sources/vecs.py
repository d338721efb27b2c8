"""Readers and writers of binary vector files (little-endian).

``fvecs``, ``ivecs`` and ``bvecs`` hold per row its width (int32) and components; ``fbin``, ``ibin`` and
``bbin`` begin with the numbers of rows and components (int32 each). Files are read by ranges of rows,
a task a range, through Arrow's file systems (local, HDFS, S3), and written a file a partition.
Unsigned bytes become ``smallint``, as Spark has no unsigned type.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each format: component type, Spark type, whether the header is per row.
FORMATS = {
    "fvecs": ("<f4", "float", True), "ivecs": ("<i4", "int", True), "bvecs": ("u1", "smallint", True),
    "fbin": ("<f4", "float", False), "ibin": ("<i4", "int", False), "bbin": ("u1", "smallint", False)}
ROWS_PER_TASK = 100_000
ROWS_PER_BATCH = 4096
COPY_BYTES = 1 << 22


@dataclass(frozen=True)
class Shape:
    rows: int
    width: int


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the name there."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shape(path: str, kind: str, offset: int = 0) -> Shape:
    """Rows and components of a file; a truncated or empty one raises ValueError, but for no rows at all."""
    dtype, _, per_row = FORMATS[kind]
    item, (where, name) = np.dtype(dtype).itemsize, open_at(path)
    size = where.get_file_info(name).size - offset
    if per_row and size == 0:
        return Shape(0, 0)
    with where.open_input_file(name) as f:
        head = np.frombuffer(f.read_at(4 if per_row else 8, offset), dtype="<i4")
    if len(head) < (1 if per_row else 2):
        raise ValueError(f"{path}: no header")
    if per_row:
        stride = 4 + int(head[0]) * item
        if head[0] <= 0 or size % stride:
            raise ValueError(f"{path}: {size} bytes are no whole number of rows of {stride}")
        return Shape(size // stride, int(head[0]))
    if size < 8 + int(head[0]) * int(head[1]) * item:
        raise ValueError(f"{path}: shorter than its header says")
    return Shape(int(head[0]), int(head[1]))


def read_rows(path: str, kind: str, first: int, n: int, s: Shape, offset: int = 0) -> np.ndarray:
    """n rows from the first on, as a matrix."""
    dtype, _, per_row = FORMATS[kind]
    item, (where, name) = np.dtype(dtype).itemsize, open_at(path)
    stride = s.width * item + 4 * per_row
    with where.open_input_file(name) as f:
        raw = f.read_at(n * stride, offset + (0 if per_row else 8) + first * stride)
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(n, stride)
    if per_row and n and (rows[:, :4].copy().view("<i4") != s.width).any():
        raise ValueError(f"{path}: rows differ in width")
    return np.ascontiguousarray(rows[:, 4 * per_row :]).view(dtype)


def read_vectors(spark: SparkSession, path: str, kind: str, offset: int = 0, first: int = 0, limit: int | None = None) -> DataFrame:
    """pos, vector: rows first .. first + limit of a file; offset is where its header (or first row) begins."""
    s, (_, spark_type, _) = shape(path, kind, offset), FORMATS[kind]
    n = max(0, min(s.rows - first, s.rows if limit is None else limit))
    tasks = max(1, -(-n // ROWS_PER_TASK))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for task in part.column(0).to_pylist():
                end = min(n, (task + 1) * ROWS_PER_TASK)
                for at in range(task * ROWS_PER_TASK, end, ROWS_PER_BATCH):
                    m = read_rows(path, kind, first + at, min(ROWS_PER_BATCH, end - at), s, offset)
                    m = m.astype(np.int16) if kind.startswith("b") else m
                    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * s.width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(m))), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], ["pos", "vector"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(batches, f"pos bigint, vector array<{spark_type}>")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, ids, dists of a ground-truth file: numbers of rows and columns, ids, then distances."""
    s = shape(path, "ibin")
    ids = read_vectors(spark, path, "ibin").select(F.col("pos").alias("qid"), F.col("vector").alias("ids"))
    where, name = open_at(path)
    begin = 8 + 4 * s.rows * s.width

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.column(0).to_numpy()
            with open_at(path)[0].open_input_file(name) as f:
                dists = [np.frombuffer(f.read_at(4 * s.width, begin + int(r) * 4 * s.width), dtype="<f4") for r in rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(dists, pa.list_(pa.float32()))], ["qid", "ids", "dists"])

    return ids.mapInArrow(batches, "qid bigint, ids array<int>, dists array<float>")


def write_block(path: str, rows: np.ndarray, kind: str, offset: int) -> int:
    """Write a matrix with its header (``fbin``, ``ibin``, ``bbin``) at an offset of a file; returns where it ends.

    What lies before and after it in the file stays; a gap is filled with zeros. The file is replaced as a whole.
    """
    dtype, _, per_row = FORMATS[kind]
    if per_row:
        raise ValueError(f"{kind} has no header to write at an offset")
    body = np.array(rows.shape, dtype="<i4").tobytes() + np.ascontiguousarray(rows, dtype=dtype).tobytes()
    where, name = open_at(path)
    size = where.get_file_info(name).size or 0
    with whole_file(path) as f:
        if size:
            with where.open_input_file(name) as old:
                copy_range(old, f, 0, min(offset, size))
        f.write(b"\0" * max(0, offset - size))
        f.write(body)
        if size > offset + len(body):
            with where.open_input_file(name) as old:
                copy_range(old, f, offset + len(body), size)
    return offset + len(body)


def copy_range(source, target, first: int, end: int) -> None:
    for at in range(first, end, COPY_BYTES):
        target.write(source.read_at(min(COPY_BYTES, end - at), at))


@contextmanager
def whole_file(name: str):
    """A stream to a file that bears its name only once it is whole, so that a task that is run again leaves no half."""
    where, target = open_at(name)
    where.create_dir(target.rpartition("/")[0], recursive=True)
    draft = f"{target}.{uuid.uuid4().hex}.draft"
    try:
        with where.open_output_stream(draft) as f:
            yield f
        if where.get_file_info(target).type != fs.FileType.NotFound:
            where.delete_file(target)
        where.move(draft, target)
    finally:
        if where.get_file_info(draft).type != fs.FileType.NotFound:
            where.delete_file(draft)


def append(f, name: str) -> None:
    """Copy the file of that name to the end of a stream, and delete it."""
    where, target = open_at(name)
    with where.open_input_stream(target) as body:
        while chunk := body.read(COPY_BYTES):
            f.write(chunk)
    where.delete_file(target)


def write_file(name: str, kind: str, lists: Iterator[pa.Array]) -> Shape:
    """Write vectors, batch by batch, as one file. No vectors make no file.

    A batch at a time is held: where the header counts the rows, they go to a file beside it first.
    """
    dtype, _, per_row = FORMATS[kind]
    rows = width = 0
    body = name if per_row else f"{name}.{uuid.uuid4().hex}.body"
    lists = (some for some in lists if len(some))
    first = next(lists, None)
    if first is None:
        return Shape(0, 0)
    with whole_file(body) as f:
        for some in chain([first], lists):
            m = some.flatten().to_numpy(zero_copy_only=False)
            if some.null_count or len(m) % len(some) or np.ptp(some.value_lengths().to_numpy()) or rows and len(m) != width * len(some) or not len(m):
                raise ValueError(f"{name}: rows differ in width")
            m = m.reshape(len(some), -1).astype(dtype)
            rows, width = rows + len(m), m.shape[1]
            if per_row:
                heads = np.full((len(m), 1), width, dtype="<i4").view(np.uint8)
                f.write(np.concatenate((heads, m.view(np.uint8).reshape(len(m), -1)), axis=1).tobytes())
            else:
                f.write(m.tobytes())
    if not per_row:
        with whole_file(name) as f:
            f.write(np.array([rows, width], dtype="<i4").tobytes())
            append(f, body)
    return Shape(rows, width)


def write_vectors(df: DataFrame, path: str, kind: str, order: str = "pos", vector: str = "vector") -> DataFrame:
    """Write df's vectors under the folder path, a file a partition, in the order of a column.

    The result lists the files with their rows. For a single file, coalesce df to one partition first.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.{kind}"
        written = write_file(name, kind, (part.column(0) for part in parts))
        if written.rows:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written.rows])], ["file", "rows"])

    return df.sortWithinPartitions(order).select(vector).mapInArrow(batches, "file string, rows bigint")


def write_truth(df: DataFrame, path: str) -> DataFrame:
    """Write qid, ids, dists as a ground-truth file, in the order of qid; one file is one task's work. Lists file and rows."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = width = 0
        bodies = [f"{path}.{uuid.uuid4().hex}.{what}" for what in ("ids", "dists")]
        with whole_file(bodies[0]) as ids, whole_file(bodies[1]) as dists:
            for part in parts:
                if part.num_rows:
                    for f, lists, dtype in ((ids, part.column(0), "<i4"), (dists, part.column(1), "<f4")):
                        m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(dtype)
                        if width and m.shape[1] != width:
                            raise ValueError(f"{path}: rows differ in width")
                        width = m.shape[1]
                        f.write(m.tobytes())
                    rows += part.num_rows
        with whole_file(path) as f:
            f.write(np.array([rows, width], dtype="<i4").tobytes())
            for body in bodies:
                append(f, body)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows])], ["file", "rows"])

    return df.coalesce(1).sortWithinPartitions("qid").select("ids", "dists").mapInArrow(batches, "file string, rows bigint")
