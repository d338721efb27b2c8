"""Embedding whitening by hierarchical SVD merging.

Entries are made integers first, x = floor(1024 * c) + 100000, so that counts and sums are exact. Each
partition goes through its vectors in blocks and keeps, for each width of vectors, their number n, their
exact sums S, and the singular values times the right singular vectors of the vectors less their mean:
all of them, as many as there are dimensions. Two such summaries merge losslessly: their rows are
stacked, with one row more that corrects for the difference of the means,

    sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2),

and the stack's SVD is the summary of the union. Partitions merge in rounds of FAN_IN, in the order of
their numbers, until one summary a width is left: its squared singular values over n are the
eigenvalues of the covariance, its right singular vectors the components. The difference of the means
is taken from the exact sums, so that the offset of 100000 costs no digits.

What a task holds is a block of vectors and a few square matrices of the width; what reaches the
driver is one such matrix a width.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Summaries merged at a time, vectors of a block.
FAN_IN, BLOCK = 8, 2048
#: Bytes of the models of all widths, which go to every worker.
MODEL_BYTES = 1 << 28
#: A component whose eigenvalue is this much less than the largest one is numerically zero.
ZERO = 1e-18
_SUMMARY = "width int, node bigint, n bigint, sums array<string>, axes array<double>"


class Summary:
    """n vectors of one width: their exact sums, and singular values times right singular vectors about their mean."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray) -> None:
        self.n, self.sums, self.axes = n, sums, axes

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of a block of integer vectors."""
        sums = [int(s) for s in x.sum(axis=0)] if np.abs(x).max(initial=0) < 2**62 // max(1, len(x)) else [sum(map(int, column)) for column in x.T]
        return cls(len(x), sums, right(centred(x, len(x), sums)))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        correction = np.sqrt(self.n / n * other.n) * apart
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], right(np.vstack([self.axes, other.axes, correction])))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean sums / n: whole parts are taken off as integers."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, dtype=x.dtype)).astype(np.float64) - rest


def right(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors, at most one row a dimension."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, widths, flat entries) of the vectors that take part, entries as floor(SCALE * c) + OFFSET."""
    if not len(vectors):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    widths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE  # nulls become NaN
    owner = np.repeat(np.arange(len(widths)), widths)
    ok = widths > 0
    ok[owner[~np.isfinite(flat)]] = False
    return np.flatnonzero(ok), widths[ok], np.floor(flat[ok[owner]]) + OFFSET


def blocks(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, integer matrix) of up to BLOCK vectors of one width."""
    places, widths, flat = integers(vectors)
    ends = np.cumsum(widths)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            x = flat[(ends[some] - width)[:, None] + np.arange(width)]
            yield int(width), places[some], x.astype(np.int64) if np.abs(x).max() < 2.0**62 else np.array([[int(v) for v in row] for row in x], dtype=object)


def records(found: list[tuple[int, int, Summary]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([w for w, _, _ in found], pa.int32()), pa.array([node for _, node, _ in found], pa.int64()), pa.array([s.n for _, _, s in found], pa.int64()),
        pa.array([[str(v) for v in s.sums] for _, _, s in found], pa.list_(pa.string())),
        pa.array([s.axes.ravel() for _, _, s in found], pa.list_(pa.float64()))], ["width", "node", "n", "sums", "axes"])


def summary(row: dict) -> Summary:
    return Summary(row["n"], [int(v) for v in row["sums"]], np.array(row["axes"]).reshape(-1, row["width"]))


def leaves(vectors: DataFrame) -> DataFrame:
    """A summary for each partition and width of vectors (one column)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Summary] = {}
        for part in parts:
            for width, _, x in blocks(part.column(0)):
                one = Summary.of(x)
                held[width] = held[width].merge(one) if width in held else one
        for width in sorted(held):
            yield records([(width, TaskContext.get().partitionId(), held[width])])

    return vectors.mapInArrow(batches, _SUMMARY)


def merged(table: pa.Table) -> pa.Table:
    """One summary of all in a group."""
    rows = sorted(table.to_pylist(), key=lambda r: r["node"])
    out = summary(rows[0])
    for row in rows[1:]:
        out = out.merge(summary(row))
    return pa.Table.from_batches([records([(rows[0]["width"], rows[0]["node"] // FAN_IN, out)])])


def fit(df: DataFrame, vector_col: str = "embedding") -> dict[int, Summary]:
    """The summary of all vectors of each width."""
    found = cut(leaves(df.select(F.col(vector_col).alias("v"))))
    nodes = (found.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        found = found.groupBy("width", F.floor(F.col("node") / FAN_IN).alias("parent")).applyInArrow(merged, _SUMMARY)
        nodes = -(-nodes // FAN_IN)
    out, held = {}, 0
    for row in found.orderBy("width").toLocalIterator():  # one row a width
        held += 8 * len(row["axes"])
        if held > MODEL_BYTES:
            raise ValueError(f"the models of all widths are over {MODEL_BYTES} bytes")
        out[row["width"]] = summary(row.asDict())
    return out


def components(found: Summary, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit vectors as rows, their eigenvalues, trace) of the covariance, by falling eigenvalue."""
    square = (found.axes**2).sum(axis=1) / found.n
    lengths = np.sqrt(square * found.n)
    units = np.divide(found.axes, lengths[:, None], out=np.zeros_like(found.axes), where=lengths[:, None] > 0)
    few = min(most, len(found.sums))
    units, values = units[:few], square[:few]
    if len(values) < few:  # fewer vectors than dimensions
        units, values = np.vstack([units, np.zeros((few - len(values), len(found.sums)))]), np.append(values, np.zeros(few - len(values)))
    return units, np.where(values > ZERO * square.max(initial=0), values, 0), float(square.sum())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Of each vector, the sum over dimensions of (n * x - S) ** 2, exactly; beyond 38 digits, None."""
    most = max(abs(n * int(v) - s) for column, s in zip(x.T, sums) for v in (column.min(), column.max()))
    if x.dtype == np.int64 and n * int(np.abs(x).max()) < 2**62 and max(map(abs, sums)) < 2**62 and most * most * len(sums) < 2**62:
        return [Decimal(int(v)) for v in ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)]
    apart = x.astype(object) * n - np.array(sums, dtype=object)
    return [Decimal(int(v)) if v < 10**38 else None for v in (apart * apart).sum(axis=1)]


def project(df: DataFrame, models: dict[int, Summary], id_col: str, vector_col: str, most: int) -> DataFrame:
    """id, width, deviation, z: the whitened components of every vector that takes part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    parts_of = {w: (s.n, s.sums, *components(s, most)[:2]) for w, s in models.items()}
    shared = df.sparkSession.sparkContext.broadcast(parts_of)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for width, places, x in blocks(part.column(1)):
                n, sums, units, values = shared.value[width]
                z = centred(x, n, sums) @ units.T
                z = np.divide(z, np.sqrt(values), out=np.full_like(z, np.nan), where=values > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(places)), pa.array(np.full(len(z), width), pa.int32()),
                    pa.array(deviations(x, n, sums), pa.decimal128(38, 0)), lists], ["id", "width", "deviation", "z"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, width int, deviation decimal(38,0), z array<double>")


def identity_errors(done: DataFrame, models: dict[int, Summary], most: int) -> dict[int, float]:
    """Of each width, how far the covariance of the whitened vectors is from the identity at most."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for part in parts:
            widths = part.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                z = np.nan_to_num(np.array(part.column(1).filter(pa.array(widths == width)).to_pylist(), dtype=np.float64))
                mean = z.mean(axis=0)
                one = (len(z), mean, (z - mean).T @ (z - mean))
                held[width] = joined(held[width], one) if width in held else one
        for width, (n, mean, square) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([square.ravel()], pa.list_(pa.float64()))], ["width", "n", "mean", "square"])

    def joined(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])

    total: dict[int, tuple] = {}
    for r in done.select("width", "z").mapInArrow(batches, "width int, n bigint, mean array<double>, square array<double>").toLocalIterator():  # most ** 2 numbers a task
        one = (r["n"], np.array(r["mean"]), np.array(r["square"]).reshape(len(r["mean"]), -1))
        total[r["width"]] = joined(total[r["width"]], one) if r["width"] in total else one
    out = {}
    for width, (n, _, square) in total.items():
        live = components(models[width], most)[1] > 0
        out[width] = float(np.abs(square[live][:, live] / n - np.eye(int(live.sum()))).max(initial=0))
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null or non-finite entry take no part; repeated rows count each,
    and so do rows with a null id. Vectors of another width are fitted among themselves: n, components and
    identity_error are those of the vector's width, which has as many components as dimensions where these
    are fewer than ``most``. A component along which no vector differs (constant entries, fewer vectors than
    components, a single vector) has null whitened values and is left out of identity_error; explained is 0
    then, and 0 if no component has any variance. deviation is exact, a decimal of up to 38 digits, and null beyond them. Equal
    eigenvalues leave their components open, as any rotation of them is as good. An empty table gives an
    empty result; other columns are not read.
    """
    spark = df.sparkSession
    models = fit(df, vector_col)
    done = cut(project(df, models, id_col, vector_col, most))
    errors = identity_errors(done, models, most)
    rows = []
    for width, found in models.items():
        _, values, trace = components(found, most)
        rows.append((width, found.n, [float(v / trace) if trace else 0.0 for v in values], errors.get(width, 0.0)))
    known = F.broadcast(spark.createDataFrame(rows, "width int, n bigint, shares array<double>, identity_error double"))  # one row a width
    each = done.join(known, "width").select("id", "n", "deviation", "shares", "identity_error", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        "id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("shares")[F.col("at")].alias("explained"), "identity_error")
