"""Column builders over vectors (arrays of numbers). All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Added to the product of norms in a cosine, so that a zero vector divides.
COSINE_EPS = 1e-6


def cast_vector(v: Column) -> Column:
    """Any numeric vector in doubles."""
    return v.cast("array<double>")


def vec_sum(v: ColumnOrName) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x)


def l2(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Squared Euclidean distance, without a root."""
    return vec_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return vec_sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(COSINE_EPS))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.lit(1.0) - cosine(a, b)


def center(v: ColumnOrName, mean: ColumnOrName) -> Column:
    return F.zip_with(v, mean, lambda x, m: x - m)


def chunks(v: ColumnOrName, n: int, width: int) -> Column:
    """v cut into n runs of width (the last takes what is left)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.slice(v, j * width + 1, F.lit(width)))


def replicate(v: Column, times: int) -> Column:
    """Each component times over, in place."""
    return F.flatten(F.transform(v, lambda x: F.array_repeat(x, times)))


def adc(lut: Column, code: Column) -> Column:
    """Sum over chunks of the lookup table's entry for the chunk's code."""
    places = F.sequence(F.lit(0), F.size(code) - 1)
    return F.aggregate(places, F.lit(0.0), lambda total, j: total + F.get(F.get(lut, j), F.get(code, j)))


_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_COSINE = f"{_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}) + {COSINE_EPS!r}D)"
_PAIR = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
#: SQL functions of the same meaning: parameters and bodies of CREATE TEMPORARY FUNCTION.
SQL_FUNCTIONS = {
    "vec_l2": (_PAIR, "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vec_dot": (_PAIR, _DOT.format("a", "b")),
    "vec_cosine": (_PAIR, _COSINE),
    "vec_cosine_distance": (_PAIR, f"1D - {_COSINE}"),
    "vec_adc": ("lut ARRAY<ARRAY<DOUBLE>>, code ARRAY<SMALLINT>", "aggregate(sequence(0, size(code) - 1), 0D, (s, j) -> s + lut[j][code[j]])"),
}


def register(spark) -> None:
    """Make the functions above known to spark.sql; the analyzer inlines them."""
    for name, (takes, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS DOUBLE RETURN {body}")
