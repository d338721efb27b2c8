"""Whitening against one eigendecomposition of the whole covariance, and on odd tables."""

import numpy as np
import pyarrow.dataset as ds
import pytest
from vecloom.llm import queries as q
from vecloom.llm import whitening


def plain(vectors, most=8):
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    apart = x - sums / n
    values, units = np.linalg.eigh(apart.T @ apart / n)
    values, units = values[::-1], units[:, ::-1].T
    return n, deviation, apart @ units[:most].T / np.sqrt(values[:most]), values[:most] / values.sum()


def test_op12_equals_one_eigendecomposition(spark, sf_dir):
    rows = ds.dataset(f"{sf_dir}/embeddings.parquet").to_table().to_pylist()
    n, deviation, z, explained = plain([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = q.op12_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * n and len({(r.vec_id, r.component) for r in got}) == 8 * n
    signs = {}
    for r in got:
        i, j = place[r.vec_id], r.component - 1
        sign = signs.setdefault(j, np.sign(r.whitened * z[i, j]))
        assert abs(r.whitened * sign - z[i, j]) < 1e-8 and r.n == n and r.deviation == deviation[i]
        assert abs(r.explained - explained[j]) < 1e-10 and r.identity_error < 1e-9


def test_merging_loses_nothing_in_any_order_or_size():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 100).astype(np.int64) + 10**6
    whole = whitening.Summary.of(x)
    for cuts in ([1, 2, 3, 150], [299], [50, 100, 150, 200, 250], list(range(1, 300))):
        parts = [whitening.Summary.of(p) for p in np.split(x, cuts)]
        while len(parts) > 1:
            parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        assert parts[0].n == 300 and parts[0].sums == whole.sums
        np.testing.assert_allclose(parts[0].axes.T @ parts[0].axes, whole.axes.T @ whole.axes, rtol=1e-9, atol=1e-6)


def test_odd_rows_take_no_part_and_others_keep_their_columns(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0])]
    rows = [*good, good[0], (None, good[1][1]), *bad, (200, [1.0, 2.0]), (201, [2.0, 5.0]), (202, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, n int, id string, z double").repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, z, _ = plain([v for i, v in rows if v and len(v) == 3 and i not in (102, 103, 104)])
    wide = [r for r in got if r.n == n]
    assert n == 42 and len(wide) == 3 * 42 and sum(r.id is None for r in wide) == 3 and sum(r.id == 0 for r in wide) == 6
    assert sorted(r.deviation for r in wide if r.component == 1) == sorted(deviation)
    np.testing.assert_allclose(sorted(abs(r.whitened) for r in wide), np.sort(np.abs(z).ravel()), atol=1e-9)
    assert {r.id for r in got if r.n == 3} == {200, 201, 202}
    assert len(got) == 3 * 42 + 2 * 3


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[1.0, 2.0]] * 3, [[1.0, 5.0], [2.0, 5.0]]])
def test_components_without_variance_are_null(spark, rows):
    got = whitening.whiten(spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")).collect()
    live = 1 if rows[0] != rows[-1] else 0
    assert len(got) == 2 * len(rows) and {r.component for r in got if r.whitened is not None} == set(range(1, live + 1))
    assert all(r.identity_error < 1e-9 and r.explained == (1.0 if r.component <= live else 0.0) for r in got)


def test_huge_entries_stay_exact(spark):
    rows = [(0, [1e14, 1.0]), (1, [-1e14, 3.0])]
    got = {r.id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for _, v in rows]
    assert got == {i: sum((2 * x[i][j] - x[0][j] - x[1][j]) ** 2 for j in (0, 1)) for i in (0, 1)}


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_deviation_beyond_38_digits_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(0, [1e38]), (1, [-3e38]), (2, [2e38])], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 3 and all(r.deviation is None and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in got)
