"""Pairs of all queries with all rows, in blocks."""

import random

import numpy as np
import pytest

import __spark_entry__
from pyspark.sql import functions as F

from vecloom.functions import distance as D
from vecloom.operators import knn

COLUMNS = {"l2": D.l2, "dot": D.dot, "cosine": D.cosine, "cosine_distance": D.cosine_distance}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors among which are null ones, some with nulls or non-finite entries, of other widths, huge ones and zeros."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None] * 3), (42, [float("nan")] + [1.0] * 5), (43, [float("inf")] * 6), (44, [1.0, 2.0]), (45, []), (46, [0.0] * 6), (47, [1e200] * 6)]
    rows += [(48, [0.5, 0.0009765625, 0.0, 0.0, 0.0, 0.0]), (49, [0.0000005, 0.0000015, 0.0, 0.0, 0.0, 1.0]), (50, [-1e-9] * 6), (None, [1.0] * 6)]
    return spark.createDataFrame(rows, "vec_id bigint, v array<double>").repartition(3)


@pytest.mark.parametrize("kind", COLUMNS)
@pytest.mark.parametrize("digits", [None, 6])
def test_pairs_equal_the_columns(odd, kind, digits):
    asked = odd.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    value = COLUMNS[kind](F.col("qv"), F.col("v"))
    want = asked.crossJoin(odd).select("qid", "vec_id", (value if digits is None else F.round(value, digits)).alias("dist")).collect()
    got = knn.score_all(asked, odd, kind, digits).collect()
    key = lambda r: (r.qid is None, r.qid or 0, r.vec_id is None, r.vec_id or 0)
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert (a.dist is None) == (b.dist is None), (a, b)
        if a.dist is not None:
            assert a.dist == pytest.approx(b.dist, rel=1e-12, abs=1e-12 if digits is None else 0, nan_ok=True), (a, b)


@pytest.mark.parametrize("name", ["cosine_distance", "cosine_similarity", "l2_distance", "inner_product"])
def test_pairs_are_not_joined(spark, sf_dir, name):
    """The join computes pairs one by one, in as few tasks as the table has files."""
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df)
    tasks = knn.SPREAD * spark.sparkContext.defaultParallelism
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and df.rdd.getNumPartitions() % tasks == 0


def test_lateral_search_sorts_no_pairs(spark, sf_dir):
    """What the lateral subquery ranks was cut to each task's nearest before."""
    df = __spark_entry__.queries()["exact_knn_lateral"](spark, sf_dir)
    assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df) and "MapInArrow" in plan_of(df)
    want = __spark_entry__.queries()["exact_knn"](spark, sf_dir).drop("rk")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_edges_take_codes_not_pairs(spark, sf_dir):
    """No join has rows for all pairs of queries and vectors: distances are made last, where nothing follows."""
    df = __spark_entry__.queries()["adc_neighbors"](spark, sf_dir)
    plan = plan_of(df)
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]
    near = __spark_entry__.queries()["pq_adc"](spark, sf_dir).filter("qid < 100")
    links = __spark_entry__.queries()["knn_graph"](spark, sf_dir)
    want = links.join(near, F.col("dst") == F.col("vec_id")).select("qid", "src", "dst", "dist")
    assert sorted(map(tuple, df.filter("qid < 100").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("few", [5, 1_000_000])
def test_percentiles_of_distances_keep_no_pairs(spark, monkeypatch, few):
    """Grid points, so that many distances are equal and lie on edges of bins."""
    m = np.random.default_rng(4).integers(0, 4, size=(90, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(90, None)], "vec_id bigint, v array<double>")
    asked = rows.filter("vec_id < 40 or v is null").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    monkeypatch.setattr(knn, "BINS", 16)
    want = np.quantile(((m[:40, None] - m[None]) ** 2).sum(axis=2), [0.0, 0.5, 0.9, 0.99, 1.0])
    assert knn.distance_percentiles(asked, rows, (0.0, 0.5, 0.9, 0.99, 1.0), few) == pytest.approx(want)
