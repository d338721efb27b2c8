"""The vector engine against plain Python and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom.functions import distance as D
from vecloom.operators import beam, graph, knn, pq
from vecloom.plans.queries import corpus, held_out
from vecloom.sources import vecs


@pytest.fixture(scope="module")
def points(spark):
    m = np.round(np.random.default_rng(5).normal(size=(120, 10)), 2)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>")


def test_distances_by_hand(spark):
    row = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        D.l2(F.col("a"), F.col("b")), D.dot(F.col("a"), F.col("b")), D.cosine(F.col("a"), F.col("z")), D.replicate(F.col("a"), 2)).first()
    assert row[0] == 25.0 and row[1] == 16.0 and row[2] == 0.0 and row[3] == [1.0, 1.0, 2.0, 2.0]


@pytest.mark.parametrize("metric", knn.METRICS)
def test_exact_knn(points, metric):
    m, df = points
    asked = df.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    got = {(r.qid, r.rk): r.vec_id for r in knn.exact_knn(asked, df, 7, metric, skip_self=True).collect()}
    for q in range(5):
        near = ((m - m[q]) ** 2).sum(1) if metric == "l2" else -(m @ m[q]) if metric == "dot" else -(m @ m[q]) / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q]) + 1e-6)
        want = [i for i in np.lexsort((np.arange(120), np.round(near, 12))) if i != q][:7]
        assert [got[q, r] for r in range(1, 8)] == want


@pytest.mark.parametrize("metric", knn.METRICS)
def test_exact_knn_with_many_copies_of_a_vector(spark, metric):
    m = np.random.default_rng(3).normal(size=(900, 10))
    m[::3] = m[0]
    m[1::9] = m[0] * (1 + 1e-16) + 0.0
    df = spark.createDataFrame([(899 - i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate((m[0], m[2], m[0] * 0.5))], "qid bigint, qv array<double>")
    got = {(r.qid, r.rk): r.vec_id for r in knn.exact_knn(asked, df, 10, metric).collect()}
    for q, v in enumerate((m[0], m[2], m[0] * 0.5)):
        near = ((m - v) ** 2).sum(1) if metric == "l2" else -(m * v).sum(1) if metric == "dot" else 1 - (m * v).sum(1) / (np.sqrt((v * v).sum()) * np.sqrt((m * m).sum(1)) + 1e-6)
        want = sorted(range(900), key=lambda i: (near[i], 899 - i))[:10]
        assert [got[q, r] for r in range(1, 11)] == [899 - i for i in want]


def test_few_rows_and_no_queries(points):
    _, df = points
    asked = df.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    assert knn.exact_knn(asked, df.limit(3), 10).count() == 3
    assert knn.exact_knn(asked.filter("false"), df, 10).count() == 0


def test_quantisation_round_trip(points):
    m, df = points
    model = pq.train(df, 3, 120)
    assert model.offsets == (0, 4, 7, 10)
    codes = {r.vec_id: r.code for r in pq.encode(df, model).collect()}
    back = np.array([np.concatenate([model.pivots[j][c] for j, c in enumerate(codes[i])]) + model.centroid for i in range(120)])
    assert ((back - m) ** 2).sum() < 0.05 * ((m - m.mean(0)) ** 2).sum()


def test_beam_forms_agree_and_reach_all(spark, sf_dir):
    rows, asked = corpus(spark, sf_dir).filter("vec_id < 150"), held_out(spark, sf_dir).filter("qid < 100")
    model, edges = pq.model_from_rows(rows, 16, 16), graph.knn_graph(rows, 8)
    codes, entries = pq.encode(rows, model), asked.select("qid", F.lit(1).cast("bigint").alias("entry"))
    loop = beam.beam_search(pq.lookup_tables(asked, model), entries, beam.search_graph(edges, rows, codes), 12, 5)
    batch = beam.beam_search_batch(asked, model, 1, edges, rows, codes, 12, 5)
    key = lambda df: sorted((r.qid, r.rk, r.vec_id, round(r.dist, 8), r.n_expanded) for r in df.collect())
    assert key(loop) == key(batch)
    scanned = beam.beam_search(pq.lookup_tables(asked.filter("qid < 50"), model), entries, beam.search_graph(edges, rows, codes), 5, 5, small=0)
    assert key(scanned) == key(beam.beam_search_batch(asked.filter("qid < 50"), model, 1, edges, rows, codes, 5, 5))
    wide = beam.beam_search_batch(asked, model, 1, edges, rows, codes, 200, 5)
    if graph.bfs_hops(edges, 1, 30).count() == rows.count():
        assert knn.recall(wide, knn.exact_knn(asked, rows, 5), 5).first().recall == 1.0
    with pytest.raises(ValueError):
        beam.beam_search_batch(asked, model, 1, edges, rows, codes, 3, 5)


def test_cell_graph_bounds_degree(points):
    _, df = points
    edges = graph.cell_graph(df, 6)
    worst = edges.groupBy("src").count().agg(F.max("count")).first()[0]
    assert worst <= 6 and edges.filter("src = dst").count() == 0 and edges.select("src").distinct().count() == 120


@pytest.mark.parametrize("kind", sorted(vecs.FORMATS))
def test_vector_files_round_trip(spark, tmp_path, kind):
    rows = [(0, [0, 127, 128]), (1, [255, 1, 2]), (2, [3, 4, 5])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "pos bigint, vector array<double>").coalesce(1)
    (written,) = vecs.write_vectors(df, str(tmp_path), kind).collect()
    assert written.rows == 3
    assert [(r.pos, list(map(int, r.vector))) for r in vecs.read_vectors(spark, written.file, kind).orderBy("pos").collect()] == rows
    assert [r.pos for r in vecs.read_vectors(spark, written.file, kind, first=1, limit=1).collect()] == [1]
    with open(written.file, "r+b") as f:
        f.truncate(9)
    with pytest.raises(ValueError):
        vecs.shape(written.file, kind)


def test_truth_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [5, 6], [0.5, 1.0]), (0, [3, 4], [0.25, 2.0])], "qid bigint, ids array<int>, dists array<float>")
    (written,) = vecs.write_truth(df, str(tmp_path / "truth.bin")).collect()
    back = [tuple(r) for r in vecs.read_truth(spark, written.file).orderBy("qid").collect()]
    assert written.rows == 2 and back == [(0, [3, 4], [0.25, 2.0]), (1, [5, 6], [0.5, 1.0])]
    assert [p.name for p in tmp_path.iterdir()] == ["truth.bin"]


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e30])
def test_exact_knn_of_copies_compares_each_vector_once(spark, metric, scale, monkeypatch):
    """A third of all rows are copies and some ids come again: what is compared one by one grows with queries, not with pairs of copies."""
    rng = np.random.default_rng(2)
    m = rng.integers(-3, 4, size=(600, 5)) * scale
    m[::3] = m[1]
    ids = np.concatenate((np.arange(590), [0, 0, 3, 3, 3, 9, 9, 9, 9, 9]))
    k, metric_of = 4, knn.refine
    seen, refined = [], lambda kind, q, rows: seen.append(len(q)) or metric_of(kind, q, rows)
    best, who = np.full((600, k), np.inf), np.zeros((600, k), dtype=np.int64)
    monkeypatch.setattr(knn, "refine", refined)
    knn.merge(metric, ids, m, ids, m, best, who, True)
    assert sum(seen) < 600 * 100 or (metric, scale) == ("cosine", 1e-30)  # where all are as good as equally near
    exact = metric_of(metric, m, np.broadcast_to(m, (600, 600, 5)))
    for i in range(600):
        other = ids != ids[i]
        order = np.lexsort((ids[other], exact[i][other]))[:k]
        assert best[i].tolist() == exact[i][other][order].tolist() and who[i].tolist() == ids[other][order].tolist()


def test_scans_of_several_blocks_read_packed_rows(spark, monkeypatch):
    """Rows that are gone over block by block are read as bytes, not number by number; the neighbours stay the same."""
    m = np.random.default_rng(4).normal(size=(90, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>")
    want = {(r.src, r.rk): r.dst for r in graph.knn_graph(rows, 3).collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    near = graph.knn_graph(rows, 3)
    assert {(r.src, r.rk): r.dst for r in near.collect()} == want
    assert "v:binary" in near._jdf.queryExecution().executedPlan().toString()
    wide = rows.unionByName(spark.createDataFrame([(99, [1.0, 2.0])], rows.schema))
    with pytest.raises(Exception, match="widths"):
        knn.exact_knn(rows.selectExpr("vec_id AS qid", "v AS qv"), wide, 3).collect()


def test_many_blocks_are_packed_and_searched_by_many_tasks(spark, monkeypatch):
    """However many blocks of queries there are, no task packs or searches the whole table."""
    m = np.random.default_rng(6).normal(size=(90, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>")
    want = {(r.src, r.rk): r.dst for r in graph.knn_graph(rows, 3).collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    tasks, write = [], knn.cut
    monkeypatch.setattr(knn, "cut", lambda df: tasks.append(df.rdd.getNumPartitions()) or write(df))
    found = knn.nearest_of_tasks(rows.selectExpr("vec_id AS qid", "v AS qv"), rows, 3, skip_self=True)
    assert tasks and min(tasks) == knn.tasks_for(spark) and found.rdd.getNumPartitions() >= 23
    assert {(r.src, r.rk): r.dst for r in graph.knn_graph(rows, 3).collect()} == want


@pytest.mark.parametrize("shape", [(0, 5), (3, 0), (3, 5), (16, 8), (7, 13)])
def test_places_of_true_ones(shape):
    hit = np.random.default_rng(1).random(shape) < 0.3
    assert knn.places(hit).tolist() == np.flatnonzero(hit).tolist()


@pytest.mark.parametrize("kind", ["cosine", "l2", "codes"])
def test_pairs_of_equal_values_leave_together(spark, monkeypatch, kind):
    """Values that come again are neighbours, so that files hold them once; the pairs are the same, whatever is held at a time."""
    m = np.random.default_rng(8).integers(-2, 3, size=(90, 4)).astype(float)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>").coalesce(1)
    asked = rows.filter("vec_id % 3 = 0").selectExpr("vec_id AS qid", "v AS qv")
    model = pq.model_from_rows(rows, 2, 8)
    tables, codes = pq.lookup_tables(asked, model), pq.encode(rows, model)
    pairs = lambda: (pq.adc_distances(tables, codes, (9, 6)) if kind == "codes" else knn.score_all(asked, rows, kind, 6)).collect()
    want = pairs()
    assert len(want) == 2700
    monkeypatch.setattr(knn, "FEW_PAIRS", 1)
    monkeypatch.setattr(knn, "spread", lambda df: df.coalesce(1))
    monkeypatch.setattr(pq, "spread", lambda df: df.coalesce(1))
    got = pairs()
    assert [r.dist for r in got] == sorted(r.dist for r in want) and sorted(map(tuple, got)) == sorted(map(tuple, want))
    monkeypatch.setattr(knn, "SORTED", 700)
    assert sorted(map(tuple, pairs())) == sorted(map(tuple, want))


def test_values_that_have_no_digits_or_come_once_stay_by_row(monkeypatch):
    rng = np.random.default_rng(9)
    for m in (np.round(rng.normal(size=(40, 30)), 6), np.full((40, 30), np.nan), np.full((40, 30), 1e300), np.full((40, 30), 1 / 3)):
        assert knn.by_value(40, 30, 6, lambda rows, asked, m=m: m[rows, asked], 1) is None
    twos = np.round(rng.integers(-3, 4, size=(40, 30)) / 7, 6)
    query, row, got = (np.concatenate(x) for x in zip(*knn.by_value(40, 30, 6, lambda rows, asked: twos[rows, asked], 1)))
    assert (twos[row, query] == got).all() and (np.diff(got) >= 0).all() and len(set(zip(row, query))) == 1200
