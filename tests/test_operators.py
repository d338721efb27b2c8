"""Operators of the vector engine against NumPy: nulls, ties, codes, percentiles, walks, draws, files at offsets."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom import cli
from vecloom.functions import distance as D
from vecloom.index import VectorIndex
from vecloom.operators import beam, graph, knn, pq, zipf
from vecloom.plans import queries as q
from vecloom.sources import datasource, index_files, vecs


def frame(spark, m, name="vec_id", vector="v"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, {vector} array<double>")


@pytest.fixture(scope="module")
def points(spark):
    m = np.round(np.random.default_rng(8).normal(size=(200, 12)), 2)
    return m, frame(spark, m)


def test_null_vectors_take_no_part(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (None, [0.0, 1.0]), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    asked = df.withColumnsRenamed({"vec_id": "qid", "v": "qv"})
    assert sorted((r.qid, r.rk, r.vec_id) for r in knn.exact_knn(asked, df, 5).collect()) == [(0, 1, 0), (0, 2, 6), (6, 1, 6), (6, 2, 0)]
    assert sorted((r.qid, r.vec_id) for r in knn.radius_search(asked, df, 0.5).collect()) == [(0, 0), (6, 6)]
    model = pq.model_from_rows(df.filter("vec_id in (0, 6)"), 2, 2)
    assert sorted(r.vec_id for r in pq.encode(df.filter("vec_id is not null"), model).collect()) == [0, 6]
    assert {r.src for r in graph.cell_graph(df, 2).collect()} == {0, 6}


def test_radius_search_equals_brute_force(points):
    m, df = points
    asked = df.filter("vec_id < 9").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    got = {(r.qid, r.vec_id) for r in knn.radius_search(asked, df, 18.0, skip_self=True).collect()}
    assert got == {(i, j) for i in range(9) for j in range(200) if i != j and ((m[i] - m[j]) ** 2).sum() <= 18.0} and got


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_percentiles_equal_numpy(spark, few):
    x = np.concatenate((np.random.default_rng(1).normal(size=500), [0.25] * 300))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    assert knn.percentiles(df, "x", (0.0, 0.1, 0.5, 0.99, 1.0), few) == pytest.approx(np.quantile(x, (0.0, 0.1, 0.5, 0.99, 1.0)))
    assert knn.percentiles(df.filter("x is null"), "x", (0.5,), few) == [None]


def test_distances_from_codes_equal_numpy(points):
    m, df = points
    model = pq.model_from_rows(df, 5, 7)
    asked = df.filter("vec_id < 6").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    codes = model.encode(m)
    want = {(i, j): sum(((m[i, a:b] - p[codes[j, c]]) ** 2).sum() for c, (a, b, p) in enumerate(zip(model.offsets, model.offsets[1:], model.pivots))) for i in range(6) for j in range(200)}
    tables, coded = pq.lookup_tables(asked, model), pq.encode(df, model)
    assert {(r.qid, r.vec_id): r.dist for r in pq.adc_distances(tables, coded).collect()} == pytest.approx(want)
    near = knn.top_k(pq.adc_distances(tables, coded, nearest=9), 9).collect()
    for i in range(6):
        best = sorted((round(want[i, j], 9), j) for j in range(200))[:9]
        assert [r.vec_id for r in sorted(near, key=lambda r: r.rk) if r.qid == i] == [j for _, j in best]


def test_training_ends_at_means_and_beats_given_pivots(points):
    m, df = points
    model = pq.train(df, 4, 9, rounds=80)
    codes, centred = model.encode(m), m - model.centroid
    for j, (a, b, p) in enumerate(zip(model.offsets, model.offsets[1:], model.pivots)):
        assert all(np.allclose(p[c], centred[codes[:, j] == c, a:b].mean(0)) for c in set(codes[:, j].tolist()))
    off = lambda x: sum(
        (((m - x.centroid)[:, a:b] - p[x.encode(m)[:, j]]) ** 2).sum() for j, (a, b, p) in enumerate(zip(x.offsets, x.offsets[1:], x.pivots)))
    assert off(model) < off(pq.model_from_rows(df, 4, 9))


def test_trained_codes_of_the_query_are_used(spark, sf_dir):
    m = np.array([r.v for r in q.everything(spark, sf_dir).collect()])
    codes = pq.train(q.everything(spark, sf_dir), q.CHUNKS, q.PIVOTS).encode(m)
    assert {r.chunk: r.used for r in q.QUERIES["pq_train"](spark, sf_dir).collect()} == {j: len(set(codes[:, j].tolist())) for j in range(q.CHUNKS)}


def test_codes_with_ties_keep_the_smallest_ids(spark):
    m = np.zeros((3000, 4))
    m[::2] = 1.0
    df = frame(spark, m).repartition(2)
    model = pq.model_from_rows(df, 2, 2)
    asked = df.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    near = knn.top_k(pq.adc_distances(pq.lookup_tables(asked, model), pq.encode(df, model), nearest=4), 4)
    assert [r.vec_id for r in near.orderBy("rk").collect()] == [0, 2, 4, 6]


def search(query, m, links, entry, ef, k, guide):
    """Best-first search by hand, with a heap of what may be expanded."""
    expanded, open_, beam_, at = [], [], {}, entry
    seen = set()
    while at is not None:
        expanded.append(at)
        seen.add(at)
        for n in links.get(at, ()):
            if n not in seen and n not in beam_:
                beam_[n] = guide(n)
        beam_ = dict(heapq.nsmallest(ef, beam_.items(), key=lambda x: (x[1], x[0])))
        open_ = [(d, n) for n, d in beam_.items() if n not in seen]
        at = min(open_)[1] if open_ else None
    return sorted((round(float(((query - m[n]) ** 2).sum()), 9), n) for n in expanded)[:k], len(expanded)


def tables_of(spark, sf_dir):
    held = q.corpus(spark, sf_dir).collect()
    m = {r.vec_id: np.array(r.v) for r in held}
    links = {}
    for r in q.edges(spark, sf_dir, q.corpus).orderBy("src", "rk").collect():
        links.setdefault(r.src, []).append(r.dst)
    return m, links, {r.qid: np.array(r.qv) for r in q.held_out(spark, sf_dir).collect()}


def test_beam_queries_equal_a_search_by_hand(spark, sf_dir):
    m, links, asked = tables_of(spark, sf_dir)
    model = q.model(spark, sf_dir, q.corpus)
    codes = dict(zip(m, model.encode(np.array(list(m.values())))))
    want, spent = {}, {}
    for qid, v in asked.items():
        table = model.table(v)
        found, spent[qid] = search(v, m, links, q.ENTRY, q.EF, q.K, lambda n: round(float(sum(t[c] for t, c in zip(table, codes[n]))), 9))
        want |= {(qid, i): (n, spent[qid]) for i, (_, n) in enumerate(found, 1)}
    for name in ("beam_search", "beam_search_batch"):
        assert {(r.qid, r.rk): (r.vec_id, r.n_expanded) for r in q.QUERIES[name](spark, sf_dir).collect()} == want
    assert tuple(q.QUERIES["search_stats"](spark, sf_dir).first()) == (sum(spent.values()), max(spent.values()), len(asked))
    ids = np.array(list(m))
    truth = {qid: set(ids[np.lexsort((ids, ((np.array(list(m.values())) - v) ** 2).sum(1)))][: q.K].tolist()) for qid, v in asked.items()}
    hits = sum(n in truth[qid] for (qid, _), (n, _) in want.items())
    assert q.QUERIES["beam_recall"](spark, sf_dir).first().recall == pytest.approx(hits / (len(asked) * q.K), abs=1e-6)


def test_index_search_equals_a_search_by_hand(spark, sf_dir, tmp_path):
    index = VectorIndex.build(q.corpus(spark, sf_dir), q.DEGREE, nav=q.NAV).save(str(tmp_path / "index"))
    m, _, asked = tables_of(spark, sf_dir)
    links = {}
    for r in index.edges.orderBy("src", "dst").collect():
        links.setdefault(r.src, []).append(r.dst)
    nav = [r.vec_id for r in index.nav.orderBy("nav_id").collect()]
    got = {(r.qid, r.rk): (r.vec_id, r.n_expanded) for r in index.search(q.held_out(spark, sf_dir), q.K, q.EF).collect()}
    want = {}
    for qid, v in asked.items():
        entry = min((round(float(((v - m[n]) ** 2).sum()), 9), i, n) for i, n in enumerate(nav))[2]
        found, spent = search(v, m, links, entry, q.EF, q.K, lambda n: round(float(((v - m[n]) ** 2).sum()), 9))
        want |= {(qid, i): (n, spent) for i, (_, n) in enumerate(found, 1)}
    assert got == want


def test_pruned_graph_equals_pruning_by_hand(spark, points):
    """One cell: every node keeps near neighbours that no kept one makes redundant, then reverse edges join."""
    m, df = points
    near = ((m[:, None] - m[None]) ** 2).sum(2)
    kept = {}
    for i in range(200):
        order = [j for j in sorted(range(200), key=lambda j: (near[i, j], j)) if j != i][: 4 * 5]
        mine = []
        for j in order:
            if len(mine) < 5 and all(1.2 * near[j, c] > near[i, j] for c in mine):
                mine.append(j)
        kept |= {(i, j): r for r, j in enumerate(mine, 1)}
    both = {}
    for (i, j), r in kept.items():
        both[i, j], both[j, i] = min(r, both.get((i, j), r)), min(r, both.get((j, i), r))
    want = {(i, j) for i in range(200) for j in [j for _, j in sorted((r, j) for (a, j), r in both.items() if a == i)][:5]}
    assert {(r.src, r.dst) for r in graph.cell_graph(df, 5).collect()} == want


def test_large_cells_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_ROWS", 60)
    monkeypatch.setattr(graph, "SLICES", 16)
    m = np.random.default_rng(2).normal(size=(900, 6))
    df = frame(spark, m)
    sizes = []
    plain = graph.prune
    monkeypatch.setattr(graph, "prune", lambda ids, *a: plain(ids, *a))
    edges = graph.cell_graph(df, 8).cache()
    links = {}
    for r in edges.collect():
        links.setdefault(r.src, set()).add(r.dst)
    near = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    hits = np.mean([int(near[i].argmin()) in links[i] for i in range(900)])
    assert len(links) == 900 and hits > 0.5, (hits, sizes)


def test_nav_walk_equals_a_walk_by_hand(spark, sf_dir):
    rows, links = q._nav_tables(spark, sf_dir)
    m = {r.vec_id: np.array(r.v) for r in rows.collect()}
    near = {}
    for r in links.orderBy("src", "rk").collect():
        near.setdefault(r.src, []).append(r.dst)
    for r in q.QUERIES["nav_walk"](spark, sf_dir).join(q.held_out(spark, sf_dir), "qid").collect():
        v = np.array(r.qv)
        found, _ = search(v, m, near, 0, 4, 1, lambda n: round(float(((v - m[n]) ** 2).sum()), 9))
        assert (r.nav_id, r.dist) == (found[0][1], pytest.approx(found[0][0], abs=1e-6))


def test_draws_follow_the_law(spark):
    rows = zipf.draw(spark.range(20_000).withColumnRenamed("id", "k").withColumn("item", F.lit(7)).drop("item"), "k", 50, 1.2)
    got = {r["item"]: r["count"] / 20_000 for r in rows.groupBy("item").count().collect()}
    total = sum(i**-1.2 for i in range(1, 51))
    assert all(abs(got.get(i, 0) - i**-1.2 / total) < 0.01 for i in range(1, 51)) and set(got) <= set(range(1, 51))
    assert zipf.draw(spark.createDataFrame([(None,)], "k bigint"), "k", 5, 1.0).first()["item"] is None
    with pytest.raises(ValueError):
        zipf.draw(rows, "k", 0, 1.0)


def test_sql_functions_equal_the_columns(spark):
    D.register(spark)
    row = spark.sql("SELECT vec_l2(a, b) l2, vec_dot(a, b) dot, vec_cosine(a, b) cosine, vec_cosine_distance(a, b) far, vec_adc(array(a, b), cast(array(0, 1) AS array<smallint>)) adc FROM VALUES (array(1D, 2D), array(3D, 5D)) t(a, b)").first()
    by_hand = 13 / (5**0.5 * 34**0.5 + 1e-6)
    assert (row.l2, row.dot, row.adc) == (13.0, 13.0, 6.0) and row.cosine == pytest.approx(by_hand) and row.far == pytest.approx(1 - by_hand)


def test_blocks_at_offsets(tmp_path):
    path, a, b = str(tmp_path / "tables.bin"), np.arange(6, dtype="f4").reshape(2, 3), np.arange(4, dtype="i4").reshape(4, 1)
    end = vecs.write_block(path, a, "fbin", 16)
    assert vecs.write_block(path, b, "ibin", end) == end + 8 + 16
    assert vecs.write_block(path, a + 1, "fbin", 16) == end
    assert (index_files._table(path, "fbin", 16) == a + 1).all() and (index_files._table(path, "ibin", end) == b).all()
    with pytest.raises(ValueError):
        vecs.write_block(path, a, "fvecs", 0)


def test_vector_source(spark, tmp_path):
    datasource.register(spark)
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(50)], "pos bigint, vector array<double>").coalesce(1)
    (written,) = vecs.write_vectors(df, str(tmp_path), "fvecs").collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("vecs").load(written.file)
    assert rows.count() == 50 and [r.vector for r in rows.filter("pos = 7").collect()] == [[7.0, 0.5]]
    assert [r.pos for r in rows.filter("pos >= 10 and pos < 13").orderBy("pos").collect()] == [10, 11, 12]
    assert spark.read.format("vecs").option("kind", "fvecs").option("first", 48).load(written.file).count() == 2
    (typed,) = vecs.write_vectors(df, str(tmp_path / "typed"), "bbin").collect()
    assert spark.read.format("vecbin").option("dtype", "uint8").load(typed.file).filter("pos = 9").first().vector == [9, 0]
    reader = datasource.VectorReader(written.file, "fvecs", 0, 0, None)
    list(reader.pushFilters([datasource.api.GreaterThan(("pos",), 3), datasource.api.LessThanOrEqual(("pos",), 9), datasource.api.EqualTo(("other",), 1)]))
    assert (reader.first, reader.end) == (4, 10)


def test_widened_files_search_alike(spark, tmp_path, points):
    m, df = points
    folder = str(tmp_path)
    index = VectorIndex.build(df, 8, 4, 16)
    index.to_files(f"{folder}/index", 8)
    index_files.write_pq_model(index.model, f"{folder}/pq_pivots.bin")
    wide = cli.main(["widen", "--index", f"{folder}/index", "--out", f"{folder}/wide", "--times", "3", "--pq_data", f"{folder}/pq"], spark)
    assert wide == [f"{folder}/wide", f"{folder}/wide_pivots.bin"]
    model = index_files.read_pq_model(wide[1])
    before = index_files.read_pq_model(f"{folder}/pq_pivots.bin")
    assert model.offsets == tuple(3 * x for x in before.offsets)
    assert (model.encode(np.repeat(m, 3, axis=1)) == before.encode(m)).all()
    node = index_files.read_nodes(spark.createDataFrame([(5,), (5,), (150,), (None,)], "node bigint"), wide[0]).collect()
    assert sorted(r.node for r in node) == [5, 5, 150] and all(r.vector == pytest.approx(np.repeat(m[r.node], 3), abs=1e-6) for r in node)


def test_tags_and_replicated_queries(spark, tmp_path):
    nav = spark.createDataFrame([(1, 40), (0, 30)], "nav_id bigint, vec_id bigint")
    index_files.write_map(nav, str(tmp_path / "map.txt"))
    tags = cli.main(["tags", "--map", str(tmp_path / "map.txt"), "--out", str(tmp_path / "tags")], spark)
    assert [r.vector for r in vecs.read_vectors(spark, tags, "ibin").orderBy("pos").collect()] == [[30], [40]]
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "pos bigint, vector array<double>").coalesce(1)
    (written,) = vecs.write_vectors(df, str(tmp_path / "q"), "fbin").collect()
    (many,) = cli.main(["replicate_set", "--query", written.file, "--out", str(tmp_path / "many"), "--times", "2"], spark)
    assert [r.vector[0] for r in vecs.read_vectors(spark, many, "fbin").orderBy("pos").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0] * 2


def test_sweep_counts_batches(spark, tmp_path, points):
    _, df = points
    VectorIndex.build(df, 8).save(str(tmp_path / "index"))
    asked = df.filter("vec_id < 6").select(F.col("vec_id").alias("pos"), F.col("v").alias("vector")).coalesce(1)
    (written,) = vecs.write_vectors(asked, str(tmp_path / "q"), "fbin").collect()
    ((ef, took, _, share, mean, spent),) = cli.main(["search", "--index", str(tmp_path / "index"), "--query", written.file, "--topk", "3", "--ef_search", "10", "-R", "1", "-B", "2"], spark)
    assert (ef, share) == (10, None) and mean == pytest.approx(took / 3) and spent >= 10


def test_shards_by_nearness_are_searched_in_part(spark, tmp_path):
    rng = np.random.default_rng(12)
    m = rng.normal(size=(400, 6)) + 6 * rng.integers(0, 3, size=(400, 1))
    df = frame(spark, m)
    index = VectorIndex.build(df, 8, shards=4, near=True).save(str(tmp_path / "index"))
    shard = {r.vec_id: r.shard for r in index.shard_of.collect()}
    assert len(shard) == 400 and all(shard[r.src] == shard[r.dst] for r in index.edges.collect())
    centre = {r.shard: np.array(r.v) for r in index.centres.collect()}
    assert all(shard[i] == min(centre, key=lambda s: (((m[i] - centre[s]) ** 2).sum(), s)) for i in range(400))
    asked = df.filter("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    truth = index.search(asked, 5, 5, "exact")
    whole, part = index.search(asked, 5, 60), index.search(asked, 5, 60, probes=1)
    assert knn.recall(whole, truth, 5).first().recall >= 0.99
    assert all(shard[r.vec_id] == shard[r.qid] for r in part.collect()) and knn.recall(part, truth, 5).first().recall >= 0.5
    spent = lambda df: df.select("qid", "n_expanded").distinct().agg(F.sum("n_expanded")).first()[0]
    assert spent(part) < spent(whole) / 2
    assert sorted(tuple(r) for r in index.search(asked, 5, 60, probes=9).collect()) == sorted(tuple(r) for r in whole.collect())


def test_navigation_files_are_walked_and_widened(spark, tmp_path, points):
    m, df = points
    folder = str(tmp_path)
    index = VectorIndex.build(df, 8, nav=30)
    index.to_files(f"{folder}/index", 8)
    nav = index.nav.cache()
    rows = nav.join(df, "vec_id").select(F.col("nav_id").alias("vec_id"), "v").cache()
    links = graph.knn_graph(rows, 5)
    index_files.write_nav_graph(graph.adjacency(links).withColumnRenamed("node", "nav_id"), f"{folder}/nav/nav_index")
    index_files.write_map(nav, f"{folder}/nav/map.txt")
    (data,) = vecs.write_vectors(rows.select("vec_id", "v").coalesce(1), f"{folder}/data", "fbin", "vec_id", "v").collect()
    (tmp_path / "nav" / "nav_index.data").write_bytes(open(data.file, "rb").read())
    asked = df.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    walked = VectorIndex.from_files(spark, f"{folder}/index", nav_prefix=f"{folder}/nav", walk=True)
    near = {}
    for r in links.orderBy("src", "rk").collect():
        near.setdefault(r.src, []).append(r.dst)
    of = {r.nav_id: r.vec_id for r in nav.collect()}
    held = {n: m[i].astype("f4").astype(float) for n, i in of.items()}
    want = {}
    for q_ in range(5):
        found, _ = search(m[q_], held, near, 0, 4, 1, lambda n: round(float(((m[q_] - held[n]) ** 2).sum()), 9))
        want[q_] = of[found[0][1]]
    assert {r.qid: r.entry for r in walked.entries(asked).collect()} == want
    assert walked.search(asked, 3, 20).count() == 15
    names = cli.main(["widen", "--index", f"{folder}/index", "--out", f"{folder}/wide", "--times", "2", "--nav_graph", f"{folder}/nav"], spark)
    wide = {r.pos: r.vector for r in vecs.read_vectors(spark, names[-1], "fbin").collect()}
    assert all(wide[n] == pytest.approx(np.repeat(m[i], 2), abs=1e-6) for n, i in of.items())
