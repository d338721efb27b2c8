"""Graphs built by search, searches over shards and bucketed tables, traces, walks from any node: against plain NumPy and SQL-free Python."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from vecloom.index import VectorIndex
from vecloom.operators import beam, graph, knn, pq, vamana
from vecloom.plans import queries as q
from vecloom.plans.scratch import bucketed
from vecloom.sources import index_files


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>").repartition(3)


def plain_prune(m, p, candidates, degree, alpha):
    kept = []
    for c in sorted(candidates, key=lambda c: (((m[c] - m[p]) ** 2).sum(), c)):
        if len(kept) < degree and all(alpha * ((m[c] - m[k]) ** 2).sum() > ((m[c] - m[p]) ** 2).sum() for k in kept):
            kept.append(c)
    return kept


def plain_search(m, nbrs, entry, query, width):
    """The nodes that a search expands."""
    near = lambda n: (round(float(((m[n] - query) ** 2).sum()), 9), n)
    at, seen, held = entry, [entry], []
    while at is not None:
        held = sorted({near(n) for n in nbrs[at] if n not in seen}.union(held))[:width]
        at = next((n for _, n in held if n not in seen), None)
        if at is not None:
            seen.append(at)
    return seen


def plain_build(m, degree, width, alpha, seed=7):
    entry = int(np.argmin(((m - m.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(len(m)).tolist()
    order = [entry] + [p for p in order if p != entry]
    nbrs, slack = {p: [] for p in range(len(m))}, int(vamana.SLACK * degree)
    batches, at, size = [], 1, 1
    while at < len(order):
        batches.append((order[at : at + size], 1.0))
        at, size = at + size, min(2 * size, vamana.BATCH)
    size = max(1, min(vamana.BATCH, len(order) // vamana.SHARE))
    batches += [(order[at : at + size], alpha) for at in range(0, len(order), size)]
    for batch, a in batches:
        found = {p: (set(plain_search(m, nbrs, entry, m[p], width)) | set(nbrs[p])) - {p} for p in batch}
        for p in batch:
            nbrs[p] = plain_prune(m, p, found[p], degree, a)
        back = {}
        for p in batch:
            for n in nbrs[p]:
                back.setdefault(n, set()).add(p)
        for n, new in back.items():
            nbrs[n] = nbrs[n] + sorted(new - set(nbrs[n]))
            if len(nbrs[n]) > slack:
                nbrs[n] = plain_prune(m, n, nbrs[n], degree, a)
    return {p: set(n if len(n) <= degree else plain_prune(m, p, n, degree, alpha)) for p, n in nbrs.items()}, entry


def reached(edges, entry):
    links, seen, todo = {}, {entry}, [entry]
    for src, dst in edges:
        links.setdefault(src, []).append(dst)
    while todo:
        for n in links.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_vamana_equals_a_plain_build(spark):
    for seed in range(5, 15):  # one for which nothing has to be joined up
        m = np.random.default_rng(seed).normal(size=(130, 6))
        want, entry = plain_build(m, 6, 14, 1.2)
        plain = {(a, b) for a, near in want.items() for b in near}
        if len(reached(plain, entry)) == 130:
            break
    got = {p: set() for p in range(130)}
    rows = vamana.vamana_graph(frame(spark, m, 1000), 6, 14).collect()
    for r in rows:
        got[r.src - 1000].add(r.dst - 1000)
    assert len(reached(plain, entry)) == 130 and got == want
    for r in rows:
        assert r.rk == 1 + sum(((m[o.dst - 1000] - m[r.src - 1000]) ** 2).sum() < ((m[r.dst - 1000] - m[r.src - 1000]) ** 2).sum() for o in rows if o.src == r.src)


@pytest.mark.parametrize("rows", ["apart", "copies", "few"])
def test_every_node_is_reached(spark, rows):
    rng = np.random.default_rng(6)
    m = {"apart": np.concatenate([rng.normal(size=(40, 4)) + 1000 * i for i in range(6)]), "copies": np.concatenate((np.ones((90, 4)), rng.normal(size=(60, 4)))), "few": rng.normal(size=(2, 4))}[rows]
    df = frame(spark, m)
    edges = [(r.src, r.dst) for r in vamana.vamana_graph(df, 5, 10).collect()]
    assert reached(edges, graph.medoid(df).first().vec_id) == set(range(len(m)))
    assert max(np.bincount([s for s, _ in edges])) <= 5 and len(set(edges)) == len(edges) and all(a != b for a, b in edges)


def test_cells_are_put_together_and_joined_up(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_ROWS", 60)
    monkeypatch.setattr(vamana, "MERGE_NODES", 50)
    rng = np.random.default_rng(8)
    m = np.concatenate([rng.normal(size=(100, 5)) + 50 * i for i in range(4)])
    df = frame(spark, m)
    edges = [(r.src, r.dst) for r in vamana.vamana_graph(df, 6, 12).collect()]
    assert reached(edges, graph.medoid(df).first().vec_id) == set(range(400))
    assert max(np.bincount([s for s, _ in edges])) <= 6 and len(set(edges)) == len(edges)
    near = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert np.mean([(i, int(near[i].argmin())) in set(edges) for i in range(400)]) > 0.7


def test_no_vectors_and_one(spark):
    empty = spark.createDataFrame([], "vec_id bigint, v array<double>")
    assert vamana.vamana_graph(empty, 4).collect() == []
    assert vamana.vamana_graph(frame(spark, np.ones((1, 3))), 4).collect() == []


def test_recall_of_the_graph_built_by_search(spark, sf_dir):
    assert q.QUERIES["vamana_recall"](spark, sf_dir).first().recall >= 0.9
    got = q.QUERIES["vamana_reach"](spark, sf_dir).first()
    assert got.nodes == got.reached > 0


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    rows, asked = q.corpus(spark, sf_dir).filter("vec_id < 150").cache(), q.held_out(spark, sf_dir).filter("qid < 150").cache()
    return rows, asked, graph.knn_graph(rows, 8).cache(), asked.select("qid", F.lit(1).cast("bigint").alias("entry"))


def key(df):
    return sorted((r.qid, r.rk, r.vec_id, round(r.dist, 8), r.n_expanded) for r in df.collect())


@pytest.mark.parametrize("coded", [True, False])
def test_exchange_gives_the_rows_of_one_graph(spark, small, coded):
    rows, asked, edges, entries = small
    model = pq.model_from_rows(rows, 16, 16) if coded else None
    codes = pq.encode(rows, model) if coded else None
    whole, found = beam.search_graph(edges, rows, codes), None
    tables = pq.lookup_tables(asked, model) if coded else asked.withColumn("lut", F.expr("cast(null as array<array<double>>)"))
    want, trace = key(beam.beam_search(tables, entries, whole, 12, 5)), sorted(map(tuple, beam.beam_search(tables, entries, whole, 12, 5, trace=True).collect()))
    for shards in (1, 3, 7):
        found = beam.exchange_search(asked, model, entries, whole, 12, 5, shards)
        assert key(found) == want
    near = graph.centre_shards(rows, 4)[0]
    assert key(beam.exchange_search(asked, model, entries, whole, 12, 5, shard_of=near)) == want
    assert sorted(map(tuple, beam.exchange_search(asked, model, entries, whole, 12, 5, 3, trace=True).collect())) == trace
    batch = beam.beam_search_batch(asked, model, 1, edges, rows, codes, 12, 5, 1, trace=True).select("qid", "round", "node")
    assert sorted(map(tuple, batch.collect())) == trace
    assert {(t[0], t[2]) for t in trace if t[1] == 0} == {(r.qid, 1) for r in asked.collect()}


@pytest.mark.parametrize("coded", [True, False])
def test_one_graph_is_searched_whole_at_any_size(spark, small, monkeypatch, coded):
    """Where tasks hold less than the graph, the batch form still gives the rows of one graph: no edge is left out."""
    rows, asked, edges, entries = small
    model = pq.model_from_rows(rows, 16, 16) if coded else None
    codes = pq.encode(rows, model) if coded else None
    whole = beam.search_graph(edges, rows, codes)
    tables = pq.lookup_tables(asked, model) if coded else asked.withColumn("lut", F.expr("cast(null as array<array<double>>)"))
    least, far = rows.agg(F.min("vec_id")).first()[0], asked.select("qid", F.when(F.col("qid") == 25, 10**9).otherwise(1).cast("bigint").alias("entry"))
    monkeypatch.setattr(beam, "SHARD_ROWS", 40)
    monkeypatch.setattr(beam.shard_count, "__defaults__", (40,))
    assert beam.shard_count(rows) == 4
    want = key(beam.beam_search(tables, entries, whole, 12, 5))
    assert key(beam.beam_search_batch(asked, model, 1, edges, rows, codes, 12, 5)) == want
    trace = beam.beam_search_batch(asked, model, 1, edges, rows, codes, 12, 5, trace=True).select("qid", "round", "node")
    assert sorted(map(tuple, trace.collect())) == sorted(map(tuple, beam.beam_search(tables, entries, whole, 12, 5, trace=True).collect()))
    elsewhere = entries.withColumn("entry", F.when(F.col("qid") == 25, least).otherwise(F.col("entry")))
    assert key(beam.beam_search_batch(asked, model, far, edges, rows, codes, 12, 5)) == key(beam.beam_search(tables, elsewhere, whole, 12, 5))
    assert key(beam.beam_search_batch(asked, model, None, edges, rows, codes, 12, 5)) == key(beam.beam_search(tables, entries.withColumn("entry", F.lit(least)), whole, 12, 5))


def test_blocks_of_queries_share_one_table_of_shards(spark, monkeypatch):
    """The graph of several shards is put together once, and what the shards hold is joined once, however many blocks of queries there are."""
    monkeypatch.setattr(graph, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    df = frame(spark, np.random.default_rng(13).normal(size=(120, 4)))
    index, plans, write = VectorIndex.build(df, 6, shards=3), [], beam.cut
    plan_of = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan_of(index.edges)
    monkeypatch.setattr(beam, "cut", lambda rows: plans.append(plan_of(rows)) or write(rows))
    asked = df.filter("vec_id < 15").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    found = index.search(asked, 3, 60)
    assert plans[-1].count("FlatMapGroupsInArrow") == 3 and "Join" not in plans[-1]
    assert knn.recall(found, knn.exact_knn(asked, df, 3), 3).first().recall == 1.0


def test_entries_that_are_not_there_end_a_search(spark, small):
    rows, asked, edges, _ = small
    entries = asked.select("qid", F.when(F.col("qid") == 25, 10**9).otherwise(1).cast("bigint").alias("entry"))
    whole = beam.search_graph(edges, rows)
    tables = asked.withColumn("lut", F.expr("cast(null as array<array<double>>)"))
    want = key(beam.beam_search(tables, entries, whole, 8, 5))
    assert key(beam.exchange_search(asked, None, entries, whole, 8, 5, 3)) == want and 25 not in {r[0] for r in want}


def test_rounds_over_a_bucketed_graph_do_not_shuffle_it(spark, small):
    rows, asked, edges, entries = small
    tables = asked.withColumn("lut", F.expr("cast(null as array<array<double>>)"))
    whole = beam.search_graph(edges, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = bucketed(whole, "node", 3)
        state = bucketed(beam.start_state(tables, entries), "qid", 2)
        after = beam.beam_round(state, nodes, 8, 5, apart=True)
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2 and "SortMergeJoin" not in plan  # the frontier, and what it found
        assert plan.count("Bucketed: true") >= 2
        exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert all("at" in line for line in exchanged)
        assert key(beam.beam_search(tables, entries, whole, 8, 5, small=0)) == key(beam.beam_search(tables, entries, whole, 8, 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_hops(links, entry, most):
    hops, at = {entry: 0}, [entry]
    for hop in range(1, most + 1):
        at = sorted({d for s, d in links if s in set(at)} - set(hops))
        hops.update(dict.fromkeys(at, hop))
    return hops


def test_hops_over_bucketed_edges_do_not_shuffle_them(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOP_TABLES", 4)
    rng = np.random.default_rng(3)
    links = [(int(s), int(d)) for s, d in rng.integers(0, 60, (150, 2))] + [(5, 7), (5, 7)] + [(100 + i, 101 + i) for i in range(6)] + [(0, 100), (200, 201)]
    edges = spark.createDataFrame(links, "src bigint, dst bigint").repartition(3)
    for most, small in ((2, 10**6), (2, 0), (1 << 30, 0)):
        want = plain_hops(links, 0, min(most, 60))
        assert {r["node"]: r["hop"] for r in graph.bfs_hops(edges, 0, most, small).collect()} == want and max(want.values()) >= min(most, 6)
    assert graph.bfs_hops(edges.limit(0), 4).collect() == [(4, 0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = graph.hop_from(spark.range(3).withColumnRenamed("id", "node"), bucketed(edges, "src", 3), apart=True)
        plan = step._jdf.queryExecution().executedPlan().toString()
        exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert "Bucketed: true" in plan and len(exchanged) == 2 and not any("src" in line for line in exchanged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows, asked", [([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], [(5, [1.0, 2.0, 3.0])]), ([(1, [1.0, 2.0])], [(5, [1.0])]), ([(1, [1.0])], [(5, [1.0]), (6, [1.0, 2.0])])])
def test_exact_search_of_several_widths_says_so(spark, rows, asked):
    corpus = spark.createDataFrame(rows, "vec_id bigint, v array<double>").coalesce(1)
    queries = spark.createDataFrame(asked, "qid bigint, qv array<double>")
    with pytest.raises(Exception, match="width"):
        knn.exact_knn(queries, corpus, 1).collect()


def test_access_frequency_counts_rounds(spark):
    trace = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 0, 6), (1, 1, 7)], "qid bigint, round bigint, node bigint")
    got = {r["round"]: (r.nodes, r.most, r.p50) for r in graph.access_frequency(trace).collect()}
    assert got == {0: (2, 2, 1.5), 1: (1, 1, 1.0)}


def test_sample_is_numbered_in_order_of_hashes(spark, monkeypatch):
    import hashlib

    ids = list(range(0, 3000, 3))
    df = spark.createDataFrame([(i,) for i in ids], "vec_id bigint").repartition(5)
    order = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    for n in (0, 1, 40, 1000, 5000):
        assert {r.nav_id: r.vec_id for r in graph.nav_sample(df, n).collect()} == dict(enumerate(order[:n]))


def test_navigation_start_of_a_file(spark, tmp_path):
    m = np.random.default_rng(9).normal(size=(60, 5))
    df, folder = frame(spark, m), str(tmp_path)
    index = VectorIndex.build(df, 8, nav=40)
    index.to_files(f"{folder}/index", 8)
    nav = index.nav.cache()
    links = graph.knn_graph(nav.join(df, "vec_id").select(F.col("nav_id").alias("vec_id"), "v"), 3)
    index_files.write_nav_graph(graph.adjacency(links).withColumnRenamed("node", "nav_id"), f"{folder}/nav/nav_index", 17)
    index_files.write_map(nav, f"{folder}/nav/map.txt")
    assert index_files.read_nav_start(f"{folder}/nav/nav_index") == 17
    of, near = {r.nav_id: r.vec_id for r in nav.collect()}, {}
    held = {n: m[i].astype("f4").astype(float) for n, i in of.items()}
    for r in links.collect():
        near.setdefault(r.src, []).append(r.dst)
    asked = df.filter("vec_id < 12").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    walked = VectorIndex.from_files(spark, f"{folder}/index", nav_prefix=f"{folder}/nav", walk=True)
    want = {}
    for i in range(12):
        seen = plain_search(held, near, 17, m[i], 4)
        want[i] = of[min(seen, key=lambda n: (round(float(((held[n] - m[i]) ** 2).sum()), 9), n))]
    for each in (walked, walked.save(f"{folder}/saved")):
        assert each.nav_start == 17 and {r.qid: r.entry for r in each.entries(asked).collect()} == want
    rows = nav.join(walked.corpus, "vec_id").select(F.col("nav_id").alias("vec_id"), "v")
    assert sorted(map(tuple, beam.nav_walk(asked, rows, links, 17).collect())) == sorted(map(tuple, beam.nav_walk(asked, rows, links, 17, most=0).collect()))


def test_whole_graph_over_shards(spark, sf_dir, tmp_path):
    rows, asked = q.corpus(spark, sf_dir), q.held_out(spark, sf_dir)
    index = VectorIndex.build(rows, 24, shards=3, near=True, whole=True, width=40).save(str(tmp_path / "index"))
    assert index.crossing
    found = index.search(asked, 10, 20)
    assert knn.recall(found, knn.exact_knn(asked, rows, 10), 10).first().recall >= 0.9
    assert key(found) == key(index.search(asked, 10, 20, "loop"))


@pytest.mark.parametrize("kind", ["clusters", "copies", "few"])
def test_near_shards_hold_no_more_than_they_may(spark, kind):
    rng = np.random.default_rng(11)
    m = {"clusters": np.concatenate([rng.normal(size=(n, 4)) + 40 * i for i, n in enumerate((300, 20, 150, 5, 90))]), "copies": np.concatenate((np.ones((200, 4)), rng.normal(size=(60, 4)))), "few": rng.normal(size=(9, 4))}[kind]
    shard_of, centres = graph.bounded_shards(frame(spark, m), 40, fan_out=3)
    of = {r.vec_id: r.shard for r in shard_of.collect()}
    assert sorted(of) == list(range(len(m)))
    sizes = np.bincount(list(of.values()))
    assert sizes.max() <= 40 and sizes.min() > 0 and len(sizes) <= 2 * -(-len(m) // 40) + 12
    for r in centres.collect():
        np.testing.assert_allclose(r.v, m[[i for i, s in of.items() if s == r.shard]].mean(axis=0))
    if kind == "clusters":
        home = np.repeat(range(5), (300, 20, 150, 5, 90))
        assert np.mean([max(np.bincount(home[[i for i in of if of[i] == s]])) for s in set(of.values())]) > 0.8 * np.mean(sizes)


def test_near_shards_of_an_index_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(beam, "SHARD_ROWS", 30)
    rng = np.random.default_rng(12)
    df = frame(spark, np.concatenate((rng.normal(size=(110, 4)), rng.normal(size=(10, 4)) + 90)))
    index = VectorIndex.build(df, 6, shards=4, near=True)
    assert index.shard_of.groupBy("shard").count().agg(F.max("count")).first()[0] <= 30 and index.shards == index.centres.count()
    asked = df.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    assert knn.recall(index.search(asked, 3, 30), knn.exact_knn(asked, df, 3), 3).first().recall == 1.0


def test_latencies_of_batches(spark, sf_dir, tmp_path, capsys):
    from vecloom.streaming.search import Latencies, percentiles, search_stream

    assert percentiles([1.0, 2.0, 3.0]) == pytest.approx((2.0, 2.8, 2.98)) and all(np.isnan(percentiles([])))
    asked, rows = q.held_out(spark, sf_dir).filter("qid < 200"), q.everything(spark, sf_dir)
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    heard = Latencies()
    spark.streams.addListener(heard)
    try:
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        index = VectorIndex(rows, graph.knn_graph(rows, 4), 1)
        search_stream(stream, index, 3, 5, str(tmp_path / "out"), str(tmp_path / "log"), "exact").awaitTermination()
        for _ in range(100):
            if sum(n for _, n, _ in heard.batches) == asked.count():
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert sum(n for _, n, _ in heard.batches) == asked.count() == spark.read.parquet(str(tmp_path / "out")).select("qid").distinct().count()
    p50, p90, p99 = heard.percentiles()
    assert 0 < p50 <= p90 <= p99 == pytest.approx(max(s for _, _, s in heard.batches), rel=0.2)


def test_sweep_tells_latencies(spark, sf_dir, tmp_path, capsys):
    from vecloom import cli
    from vecloom.sources import vecs

    rows = q.everything(spark, sf_dir).filter("vec_id < 60")
    VectorIndex.build(rows, 6).save(str(tmp_path / "index"))
    (written,) = vecs.write_vectors(rows.filter("vec_id < 9").coalesce(1), str(tmp_path / "q"), "fbin", "vec_id", "v").collect()
    (row,) = cli.main(["search", "--index", str(tmp_path / "index"), "--query", written.file, "--topk", "3", "--ef_search", "8", "-B", "3"], spark)
    p50, p90, p99 = row.latencies
    assert 0 < p50 <= p90 <= p99 <= row[1] and "p99" in capsys.readouterr().out


@pytest.mark.parametrize("single", [True, False])
def test_merged_cells_equal_pruning_by_hand(spark, single):
    """A vector goes to the edges that end in it, in single precision where it is exact; rows that repeat an id change nothing."""
    rng = np.random.default_rng(12)
    m = rng.normal(size=(60, 5))
    m = m.astype(np.float32).astype(np.float64) if single else m
    df = frame(spark, m)
    kind = knn.lean(df).schema["v"].dataType.elementType.typeName()
    assert kind == ("float" if single else "double")
    lists = {p: sorted(set(rng.choice(60, size=3 if p % 2 else 15).tolist()) - {p}) for p in range(60)}
    edges = spark.createDataFrame([(p, o, 1) for p, near in lists.items() for o in near], "src bigint, dst bigint, rk bigint")
    got: dict = {}
    for r in sorted(vamana.merge_cells(edges.unionByName(edges), df.unionByName(df.filter("vec_id % 3 = 0")), 4, 1.2).collect(), key=lambda r: (r.src, r.rk)):
        got.setdefault(r.src, []).append(r.dst)
    for p, near in lists.items():
        want = vamana.robust_prune(m, np.array([p]), np.array([near]), 4, np.inf if len(near) <= 4 else 1.2)[0]
        assert got[p] == want[want >= 0].tolist()


def test_a_shard_is_held_once_and_in_the_precision_it_comes_in():
    """Batches of a shard, out of order and with neighbours elsewhere, become arrays without a list a node."""
    rng = np.random.default_rng(3)
    ids, m = rng.permutation(50) * 3, rng.normal(size=(50, 4)).astype(np.float32)
    near = [rng.integers(0, 160, size=n).tolist() for n in rng.integers(0, 6, size=50)]
    table = pa.table({"vec_id": ids, "v": pa.array(list(m), pa.list_(pa.float32())), "code": pa.array([[i % 7, i % 5] for i in range(50)], pa.list_(pa.int16())), "nbrs": pa.array(near, pa.list_(pa.int64()))})
    nodes = beam.shard_nodes(pa.Table.from_batches(table.to_batches(max_chunksize=16)), True)
    assert nodes.vectors.dtype == np.float32 and nodes.ids.tolist() == sorted(ids.tolist())
    at = {int(n): i for i, n in enumerate(ids)}
    for row, node in enumerate(nodes.ids.tolist()):
        assert nodes.vectors[row].tolist() == m[at[node]].tolist()
        assert nodes.nbrs[row][: len(near[at[node]])].tolist() == [n if n in at else -1 for n in near[at[node]]] and (nodes.nbrs[row][len(near[at[node]]):] == -1).all()
    walks = type("", (), {"by_codes": lambda self, lanes, codes: codes.sum(axis=1)})()
    rows, slots = np.nonzero(nodes.nbrs >= 0)
    assert nodes.guide(walks, rows, rows, slots).tolist() == [at[n] % 7 + at[n] % 5 for n in nodes.nbrs[rows, slots].tolist()]


def test_codes_beside_a_shards_nodes_are_not_widened(spark, monkeypatch):
    """A shard of the exchange holds its neighbours' codes as the small integers that they are."""
    rng, kinds = np.random.default_rng(9), []
    m = rng.normal(size=(40, 4))
    df = frame(spark, m)
    model, edges = pq.model_from_rows(df, 2, 8), graph.knn_graph(df, 4)
    table = beam.search_graph(edges, df, pq.encode(df, model)).toArrow()
    monkeypatch.setattr(beam.Walks, "by_codes", lambda self, lanes, codes: kinds.append(codes.dtype) or self.tables[lanes[:, None], np.arange(codes.shape[1]), codes].sum(axis=1))
    none = pa.array([[]], pa.list_(pa.float64()))
    states = pa.table({"qid": [0], "qv": pa.array([m[5].tolist()]), "beam_d": none, "beam_id": none.cast(pa.list_(pa.int64())), "seen": pa.array([[1]]), "exact": pa.array([[float("inf")]]), "next": [1]})
    found = beam._advance(table, states, model, 8)
    assert found.column("next").to_pylist() == [-1] and set(kinds) == {np.dtype(np.int16)}


def test_a_cells_edges_are_ranked_block_by_block(monkeypatch):
    """The vectors of both ends of all edges are never held together: a full cell's would take a gigabyte."""
    rng = np.random.default_rng(3)
    cell = vamana.Cell.__new__(vamana.Cell)
    cell.m, cell.nbrs = rng.normal(size=(2_000, 64)), rng.integers(-1, 2_000, size=(2_000, 32))
    ids = np.arange(2_000) * 3
    src, slot = np.nonzero(cell.nbrs >= 0)
    dst = cell.nbrs[src, slot]
    near = ((cell.m[src] - cell.m[dst]) ** 2).sum(axis=1)
    order = np.lexsort((dst, near, src))
    monkeypatch.setattr(vamana, "EDGES", 1_000)
    tracemalloc.start()
    got = cell.edges(ids)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["src"].tolist() == ids[src[order]].tolist() and got["dst"].tolist() == ids[dst[order]].tolist()
    assert held < len(src) * 64 * 8 / 2  # half of one end's vectors
