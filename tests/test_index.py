"""The index, its command line and the search of streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom import cli
from vecloom.index import VectorIndex
from vecloom.operators import beam, graph, knn
from vecloom.sources import vecs
from vecloom.streaming.search import search_stream


@pytest.fixture(scope="module")
def points(spark):
    m = np.random.default_rng(3).normal(size=(300, 8)).astype("f4")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, v array<double>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).normal(size=(6, 8)))], "qid bigint, qv array<double>")
    return m, df, asked


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("chunks, nav", [(None, None), (4, 20)])
def test_index_saves_loads_and_searches(spark, points, tmp_path, chunks, nav):
    _, df, asked = points
    index = VectorIndex.build(df, 10, chunks, 32, nav).save(str(tmp_path / "index"))
    truth = index.search(asked, 5, 5, "exact")
    batch = index.search(asked, 5, 300)
    assert rows(index.search(asked, 5, 8), "qid", "rk", "vec_id", "n_expanded") == rows(index.search(asked, 5, 8, "loop"), "qid", "rk", "vec_id", "n_expanded")
    assert knn.recall(batch, truth, 5).first().recall >= 0.99
    with pytest.raises(ValueError):
        index.search(asked, 5, 4)
    with pytest.raises(ValueError):
        index.search(asked, 5, 5, "other")


def test_shards_merge(points):
    _, df, asked = points
    index = VectorIndex.build(df, 10, shards=4)
    assert index.edges.filter("src % 4 <> dst % 4").count() == 0
    assert knn.recall(index.search(asked, 5, 100), index.search(asked, 5, 5, "exact"), 5).first().recall >= 0.99
    assert beam.shard_count(df, 100) == 3


def test_large_indexes_of_one_shard_are_searched_in_the_loop(points, monkeypatch):
    _, df, asked = points
    index, taken = VectorIndex(df, df.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst")), 0), []
    monkeypatch.setattr(beam, "beam_search", lambda *a: taken.append("loop"))
    monkeypatch.setattr(beam, "beam_search_batch", lambda *a: taken.append("batch"))
    index.search(asked, 5, 5)
    monkeypatch.setattr(beam, "shard_count", lambda corpus: 2)
    index.search(asked, 5, 5)
    assert taken == ["batch", "loop"]


def test_pruning_in_blocks_is_pruning_at_once(points, monkeypatch):
    m, _, _ = points
    whole = graph.prune(np.arange(300), m.astype(float), 6, 1.2)
    monkeypatch.setattr(graph, "PRUNE_ROWS", 7)
    assert graph.prune(np.arange(300), m.astype(float), 6, 1.2) == whole
    near = ((m[:, None].astype(float) - m[None]) ** 2).sum(2)
    for src in (0, 150, 299):
        kept = []
        for j in [int(j) for j in np.argsort(near[src], kind="stable") if j != src][:24]:
            if len(kept) < 6 and all(1.2 * near[j, c] > near[src, j] for c in kept):
                kept.append(j)
        assert [d for s, d, _ in whole if s == src] == kept
    assert graph.prune(np.arange(1), m[:1].astype(float), 6, 1.2) == []
    assert [d for _, d, _ in graph.prune(np.arange(3), np.ones((3, 2)), 2, 1.2)] == [1, 0, 0]


def test_stream_answers_every_query_once(spark, points, tmp_path):
    _, df, asked = points
    index = VectorIndex.build(df, 10)
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        search_stream(stream, index, 5, 50, str(tmp_path / "out"), str(tmp_path / "log"), "exact").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert rows(got, "qid", "rk", "vec_id") == rows(index.search(asked, 5, 5, "exact"), "qid", "rk", "vec_id")


def test_command_line(spark, points, tmp_path, capsys):
    m, df, asked = points
    t = str(tmp_path)
    run = lambda *words: cli.main([str(w) for w in words], spark)
    (base,) = vecs.write_vectors(df.select(F.col("vec_id").alias("pos"), F.col("v").alias("vector")).coalesce(1), f"{t}/base", "fvecs").collect()
    (query,) = vecs.write_vectors(asked.select(F.col("qid").alias("pos"), F.col("qv").alias("vector")).coalesce(1), f"{t}/query", "fbin").collect()
    q = np.array([r.qv for r in asked.orderBy("qid").collect()], dtype="f4").astype(float)
    near = np.argsort(((q[:, None] - m[None].astype(float)) ** 2).sum(2), axis=1)[:, :5]
    truth = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(near)], "pos bigint, vector array<int>").coalesce(1)
    (known,) = vecs.write_vectors(truth, f"{t}/truth", "ivecs").collect()

    run("build", "--vectors", base.file, "--out", f"{t}/index", "--degree", 10, "--chunks", 4, "--pivots", 32, "--nav", 20)
    swept = run("search", "--index", f"{t}/index", "--query", query.file, "--ground_truth", known.file, "--topk", 5, "--ef_search", 5, 300, "-R", 2, "--output", f"{t}/found")
    assert [r[0] for r in swept] == [5, 300] and swept[1][3] >= 99 and "Recall@5" in capsys.readouterr().out
    (found,) = (tmp_path / "found" / "ef=300").glob("*.ibin")
    assert abs(100 * run("recall", "--result", found, "--ground_truth", known.file, "--topk", 5) - swept[1][3]) < 1e-9
    with pytest.raises(ValueError):
        run("search", "--index", f"{t}/index", "--query", query.file, "--topk", 5, "--ef_search", 4)

    (paged,) = VectorIndex.load(spark, f"{t}/index").to_files(f"{t}/paged", 10)
    again = run("search", "--index", paged, "--paged", "--query", query.file, "--ground_truth", known.file, "--topk", 5, "--ef_search", 300, "-R", 1)
    assert again[0][3] >= 99
    striped = run("split", "--index", paged, "--out", f"{t}/striped", "--stripes", 2)
    assert run("hops", "--index", *striped) == run("hops", "--index", paged)
    (tmp_path / "ids").write_text("1 2\n3 999999\n")
    counted = dict(run("hops", "--index", paged, "--ids", tmp_path / "ids", "--depth", 30))
    assert sum(counted.values()) == 4 and counted[None] >= 1
    (wide,) = run("widen", "--index", paged, "--out", f"{t}/wide", "--times", 2)
    assert [list(map(float, r.vector)) for r in cli.files.read_index(spark, wide).orderBy("node").limit(2).collect()] == [[float(x) for x in np.repeat(v, 2)] for v in m[:2]]

    run("sample", "--vectors", base.file, "--n", 9, "--out", f"{t}/sample")
    ids = [int(x) for x in (tmp_path / "sample" / "map.txt").read_text().split()]
    (picked,) = (tmp_path / "sample").glob("*.fvecs")
    assert [list(map(float, r.vector)) for r in vecs.read_vectors(spark, str(picked), "fvecs").orderBy("pos").collect()] == [[float(x) for x in m[i]] for i in ids]
    run("convert", "--vectors", base.file, "--out", f"{t}/some", "--kind", "fbin", "--first", 10, "--limit", 5)
    (some,) = (tmp_path / "some").glob("*.fbin")
    assert vecs.shape(str(some), "fbin") == vecs.Shape(5, 8)
