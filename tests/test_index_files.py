"""Index, quantisation and navigation files: round trips and broken files."""

import numpy as np
import pytest
from vecloom.operators.pq import PQModel
from vecloom.sources import index_files as files
from vecloom.sources import vecs

SCHEMA = "node bigint, vector array<double>, nbrs array<bigint>"


def nodes(spark, n, width=5, degree=7):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(0, 256, width)], [int(x) for x in rng.integers(0, n, rng.integers(0, degree + 1))]) for i in range(n)]
    return rows, spark.createDataFrame(rows[::-1], SCHEMA)


@pytest.mark.parametrize("element", sorted(files.ELEMENTS))
@pytest.mark.parametrize("stripes", [1, 3])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_index_round_trip(spark, tmp_path, element, stripes, n):
    rows, df = nodes(spark, n)
    names = files.write_index(df, str(tmp_path / "index"), 7, 0, element, stripes)
    meta = files.read_meta(names[0], element)
    assert (meta.nodes, meta.degree, len(names)) == (n, 7, stripes)
    back = files.read_index(spark, names if n else names[:1], element).orderBy("node").collect()
    assert [(r.node, list(map(float, r.vector)), r.nbrs) for r in back] == rows
    if n == 500:
        asked = spark.createDataFrame([(3,), (499,), (None,), (500,), (-1,)], "node bigint")
        assert [tuple(r)[:1] + (r.nbrs,) for r in files.read_nodes(asked, names, element).orderBy("node").collect()] == [(3, rows[3][2]), (499, rows[499][2])]
        edges = files.edge_list(files.read_index(spark, names, element))
        assert edges.count() == sum(len(r[2]) for r in rows)


@pytest.mark.parametrize("batch", [1, 7, 78])
def test_pages_go_on_from_batch_to_batch(spark, tmp_path, batch):
    rows, df = nodes(spark, 300)
    (want,) = files.write_index(df, str(tmp_path / "whole"), 7, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        (name,) = files.write_index(df, str(tmp_path / "index"), 7, 4)
        striped = files.write_index(df, str(tmp_path / "striped"), 7, 4, stripes=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert open(name, "rb").read() == open(want, "rb").read()
    back = files.read_index(spark, striped).orderBy("node").collect()
    assert [(r.node, list(map(float, r.vector)), r.nbrs) for r in back] == rows


def test_what_a_record_cannot_hold_raises(spark, tmp_path):
    for i, (vector, near, element) in enumerate(((None, [1], "float"), ([1.0], [None], "float"), ([1.0], [2**31], "float"), ([256.0], [1], "uint8"), ([None], [1], "uint8"))):
        df = spark.createDataFrame([(0, [1.0], [0]), (1, vector, near)], SCHEMA)
        with pytest.raises(Exception, match="null|out of bounds"):
            files.write_index(df, str(tmp_path / str(i)), 2, 0, element)
        assert not (tmp_path / str(i)).exists()


def test_pages_hold_records_where_the_layout_says(spark, tmp_path):
    rows, df = nodes(spark, 300)
    (name,) = files.write_index(df, str(tmp_path / "index"), 7, 4)
    meta, raw = files.read_meta(name), open(name, "rb").read()
    assert (meta.record_bytes, meta.per_page, meta.medoid) == (52, 78, 4) and len(raw) == 4096 * (1 + meta.pages)
    at = 4096 * (200 // 78 + 1) + 200 % 78 * 52
    assert np.frombuffer(raw, "<f4", 5, at).tolist() == rows[200][1]


def test_broken_indexes_raise(spark, tmp_path):
    rows, df = nodes(spark, 100)
    with pytest.raises(ValueError):
        files.write_index(df.filter("node <> 5"), str(tmp_path / "gap"), 7, 0)
    with pytest.raises(ValueError):
        files.write_index(df, str(tmp_path / "degree"), 2, 0)
    with pytest.raises(ValueError):
        files.meta_of(1, 1024, 0, 32, "float")
    (name,) = files.write_index(df, str(tmp_path / "index"), 7, 0)
    with open(name, "r+b") as f:
        f.truncate(5000)
    with pytest.raises(Exception, match="shorter"):
        files.read_index(spark, name).collect()
    with open(name, "r+b") as f:
        f.truncate(20)
    with pytest.raises(ValueError):
        files.read_meta(name)


@pytest.mark.parametrize("tables", [4, 5])
def test_quantisation_files(spark, tmp_path, tables):
    rng = np.random.default_rng(1)
    offsets = (0, 3, 5, 7)
    model = PQModel(offsets, tuple(rng.normal(size=(20, b - a)).astype("f4").astype("f8") for a, b in zip(offsets, offsets[1:])), rng.normal(size=7).astype("f4").astype("f8"))
    path = str(tmp_path / "pivots.bin")
    files.write_pq_model(model, path)
    if tables == 5:  # an older file: one table more before the boundaries
        raw = bytearray(open(path, "rb").read())
        at = np.frombuffer(raw, "<u8", 4, 8)
        raw[:48] = np.array([5, 1], "<i4").tobytes() + np.array([at[0], at[1], at[1], at[2], at[3]], "<u8").tobytes()
        open(path, "wb").write(raw)
    back = files.read_pq_model(path)
    m = rng.normal(size=(50, 7))
    assert back.offsets == offsets and np.array_equal(back.encode(m), model.encode(m))
    codes = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(model.encode(m))], "vec_id bigint, code array<smallint>").coalesce(1)
    (written,) = files.write_codes(codes, str(tmp_path / "codes")).collect()
    assert files.read_codes(spark, written.file).exceptAll(codes).count() == 0
    open(path, "r+b").write(np.array([3, 1], "<i4").tobytes())
    with pytest.raises(ValueError):
        files.read_pq_model(path)


def test_navigation_files(spark, tmp_path):
    rows = [(0, [1, 2]), (1, [0]), (2, [1, 0, 1])]
    path = str(tmp_path / "nav")
    files.write_nav_graph(spark.createDataFrame(rows[::-1], "nav_id bigint, nbrs array<bigint>"), path, 1)
    assert [tuple(r) for r in files.read_nav_graph(spark, path).orderBy("nav_id").collect()] == rows
    nav = spark.createDataFrame([(2, 90), (0, 70), (1, 80)], "nav_id bigint, vec_id bigint")
    files.write_map(nav, str(tmp_path / "map.txt"))
    assert open(tmp_path / "map.txt").read() == "70\n80\n90\n"
    assert files.read_map(spark, str(tmp_path / "map.txt")).exceptAll(nav).count() == 0
    (tags,) = files.write_tags(nav, str(tmp_path / "tags")).collect()
    assert [r.vector for r in vecs.read_vectors(spark, tags.file, "ibin").orderBy("pos").collect()] == [[70], [80], [90]]
    with open(path, "r+b") as f:
        f.truncate(30)
    with pytest.raises(Exception, match="broken"):
        files.read_nav_graph(spark, path).collect()
