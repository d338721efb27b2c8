"""Data sources of vector and index files: round trips, failed tasks, several files and tasks, filters."""

import os

import pytest
from pyspark.sql import functions as F
from vecloom.sources import datasource, index_files, vecs


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    datasource.register(spark)


def rows(spark, n, parts=3, width=3):
    df = spark.range(n).select(F.col("id"), F.array(*[F.col("id").cast("double") + i for i in range(width)]).alias("vector"))
    return df.repartitionByRange(parts, "id").sortWithinPartitions("id")


@pytest.mark.parametrize(("form", "option", "value", "kind"), [("vecs", "kind", "fvecs", "fvecs"), ("vecs", "kind", "ibin", "ibin"), ("vecs", "kind", "bvecs", "bvecs"), ("vecbin", "dtype", "float", "fbin"), ("vecbin", "dtype", "uint8", "bbin")])
def test_written_files_are_one_table(spark, tmp_path, form, option, value, kind):
    folder = str(tmp_path / "out")
    rows(spark, 100).write.format(form).option(option, value).mode("append").save(folder)
    names = sorted(os.listdir(folder))
    assert names == [f"part-{i:05d}.{kind}" for i in range(3)]
    read = spark.read.format(form).option(option, value).load(folder)
    assert {r.pos: list(map(int, r.vector)) for r in read.collect()} == {i: [i, i + 1, i + 2] for i in range(100)}
    rows(spark, 10, 1).write.format(form).option(option, value).mode("append").save(folder)
    assert spark.read.format(form).option(option, value).load(folder).count() == 110
    rows(spark, 7, 2).write.format(form).option(option, value).mode("overwrite").save(folder)
    again = spark.read.format(form).option(option, value).load(folder)
    assert [r.pos for r in again.orderBy("pos").collect()] == list(range(7)) and len(os.listdir(folder)) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows(spark, 9).write.format("vecs").option("kind", "fbin").mode("append").save(folder)
    before = sorted(os.listdir(folder))
    broken = rows(spark, 100).withColumn("vector", F.when(F.col("id") == 99, F.array(F.lit(1.0))).otherwise(F.col("vector")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="width"):
            broken.write.format("vecs").option("kind", "fbin").mode(mode).save(folder)
        assert sorted(os.listdir(folder)) == before
    wider = rows(spark, 30).withColumn("vector", F.when(F.spark_partition_id() == 1, F.array(F.lit(1.0))).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="widths"):
        wider.write.format("vecs").option("kind", "fbin").mode("overwrite").save(folder)
    assert sorted(os.listdir(folder)) == before
    with pytest.raises(Exception, match="vector"):
        rows(spark, 3).withColumnRenamed("vector", "v").write.format("vecs").option("kind", "fbin").mode("append").save(folder)


def test_no_rows_make_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows(spark, 0, 2).write.format("vecs").option("kind", "fvecs").mode("append").save(folder)
    assert os.listdir(folder) == [] and spark.read.format("vecs").option("kind", "fvecs").load(folder).collect() == []


def test_paged_index(spark, tmp_path):
    nodes = spark.range(200).select(F.col("id").alias("node"), F.array(*[F.col("id").cast("float") + i for i in range(40)]).alias("vector"), F.when(F.col("id") % 3 > 0, F.array((F.col("id") + 1) % 200)).alias("nbrs"))
    names = index_files.write_index(nodes, str(tmp_path / "index"), 4, 7, stripes=2)
    load = lambda: spark.read.format("paged").option("place", "true").option("pages", 2).load(",".join(names))
    read = load()
    meta = index_files.read_meta(names[0])
    got = {r.node: r for r in read.collect()}
    assert len(got) == 200 and read.rdd.getNumPartitions() == -(-meta.pages // 2)
    for i, r in got.items():
        assert r.vector[5] == i + 5 and r.nbrs == ([(i + 1) % 200] if i % 3 else []) and (r.page, r.byte_offset) == (i // meta.per_page + 1, i % meta.per_page * meta.record_bytes)
    for some, want in (("node = 77", [77]), ("node in (3, 5, 190)", [3, 5, 190]), ("node > 195", range(196, 200)), ("node >= 21 and node < 23", [21, 22]), ("node <= 1", [0, 1]), ("node = -4 or node = 5", [5])):
        assert sorted(r.node for r in load().filter(some).collect()) == list(want)
    reader = datasource.PagedReader(names, "float", False)
    list(reader.pushFilters([datasource.api.EqualTo(("node",), 77)]))
    assert [(p.first, p.end) for p in reader.partitions()] == [(77, 78)]
    plan = spark.read.format("paged").load(",".join(names)).filter("node = 77")._jdf.queryExecution().executedPlan().toString()
    assert "Filter isnotnull(node" in plan and "= 77" not in plan  # the source has taken it over
    (tmp_path / "short").write_bytes(b"abc")
    with pytest.raises(Exception, match="header"):
        spark.read.format("paged").load(str(tmp_path / "short")).collect()


def test_truth_codes_and_navigation(spark, tmp_path):
    truth = spark.createDataFrame([(i, [i, i + 1], [0.5, i + 0.25]) for i in range(50)], "qid bigint, ids array<int>, dists array<float>")
    vecs.write_truth(truth, str(tmp_path / "truth.bin")).collect()
    read = spark.read.format("truth").load(str(tmp_path / "truth.bin"))
    assert read.exceptAll(truth).count() == 0 and read.count() == 50 and [r.ids for r in read.filter("qid = 9").collect()] == [[9, 10]]
    codes = spark.createDataFrame([(i, [i, 255 - i]) for i in range(60)], "vec_id bigint, code array<smallint>").coalesce(1)
    (written,) = index_files.write_codes(codes, str(tmp_path / "codes")).collect()
    read = spark.read.format("pqcodes").load(written.file)
    assert read.exceptAll(codes).count() == 0 and [r.code for r in read.filter("vec_id = 9").collect()] == [[9, 246]]
    nav = spark.createDataFrame([(i, list(range(i % 5))) for i in range(103)], "nav_id bigint, nbrs array<bigint>")
    path = str(tmp_path / "nav")
    index_files.write_nav_graph(nav, path, 11)
    for df in (spark.read.format("navgraph").option("rows", 10).load(path), index_files.read_nav_graph(spark, path, 10)):
        assert df.rdd.getNumPartitions() == 11 and df.exceptAll(nav).count() == 0 and df.count() == 103
    assert {r.nav_id: r.nbrs for r in spark.read.format("navgraph").option("rows", 10).load(path).filter("nav_id between 19 and 21").collect()} == {19: [0, 1, 2, 3], 20: [], 21: [0]}
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="broken"):
        spark.read.format("navgraph").load(path).collect()
