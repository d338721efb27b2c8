"""Registered queries over the table ``embeddings``. Queries are the rows whose vec_id divides by 25.

Scans, encoders, statistics, graphs and exact searches read all rows, searches but the query's own.
Only where recall is claimed, that is in searches of a graph, are the queries held out of the corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import beam, graph, knn, pq, vamana, zipf
from ..index import VectorIndex
from ..sources import datasource
from ..sources import index_files as files
from ..streaming.search import search_stream
from .scratch import cut, scratch_dir

K, DEGREE, EF, CHUNKS, PIVOTS, NAV, DIGITS = 10, 12, 20, 16, 32, 32, 6
#: Neighbours of a graph built by search, and the beam that it is built with.
BUILT, WIDTH = 32, 64
ENTRY, NAV_START, SHARDS = 1, 5, 4
qv, v = "qv", "v"

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name):
    return F.round(c, DIGITS).alias(name)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def everything(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", D.cast_vector(F.col("embedding")).alias("v"))


def corpus(spark, sf_dir) -> DataFrame:
    """All rows but the queries: for claims of recall."""
    return embeddings(spark, sf_dir).filter("vec_id % 25 != 0").select("vec_id", D.cast_vector(F.col("embedding")).alias("v"))


def held_out(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).filter("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), D.cast_vector(F.col("embedding")).alias("qv"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", DIGITS))


def edges(spark, sf_dir, rows=everything) -> DataFrame:
    return cut(graph.knn_graph(rows(spark, sf_dir), DEGREE))


def model(spark, sf_dir, rows=everything) -> pq.PQModel:
    return pq.model_from_rows(rows(spark, sf_dir), CHUNKS, PIVOTS)


def with_copies(spark, sf_dir) -> DataFrame:
    """All rows, every third with the vector of row 1."""
    rows = everything(spark, sf_dir)
    one = rows.filter("vec_id = 1").select(F.col("v").alias("one"))
    return rows.join(F.broadcast(one), F.lit(True)).select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("one")).otherwise(F.col("v")).alias("v"))


@query
def scan_vectors(spark, sf_dir):
    return everything(spark, sf_dir).select("vec_id", F.size("v").alias("dims"), r6(D.vec_sum(v), "total"))


@query
def point_lookup(spark, sf_dir):
    return embeddings(spark, sf_dir).filter(F.col("vec_id").isin(1, 7, 49)).select("vec_id", "label", r6(F.element_at("embedding", 1).cast("double"), "first"))


@query
def l2_distance(spark, sf_dir):
    return knn.score_all(held_out(spark, sf_dir), everything(spark, sf_dir), "l2", DIGITS)


@query
def inner_product(spark, sf_dir):
    return knn.score_all(held_out(spark, sf_dir), everything(spark, sf_dir), "dot", DIGITS, "sim")


@query
def cosine_similarity(spark, sf_dir):
    return knn.score_all(held_out(spark, sf_dir), everything(spark, sf_dir), "cosine", DIGITS, "sim")


@query
def cosine_distance(spark, sf_dir):
    return knn.score_all(held_out(spark, sf_dir), everything(spark, sf_dir), "cosine_distance", DIGITS)


@query
def cast_vector(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.floor(x * 255).cast("smallint"))).alias("i", "x")).select(
        "vec_id", "i", F.col("x").cast("double").alias("x"))


@query
def center_vectors(spark, sf_dir):
    rows = everything(spark, sf_dir)
    centred = rows.join(F.broadcast(graph.centroid(rows)), F.lit(True)).select("vec_id", D.center(v, F.col("centroid")).alias("c"))
    return centred.select("vec_id", r6(D.dot(F.col("c"), F.col("c")), "norm2"), r6(F.element_at("c", 1), "first"))


@query
def pq_chunks(spark, sf_dir):
    return everything(spark, sf_dir).select("vec_id", F.posexplode(D.chunks(v, CHUNKS, 4)).alias("chunk", "part")).select("vec_id", "chunk", r6(D.vec_sum(F.col("part")), "total"))


@query
def pq_lut(spark, sf_dir):
    tables = pq.lookup_tables(held_out(spark, sf_dir), model(spark, sf_dir))
    rows = tables.select("qid", F.posexplode("lut").alias("chunk", "t")).select("qid", "chunk", F.posexplode("t").alias("pivot", "d"))
    return rows.select("qid", "chunk", "pivot", r6(F.col("d"), "dist"))


@query
def pq_encode(spark, sf_dir):
    codes = pq.encode(everything(spark, sf_dir), model(spark, sf_dir))
    return codes.select("vec_id", F.posexplode("code").alias("chunk", "pivot")).select("vec_id", "chunk", F.col("pivot").cast("int").alias("pivot"))


@query
def pq_adc(spark, sf_dir):
    m = model(spark, sf_dir)
    return pq.adc_distances(pq.lookup_tables(held_out(spark, sf_dir), m), pq.encode(everything(spark, sf_dir), m), (9, DIGITS))


@query
def adc_neighbors(spark, sf_dir):
    """Of every edge, the distance of its end to each query from codes."""
    m = model(spark, sf_dir)
    return pq.adc_edges(pq.lookup_tables(held_out(spark, sf_dir), m), pq.encode(everything(spark, sf_dir), m), edges(spark, sf_dir), (9, DIGITS))


@query
def pq_rerank(spark, sf_dir):
    rows, m, asked = everything(spark, sf_dir), model(spark, sf_dir), held_out(spark, sf_dir)
    near = knn.top_k(rounded(pq.adc_distances(pq.lookup_tables(asked, m), pq.encode(rows, m), nearest=50)), 50)
    return rounded(pq.rerank(asked, near, rows, K))


@query
def pq_train(spark, sf_dir):
    m = pq.train(everything(spark, sf_dir), CHUNKS, PIVOTS)
    codes = pq.encode(everything(spark, sf_dir), m)
    return codes.select(F.posexplode("code").alias("chunk", "pivot")).groupBy("chunk").agg(F.count_distinct("pivot").alias("used"))


@query
def page_layout(spark, sf_dir):
    """The page, and the byte in it, that each vector of a paged index was read from."""
    datasource.register(spark)
    read = spark.read.format("paged").option("place", "true").load(",".join(_paged(spark, sf_dir)))
    return read.select(F.col("node").alias("vec_id"), "page", "byte_offset")


@query
def shard_assign(spark, sf_dir):
    shard, place = graph.shard_assign(F.col("vec_id"), 4)
    return embeddings(spark, sf_dir).select("vec_id", shard.alias("shard"), place.alias("place"))


@query
def replicate_dims(spark, sf_dir):
    out = graph.replicate_dims(everything(spark, sf_dir), 3)
    return out.select("vec_id", F.size("v").alias("dims"), r6(D.vec_sum(v), "total"), r6(F.element_at("v", 4), "fourth"))


@query
def replicate_queries(spark, sf_dir):
    return knn.replicate_queries(held_out(spark, sf_dir), 3).select("qid", r6(F.element_at("qv", 1), "first"))


@query
def exact_knn(spark, sf_dir):
    return rounded(knn.exact_knn(held_out(spark, sf_dir), everything(spark, sf_dir), K, skip_self=True))


@query
def knn_ties(spark, sf_dir):
    """Exact search where every third vector is a copy of one: ties go by id."""
    return rounded(knn.exact_knn(held_out(spark, sf_dir), with_copies(spark, sf_dir), K, skip_self=True))


@query
def knn_graph_ties(spark, sf_dir):
    """The exact graph of the same vectors."""
    return graph.knn_graph(with_copies(spark, sf_dir), DEGREE)


@query
def exact_knn_lateral(spark, sf_dir):
    """A lateral subquery over each task's own nearest rows: no pair besides reaches the sort."""
    asked = held_out(spark, sf_dir)
    return spark.sql(
        "SELECT q.qid, t.vec_id, round(t.dist, 6) AS dist FROM {q} q, LATERAL (SELECT n.vec_id, n.dist FROM {n} n WHERE n.qid = q.qid ORDER BY n.dist, n.vec_id LIMIT 10) t",
        q=asked.select("qid"), n=knn.nearest_of_tasks(asked, everything(spark, sf_dir), K, skip_self=True))


@query
def topk_per_query(spark, sf_dir):
    found = knn.exact_knn(held_out(spark, sf_dir), everything(spark, sf_dir), K, "dot", skip_self=True)
    return found.select("qid", "rk", "vec_id", r6(-F.col("dist"), "sim"))


@query
def radius_search(spark, sf_dir):
    return rounded(knn.radius_search(held_out(spark, sf_dir), everything(spark, sf_dir), 1.5, skip_self=True))


@query
def filtered_knn(spark, sf_dir):
    some = embeddings(spark, sf_dir).filter("label = 3").select("vec_id", D.cast_vector(F.col("embedding")).alias("v"))
    return rounded(knn.exact_knn(held_out(spark, sf_dir), some, K, skip_self=True))


@query
def found_cnt(spark, sf_dir):
    near = knn.radius_search(held_out(spark, sf_dir), everything(spark, sf_dir), 1.5, skip_self=True)
    return held_out(spark, sf_dir).join(near, "qid", "left").groupBy("qid").agg(F.count("vec_id").alias("found"))


@query
def dist_percentiles(spark, sf_dir):
    found = knn.distance_percentiles(held_out(spark, sf_dir), everything(spark, sf_dir), (0.5, 0.9, 0.99))
    return spark.createDataFrame([tuple(found)], "p50 double, p90 double, p99 double").select(*[r6(F.col(c), c) for c in ("p50", "p90", "p99")])


@query
def recall_at_k(spark, sf_dir):
    """Of the neighbours by the first half of the dimensions, how many are true ones."""
    asked, rows = held_out(spark, sf_dir), corpus(spark, sf_dir)
    half = knn.exact_knn(asked.withColumn("qv", F.slice("qv", 1, 32)), rows.withColumn("v", F.slice("v", 1, 32)), K)
    return knn.recall(half, knn.exact_knn(asked, rows, K), K).select(r6(F.col("recall"), "recall"))


@query
def knn_graph(spark, sf_dir):
    return graph.knn_graph(everything(spark, sf_dir), DEGREE)


@query
def vamana_graph(spark, sf_dir):
    """The graph built by search."""
    return vamana.vamana_graph(everything(spark, sf_dir), BUILT, WIDTH)


@query
def vamana_reach(spark, sf_dir):
    """All vectors, and those that the medoid reaches in that graph."""
    rows = everything(spark, sf_dir)
    hops = graph.bfs_hops(vamana_graph(spark, sf_dir), graph.medoid(rows).first().vec_id, most=1 << 30)
    return rows.join(hops, F.col("vec_id") == F.col("node"), "left").agg(F.count("*").alias("nodes"), F.count("hop").alias("reached"))


@query
def vamana_recall(spark, sf_dir):
    """Recall of a beam of EF, led by exact distances, over such a graph of the rows that are no queries."""
    rows, asked = corpus(spark, sf_dir), held_out(spark, sf_dir)
    index = VectorIndex.build(rows, BUILT, width=WIDTH)
    return knn.recall(index.search(asked, K, EF), knn.exact_knn(asked, rows, K), K).select(r6(F.col("recall"), "recall"))


@query
def nav_sample(spark, sf_dir):
    return graph.nav_sample(everything(spark, sf_dir), NAV)


@query
def nav_graph(spark, sf_dir):
    chosen = graph.nav_sample(everything(spark, sf_dir), NAV).join(everything(spark, sf_dir), "vec_id")
    return graph.knn_graph(chosen.select(F.col("nav_id").alias("vec_id"), "v"), 8)


@query
def nav_entry(spark, sf_dir):
    out = beam.nav_entry(held_out(spark, sf_dir), graph.nav_sample(everything(spark, sf_dir), NAV), everything(spark, sf_dir))
    return rounded(out)


def _nav_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    chosen = graph.nav_sample(everything(spark, sf_dir), NAV).join(everything(spark, sf_dir), "vec_id").select(F.col("nav_id").alias("vec_id"), "v")
    return cut(chosen), cut(graph.knn_graph(chosen, 8))


@query
def nav_walk(spark, sf_dir):
    """The entry by a walk of the navigation graph from its node 0, with a beam of four."""
    return _walked(spark, sf_dir, 0)


@query
def nav_walk_start(spark, sf_dir):
    """The same walk from another node, as the header of a navigation file can name it."""
    rows, links = _nav_tables(spark, sf_dir)
    path = f"{_folder(spark)}/nav_index"
    files.write_nav_graph(graph.adjacency(links).withColumnRenamed("node", "nav_id"), path, NAV_START)
    return _walked(spark, sf_dir, files.read_nav_start(path))


def _walked(spark, sf_dir, start: int) -> DataFrame:
    rows, links = _nav_tables(spark, sf_dir)
    found = beam.nav_walk(held_out(spark, sf_dir), rows, links, start)
    return rounded(found.join(graph.nav_sample(everything(spark, sf_dir), NAV), "nav_id").select("qid", "nav_id", F.col("vec_id").alias("entry"), "dist"))


@query
def zipf_draws(spark, sf_dir):
    """A skewed query stream: of each vector's draw, the item by Zipf's law."""
    return zipf.draw(embeddings(spark, sf_dir).select("vec_id"), "vec_id", 100, 1.1).select("vec_id", "item")


@query
def nav_translate(spark, sf_dir):
    nav = graph.nav_sample(everything(spark, sf_dir), NAV)
    return held_out(spark, sf_dir).select("qid", F.pmod("qid", F.lit(NAV)).alias("nav_id")).join(nav, "nav_id").select("qid", "nav_id", F.col("vec_id").alias("entry"))


@query
def centroid(spark, sf_dir):
    return graph.centroid(everything(spark, sf_dir)).select(F.posexplode("centroid").alias("i", "x")).select("i", r6(F.col("x"), "x"))


@query
def medoid(spark, sf_dir):
    return rounded(graph.medoid(everything(spark, sf_dir)))


@query
def degree_stats(spark, sf_dir):
    reverse = graph.knn_graph(everything(spark, sf_dir), DEGREE).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.degree_stats(reverse).withColumn("avg_degree", F.round("avg_degree", DIGITS))


@query
def dangling_edges(spark, sf_dir):
    some = everything(spark, sf_dir).filter("vec_id % 10 != 1")
    return graph.dangling_edges(graph.knn_graph(everything(spark, sf_dir), DEGREE), some)


@query
def bfs_hops(spark, sf_dir):
    return graph.bfs_hops(edges(spark, sf_dir), ENTRY)


@query
def hop_histogram(spark, sf_dir):
    return graph.hop_histogram(graph.bfs_hops(edges(spark, sf_dir), ENTRY), everything(spark, sf_dir))


@query
def expand_frontier(spark, sf_dir):
    """Every query's next node joined with its record: all its neighbours."""
    frontier = held_out(spark, sf_dir).select("qid", (F.col("qid") + 1).alias("src"))
    return frontier.join(edges(spark, sf_dir), "src").select("qid", "src", "dst", "rk")


@query
def neighbor_codes(spark, sf_dir):
    near = edges(spark, sf_dir).join(pq.encode(everything(spark, sf_dir), model(spark, sf_dir)), F.col("dst") == F.col("vec_id"))
    return near.select("src", "dst", F.element_at("code", 1).cast("int").alias("first_code"), F.aggregate("code", F.lit(0), lambda t, c: t + c.cast("int")).cast("bigint").alias("total"))


@query
def unvisited_anti(spark, sf_dir):
    all_edges = edges(spark, sf_dir)
    seen = all_edges.filter(F.col("src") == ENTRY).select("dst")
    return all_edges.join(seen, "dst", "left_anti").select("src", "dst")


@query
def beam_union(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.filter("src = 1").select("dst").union(e.filter("src = 2").select("dst")).distinct()


@query
def sort_neighbors(spark, sf_dir):
    rows = everything(spark, sf_dir)
    near = edges(spark, sf_dir).join(rows.select(F.col("vec_id").alias("src"), F.col("v").alias("qv")), "src").join(rows.select(F.col("vec_id").alias("dst"), "v"), "dst")
    listed = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.round(D.l2(qv, v), DIGITS).alias("dist"), "dst"))).alias("l"))
    return listed.select("src", F.posexplode("l").alias("pos", "x")).select("src", "pos", "x.dst", "x.dist")


def _ranked(spark, sf_dir, low: int, high: int) -> DataFrame:
    near = knn.exact_knn(held_out(spark, sf_dir), everything(spark, sf_dir), high, skip_self=True)
    return near.filter(F.col("rk") > low).groupBy("qid").agg(F.collect_list(F.struct(F.round("dist", 9).alias("d"), F.col("vec_id").alias("id"))).alias("b"))


@query
def beam_merge(spark, sf_dir):
    a, b = _ranked(spark, sf_dir, 4, 16), _ranked(spark, sf_dir, 0, 8).withColumnRenamed("b", "fresh")
    merged = a.join(b, "qid").select("qid", F.posexplode(beam.merge_beam(F.col("b"), F.col("fresh"), 12)).alias("pos", "x"))
    return merged.select("qid", "pos", F.col("x.id").alias("vec_id"))


def _prepared(spark, sf_dir):
    rows, m = corpus(spark, sf_dir), model(spark, sf_dir, corpus)
    codes = cut(pq.encode(rows, m))
    entries = held_out(spark, sf_dir).select("qid", F.lit(ENTRY).cast("bigint").alias("entry"))
    return rows, m, codes, entries, edges(spark, sf_dir, corpus)


@query
def beam_round(spark, sf_dir):
    rows, m, codes, entries, links = _prepared(spark, sf_dir)
    state = beam.start_state(pq.lookup_tables(held_out(spark, sf_dir), m), entries)
    state = beam.beam_round(state, beam.search_graph(links, rows, codes), EF, K)
    return state.select("qid", F.posexplode("beam").alias("pos", "x")).select("qid", "pos", F.col("x.id").alias("vec_id"), r6(F.col("x.d"), "dist"))


@query
def beam_search(spark, sf_dir):
    rows, m, codes, entries, links = _prepared(spark, sf_dir)
    tables = pq.lookup_tables(held_out(spark, sf_dir), m)
    return rounded(beam.beam_search(tables, entries, beam.search_graph(links, rows, codes), EF, K))


def _searched(spark, sf_dir, **more) -> DataFrame:
    rows, m, codes, entries, links = _prepared(spark, sf_dir)
    return beam.exchange_search(held_out(spark, sf_dir), m, entries, beam.search_graph(links, rows, codes), EF, K, SHARDS, **more)


@query
def beam_search_exchange(spark, sf_dir):
    """The same search of one graph, whose nodes are dealt to shards that hand searches over."""
    return rounded(_searched(spark, sf_dir))


@query
def search_trace(spark, sf_dir):
    """The nodes that each search expands, round by round."""
    return _searched(spark, sf_dir, trace=True)


@query
def beam_search_batch(spark, sf_dir):
    rows, m, codes, _, links = _prepared(spark, sf_dir)
    return rounded(beam.beam_search_batch(held_out(spark, sf_dir), m, ENTRY, links, rows, codes, EF, K))


@query
def beam_recall(spark, sf_dir):
    found = beam_search_batch(spark, sf_dir)
    return knn.recall(found, knn.exact_knn(held_out(spark, sf_dir), corpus(spark, sf_dir), K), K).select(r6(F.col("recall"), "recall"))


@query
def search_stats(spark, sf_dir):
    spent = beam_search_batch(spark, sf_dir).select("qid", "n_expanded").distinct()
    return spent.agg(F.sum("n_expanded").alias("expanded"), F.max("n_expanded").alias("most"), F.count("*").alias("queries"))


@query
def access_frequency(spark, sf_dir):
    """How often the rounds of the searches visit nodes."""
    return graph.access_frequency(_searched(spark, sf_dir, trace=True))


@query
def stripe_skew(spark, sf_dir):
    """Of each round of the searches, how the records that it reads are spread over the stripes of a paged index."""
    page, _ = graph.page_layout(F.col("node"), 64 * 4 + 4 + 4 * DEGREE)
    return graph.stripe_skew(_searched(spark, sf_dir, trace=True).select("round", page.alias("page")), 4).withColumn("share", F.round("share", DIGITS))


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def _paged(spark, sf_dir) -> list[str]:
    """All vectors and the edges between them as a paged index in two stripes."""
    near = graph.adjacency(edges(spark, sf_dir))
    nodes = embeddings(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")).join(near, "node", "left")
    return files.write_index(nodes, f"{_folder(spark)}/index", DEGREE, ENTRY, stripes=2)


@query
def index_file_scan(spark, sf_dir):
    """Written as a paged index and read again."""
    nodes = files.read_index(spark, _paged(spark, sf_dir))
    return nodes.select("node", F.size("nbrs").alias("degree"), F.aggregate("nbrs", F.lit(0).cast("bigint"), lambda t, n: t + n).alias("nbr_sum"), r6(D.vec_sum(D.cast_vector(F.col("vector"))), "total"))


@query
def index_node_read(spark, sf_dir):
    """Single nodes of a paged index, each from its page; ids that are not there give no row."""
    asked = spark.createDataFrame([(1,), (7,), (49,), (10**9,)], "node bigint")
    nodes = files.read_nodes(asked, _paged(spark, sf_dir))
    return nodes.select("node", F.posexplode("nbrs").alias("pos", "nbr"))


@query
def vector_file_scan(spark, sf_dir):
    """Written as fvecs files, a range of ids a file, and read again as one table from its tenth row on."""
    datasource.register(spark)
    folder = _folder(spark)
    rows = embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("vector")).repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows.write.format("vecs").option("kind", "fvecs").mode("append").save(folder)
    read = spark.read.format("vecs").option("kind", "fvecs").option("first", 10).load(folder)
    return read.select("pos", r6(D.vec_sum(D.cast_vector(F.col("vector"))), "total"))


@query
def index_search(spark, sf_dir):
    """Beam search by exact distances over an index that is built, saved and loaded."""
    index = VectorIndex.build(corpus(spark, sf_dir), DEGREE, nav=NAV).save(_folder(spark))
    return rounded(index.search(held_out(spark, sf_dir), K, EF))


@query
def stream_knn(spark, sf_dir):
    """The held-out queries as a stream, answered exactly, micro-batch by micro-batch."""
    folder, asked = _folder(spark), held_out(spark, sf_dir)
    asked.repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    index = VectorIndex(everything(spark, sf_dir), edges(spark, sf_dir), ENTRY)
    search_stream(stream, index, K, EF, f"{folder}/out", f"{folder}/log", "exact").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("qid", "rk", "vec_id", "dist"))
