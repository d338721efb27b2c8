"""A searchable index: vectors, a proximity graph, and optionally codes and a navigation sample.

Vectors, graph, codes and navigation map are DataFrames and are saved as Parquet tables; only the
quantisation model (256 vectors at most) and the medoid's id are held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import cast_vector
from .operators import beam, graph, knn, pq, vamana
from .plans.scratch import cut
from .sources import index_files as files

MODES = ("batch", "loop", "exchange", "exact")


@dataclass
class VectorIndex:
    """corpus: vec_id, v; edges: src, dst, rk; codes: vec_id, code (None: distances are exact); nav: nav_id, vec_id;
    nav_edges: src, dst between nav_ids (None: all of the sample is looked at), walked from nav_start.
    shard_of: vec_id, shard and centres: shard, v, where shards go by nearness (None: by id).

    ``shards`` is what the edges were built for: each shard is searched by a task of its own. ``crossing``
    edges lead from shard to shard.
    """

    corpus: DataFrame
    edges: DataFrame
    medoid: int
    model: pq.PQModel | None = None
    codes: DataFrame | None = None
    nav: DataFrame | None = None
    shards: int = 1
    nav_edges: DataFrame | None = None
    shard_of: DataFrame | None = None
    centres: DataFrame | None = None
    nav_start: int = 0
    crossing: bool = False

    @classmethod
    def build(cls, corpus: DataFrame, degree: int = 32, chunks: int | None = None, pivots: int = 256, nav: int | None = None, shards: int | None = None, near: bool = False,
              width: int | None = None, whole: bool = False) -> VectorIndex:
        """An index of corpus (vec_id, v); vectors are quantised if ``chunks`` is given, ``nav`` is the size of the navigation sample.

        The graph is built by search (vamana), with a beam of ``width``. near: shards hold vectors that are near
        to one another, so that a search needs only some of them. whole: one graph over all shards, whose
        searches go from shard to shard (mode ``exchange``), instead of one a shard.
        """
        corpus = corpus.select("vec_id", cast_vector(F.col("v")).alias("v"))
        first = graph.medoid(corpus).first()
        if first is None:
            raise ValueError("no vectors to index")
        shards = beam.shard_count(corpus) if shards is None else shards
        model = pq.train(corpus, chunks, pivots) if chunks else None
        codes = pq.encode(corpus, model) if model else None
        shard_of = centres = None
        if near and shards > 1:
            shard_of, centres = graph.centre_shards(corpus, shards)
            shard_of = cut(shard_of)
            if shard_of.groupBy("shard").count().agg(F.max("count")).first()[0] > beam.SHARD_ROWS:
                shard_of, centres = graph.bounded_shards(corpus, beam.SHARD_ROWS)
                shards = centres.count()
        if shards == 1 or whole:
            links = vamana.vamana_graph(corpus, degree, width)
        elif shard_of is not None:
            links = vamana.vamana_graph(corpus.join(shard_of, "vec_id"), degree, width, within=F.col("shard"))
        else:
            links = vamana.vamana_graph(corpus, degree, width, within=F.pmod(F.col("vec_id"), F.lit(shards)))
        return cls(corpus, links, first.vec_id, model, codes, graph.nav_sample(corpus, nav) if nav else None, shards, None, shard_of, centres, crossing=whole and shards > 1)

    def save(self, path: str) -> VectorIndex:
        """Write the index under a folder, and return it read from there."""
        path = path.rstrip("/")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        if self.nav is not None:
            self.nav.write.mode("overwrite").parquet(f"{path}/nav")
        for name in ("nav_edges", "shard_of", "centres"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.corpus.sparkSession
        if self.model is not None:
            pivots = [(j, i, [float(x) for x in sub]) for j, table in enumerate(self.model.pivots) for i, sub in enumerate(table)]
            spark.createDataFrame(pivots, "chunk int, pivot int, sub array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
        about = (self.medoid, self.shards, self.codes is not None, self.nav is not None,
                 self.nav_edges is not None, self.centres is not None, self.nav_start, self.crossing, list(self.model.offsets) if self.model else None, [float(x) for x in self.model.centroid] if self.model else None)
        schema = "medoid bigint, shards int, has_codes boolean, has_nav boolean, has_nav_edges boolean, has_centres boolean, nav_start bigint, crossing boolean, offsets array<int>, centroid array<double>"
        spark.createDataFrame([about], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        read = lambda name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
        about, model = read("about").first(), None
        if about.offsets is not None:
            tables: list[list] = [[] for _ in about.offsets[1:]]
            for r in read("pivots").orderBy("chunk", "pivot").collect():
                tables[r.chunk].append(r["sub"])
            model = pq.PQModel(tuple(about.offsets), tuple(np.array(t) for t in tables), np.array(about.centroid))
        return cls(read("corpus"), read("edges"), about.medoid, model, read("codes") if about.has_codes else None, read("nav") if about.has_nav else None, about.shards,
                   read("nav_edges") if about.has_nav_edges else None, read("shard_of") if about.has_centres else None, read("centres") if about.has_centres else None, about.nav_start, about.crossing)

    @classmethod
    def from_files(cls, spark: SparkSession, index: str | list[str], pq_prefix: str | None = None, nav_prefix: str | None = None, element: str = "float", walk: bool = False) -> VectorIndex:
        """An index of files: pages, ``<prefix>_pivots.bin`` and ``<prefix>_compressed.bin``, ``<prefix>/map.txt``.

        walk: entries are found by a walk of ``<prefix>/nav_index``, from the node that its header names, instead of a
        look at the whole sample.
        """
        names = [index] if isinstance(index, str) else list(index)
        nodes = files.read_index(spark, names, element)
        model = files.read_pq_model(f"{pq_prefix}_pivots.bin") if pq_prefix else None
        codes = files.read_codes(spark, f"{pq_prefix}_compressed.bin") if pq_prefix else None
        nav = files.read_map(spark, f"{nav_prefix}/map.txt") if nav_prefix else None
        links, start = None, 0
        if nav_prefix and walk:
            start = files.read_nav_start(f"{nav_prefix}/nav_index")
            graph_rows = files.read_nav_graph(spark, f"{nav_prefix}/nav_index")
            links = graph_rows.select(F.col("nav_id").alias("src"), F.explode("nbrs").alias("dst"))
        corpus = nodes.select(F.col("node").alias("vec_id"), cast_vector(F.col("vector")).alias("v"))
        return cls(corpus, files.edge_list(nodes), files.read_meta(names[0], element).medoid, model, codes, nav, nav_edges=links, nav_start=start)

    def to_files(self, index: str, degree: int, element: str = "float", stripes: int = 1) -> list[str]:
        """Write vectors and graph as a paged index; ids must run from 0 without gaps."""
        near = graph.adjacency(self.edges).withColumnRenamed("node", "vec_id")
        nodes = self.corpus.join(near, "vec_id", "left").select(F.col("vec_id").alias("node"), F.col("v").alias("vector"), "nbrs")
        return files.write_index(nodes, index, degree, self.medoid, element, stripes)

    def entries(self, queries: DataFrame) -> DataFrame:
        """qid, entry: the nearest vector of the navigation sample, or the medoid without one.

        With the sample's graph (nav_edges) it is the nearest that a walk from its start node meets.
        """
        if self.nav is not None and self.nav_edges is not None:
            rows = self.nav.join(self.corpus, "vec_id").select(F.col("nav_id").alias("vec_id"), "v")
            return beam.nav_walk(queries, rows, self.nav_edges, self.nav_start).join(self.nav, "nav_id").select("qid", F.col("vec_id").alias("entry"))
        if self.nav is None:
            return queries.select("qid", F.lit(self.medoid).cast("bigint").alias("entry"))
        return beam.nav_entry(queries, self.nav, self.corpus).select("qid", "entry")

    def probes(self, queries: DataFrame, n: int | None) -> DataFrame | None:
        """qid, shards: the shards with the n nearest centres."""
        if n is None or self.centres is None:
            return None
        near = knn.exact_knn(queries, self.centres.select(F.col("shard").alias("vec_id"), "v"), min(n, self.centres.count()))
        return near.groupBy("qid").agg(F.sort_array(F.collect_list("vec_id")).alias("shards"))

    def search(self, queries: DataFrame, k: int, ef: int, mode: str | None = None, probes: int | None = None) -> DataFrame:
        """qid, rk, vec_id, dist, n_expanded of queries (qid, qv), qid being unique.

        ``batch`` searches each shard in a task, ``loop`` advances all queries a step at a time over the
        whole graph, ``exchange`` does so in the shards, which hand over what goes on elsewhere, ``exact``
        looks at every vector (n_expanded is null then). Without a mode an index of several shards is
        searched shard by shard, or by exchange where edges cross shards. One of a single shard is searched
        in a task or, if it is larger than a task may hold, in the loop: all but exact give the same rows
        then. probes: so many shards a query, those with the nearest centres, where shards go by nearness;
        all of them without it.
        """
        mode = mode or ("exchange" if self.crossing else "batch" if self.shards > 1 or beam.shard_count(self.corpus) == 1 else "loop")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        queries = queries.select("qid", cast_vector(F.col("qv")).alias("qv"))
        if mode == "exact":
            return knn.exact_knn(queries, self.corpus, k).withColumn("n_expanded", F.lit(None).cast("bigint"))
        if mode == "batch":
            return beam.beam_search_batch(queries, self.model, self.entries(queries), self.edges, self.corpus, self.codes, ef, k, self.shards, self.shard_of, self.probes(queries, probes))
        if mode == "exchange":
            shards = self.shards if self.shards > 1 else None
            return beam.exchange_search(queries, self.model, self.entries(queries), beam.search_graph(self.edges, self.corpus, self.codes), ef, k, shards, self.shard_of)
        tables = queries.withColumn("lut", F.expr("cast(null as array<array<double>>)")) if self.model is None else pq.lookup_tables(queries, self.model)
        return beam.beam_search(tables, self.entries(queries), beam.search_graph(self.edges, self.corpus, self.codes), ef, k)
