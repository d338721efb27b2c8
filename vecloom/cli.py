"""Command line: ``python -m vecloom.cli COMMAND``. Vector files are known by their ending."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import cast_vector, replicate
from .index import MODES, VectorIndex
from .operators import graph, knn
from .plans.scratch import cut
from .sources import index_files as files
from .sources import vecs
from .streaming.search import percentiles


class SweepRow(tuple):
    """A row of a sweep; latencies: the 50th, 90th and 99th percentile of the seconds that a batch took."""

    latencies: tuple[float, ...] = ()


def kind_of(path: str, data_type: str = "float") -> str:
    ending = path.rpartition(".")[2]
    if ending in vecs.FORMATS:
        return ending
    if ending == "bin":
        return "bbin" if data_type == "uint8" else "fbin"
    raise ValueError(f"{path}: ends in none of {', '.join(vecs.FORMATS)}, bin")


def read_queries(spark: SparkSession, path: str, data_type: str) -> DataFrame:
    return vecs.read_vectors(spark, path, kind_of(path, data_type)).select(F.col("pos").alias("qid"), cast_vector(F.col("vector")).alias("qv"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """qid, rk, vec_id of a file of ids, nearest first: ivecs, ibin, or bin (with distances)."""
    rows = vecs.read_truth(spark, path) if path.endswith(".bin") else vecs.read_vectors(spark, path, kind_of(path)).select(F.col("pos").alias("qid"), F.col("vector").alias("ids"))
    ids = rows.select("qid", F.posexplode("ids").alias("pos", "id"))
    return ids.select("qid", (F.col("pos") + 1).cast("bigint").alias("rk"), F.col("id").cast("bigint").alias("vec_id"))


def load(spark: SparkSession, a: argparse.Namespace) -> VectorIndex:
    """A folder that save() wrote, or index files if those of codes or navigation are named or --paged is."""
    if a.paged or a.pq_data or a.nav_graph:
        return VectorIndex.from_files(spark, a.index, a.pq_data, a.nav_graph, a.data_type, a.walk)
    return VectorIndex.load(spark, a.index[0])


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = vecs.read_vectors(spark, a.vectors, kind_of(a.vectors, a.data_type)).select(F.col("pos").alias("vec_id"), F.col("vector").alias("v"))
    VectorIndex.build(rows, a.degree, a.chunks, a.pivots, a.nav, a.shards, a.near).save(a.out)


def search(spark: SparkSession, a: argparse.Namespace) -> list[tuple]:
    """One row of the sweep an ef: L, seconds, queries a second, recall@k in percent (None without truth), mean seconds a batch, mean expansions,
    and as ``latencies`` the 50th, 90th and 99th percentile of the seconds that a batch took.

    Queries go in batches of --batch (all at once without it), one after another.
    """
    index, asked = load(spark, a), read_queries(spark, a.query, a.data_type)
    if min(a.ef_search) < a.topk:
        raise ValueError("every ef_search must be at least topk")
    n = asked.count()
    truth = read_ids(spark, a.ground_truth).filter(F.col("qid") < n) if a.ground_truth else None
    many = asked if a.repeat == 1 else knn.replicate_queries(asked, a.repeat)
    rows = []
    parts = max(1, -(-n * a.repeat // a.batch)) if a.batch else 1
    print(f"{'L':>6} {'Run Time':>10} {'QPS':>10} {f'Recall@{a.topk}':>12} {'Latency':>10} {'Expanded':>10} {'p50':>10} {'p90':>10} {'p99':>10}")
    for ef in a.ef_search:
        began, found, each = time.perf_counter(), None, []
        for part in range(parts):
            started = time.perf_counter()
            asked_now = many if parts == 1 else many.filter(F.pmod("qid", F.lit(parts)) == part)
            some = cut(index.search(asked_now, a.topk, ef, a.mode, a.probes).select("qid", "rk", "vec_id", "n_expanded"))
            found = some if found is None else found.unionByName(some)
            each.append(time.perf_counter() - started)
        took = time.perf_counter() - began
        spent = found.select("qid", "n_expanded").distinct().agg(F.avg("n_expanded")).first()[0]
        share = None if truth is None else 100 * knn.recall(found.filter(F.col("qid") < n), truth, a.topk).first().recall
        if a.output:
            lists = found.filter(F.col("qid") < n).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
            whole = F.transform(F.sequence(F.lit(1), F.lit(a.topk)), lambda i: F.coalesce(F.get("ids", i - 1), F.lit(-1)))  # -1: fewer than k were found
            vecs.write_vectors(lists.select("qid", whole.alias("ids")).coalesce(1), f"{a.output}/ef={ef}", "ibin", "qid", "ids").collect()
        rows.append(SweepRow((ef, took, n * a.repeat / took, share, took / parts, spent)))
        rows[-1].latencies = tails = percentiles(each)
        print(f"{ef:>6} {took:>10.3f} {n * a.repeat / took:>10.1f} {'' if share is None else f'{share:.2f}':>12} {took / parts:>10.3f} {'' if spent is None else f'{spent:.1f}':>10} {' '.join(f'{t:>10.3f}' for t in tails)}")
    return rows


def recall(spark: SparkSession, a: argparse.Namespace) -> float:
    share = knn.recall(read_ids(spark, a.result), read_ids(spark, a.ground_truth), a.topk).first().recall
    print(f"Recall@{a.topk}: {100 * share:.2f}")
    return share


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    kind = kind_of(a.vectors, a.data_type)
    rows = vecs.read_vectors(spark, a.vectors, kind).withColumnRenamed("pos", "vec_id")
    nav = graph.nav_sample(rows, a.n).persist()
    files.write_map(nav, f"{a.out}/map.txt")
    vecs.write_vectors(nav.join(rows, "vec_id").coalesce(1), a.out, kind, "nav_id").collect()


def split(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    meta = files.read_meta(a.index[0], a.data_type)
    return files.write_index(files.read_index(spark, a.index, a.data_type), a.out, meta.degree, meta.medoid, a.data_type, a.stripes)


def widen(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The index with every component of its vectors repeated; with it what --pq_data and --nav_graph name.

    Codes, the navigation graph and its map do not depend on the width and stay as they are.
    """
    meta = files.read_meta(a.index[0], a.data_type)
    nodes = files.read_index(spark, a.index, a.data_type).withColumn("vector", replicate(F.col("vector"), a.times))
    names = files.write_index(nodes, a.out, meta.degree, meta.medoid, a.data_type)
    if a.pq_data:
        names.append(f"{a.out}_pivots.bin")
        files.write_pq_model(files.read_pq_model(f"{a.pq_data}_pivots.bin").widen(a.times), names[-1])
    if a.nav_graph:
        kind = kind_of("data.bin", a.data_type)
        rows = vecs.read_vectors(spark, f"{a.nav_graph}/nav_index.data", kind).withColumn("vector", replicate(F.col("vector"), a.times))
        (written,) = vecs.write_vectors(rows.coalesce(1), f"{a.out}_nav", kind).collect()
        names.append(written.file)
    return names


def tags(spark: SparkSession, a: argparse.Namespace) -> str:
    """The ids of a map as a file of tags."""
    (written,) = files.write_tags(files.read_map(spark, a.map), a.out).collect()
    return written.file


def replicate_set(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Queries, and their truth if it is named, so many times over."""
    many = knn.replicate_queries(read_queries(spark, a.query, a.data_type), a.times)
    kind = kind_of(a.query, a.data_type)
    names = [r.file for r in vecs.write_vectors(many.coalesce(1), a.out, kind, "qid", "qv").collect()]
    if a.ground_truth:
        truth = vecs.read_truth(spark, a.ground_truth)
        n = truth.count()
        again = truth.select("*", F.explode(F.sequence(F.lit(0), F.lit(a.times - 1))).alias("r")).select((F.col("r") * n + F.col("qid")).alias("qid"), "ids", "dists")
        names += [r.file for r in vecs.write_truth(again, f"{a.out}/truth.bin").collect()]
    return names


def hops(spark: SparkSession, a: argparse.Namespace) -> list[tuple]:
    nodes = files.read_index(spark, a.index, a.data_type)
    reached = graph.bfs_hops(files.edge_list(nodes), files.read_meta(a.index[0], a.data_type).medoid, a.depth)
    asked = spark.read.text(a.ids).select(F.explode(F.split("value", r"\s+")).alias("word")).filter("word <> ''").select(F.col("word").cast("bigint").alias("vec_id")) if a.ids else nodes.select(F.col("node").alias("vec_id"))
    rows = [(r.hop, r.n) for r in graph.hop_histogram(reached, asked).orderBy(F.col("hop").asc_nulls_last()).collect()]
    for hop, n in rows:
        print(f"{'unreached' if hop is None else hop:>9} {n:>12}")
    return rows


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = vecs.read_vectors(spark, a.vectors, kind_of(a.vectors, a.data_type), a.offset, a.first, a.limit)
    if a.kind == "parquet":
        rows.write.parquet(a.out)
    else:
        vecs.write_vectors(rows.coalesce(1), a.out, a.kind).collect()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecloom")
    commands = top.add_subparsers(required=True)

    def command(f, about: str, *inputs: str) -> argparse.ArgumentParser:
        p = commands.add_parser(f.__name__, help=about)
        p.set_defaults(run=f)
        p.add_argument("--data_type", choices=sorted(files.ELEMENTS), default="float")
        for name in inputs:
            p.add_argument(f"--{name}", required=True, **({"nargs": "+"} if name == "index" else {}))
        return p

    p = command(build, "index a vector file", "vectors", "out")
    p.add_argument("--degree", type=int, default=32)
    p.add_argument("--chunks", type=int)
    p.add_argument("--pivots", type=int, default=256)
    p.add_argument("--nav", type=int)
    p.add_argument("--shards", type=int)
    p.add_argument("--near", action="store_true", help="shards go by nearness, so that a search can leave some out")
    p = command(search, "search an index, once an ef", "index", "query")
    p.add_argument("--ground_truth")
    p.add_argument("--topk", type=int, default=100)
    p.add_argument("--ef_search", type=int, nargs="+", required=True)
    p.add_argument("--paged", action="store_true", help="--index names paged files")
    p.add_argument("--pq_data", help="prefix of the quantisation files")
    p.add_argument("--nav_graph", help="folder of the navigation files")
    p.add_argument("-R", "--repeat", type=int, default=20)
    p.add_argument("-B", "--batch", type=int, help="queries a batch")
    p.add_argument("--probes", type=int, help="shards that a query searches, if they go by nearness")
    p.add_argument("--walk", action="store_true", help="walk the navigation graph instead of looking at its whole sample")
    p.add_argument("--mode", choices=MODES, help="by the size of the index, unless given")
    p.add_argument("--output", help="folder for the ids found")
    command(recall, "compare ids found with the truth", "result", "ground_truth").add_argument("--topk", type=int, required=True)
    command(sample, "sample vectors and write their ids", "vectors", "out").add_argument("--n", type=int, required=True)
    command(split, "stripe a paged index over files", "index", "out").add_argument("--stripes", type=int, required=True)
    p = command(widen, "repeat each component of an index's vectors", "index", "out")
    p.add_argument("--times", type=int, required=True)
    p.add_argument("--pq_data", help="prefix of the quantisation files")
    p.add_argument("--nav_graph", help="folder of the navigation files")
    command(tags, "write the ids of a map as tags", "map", "out")
    p = command(replicate_set, "repeat a set of queries, and its truth", "query", "out")
    p.add_argument("--times", type=int, required=True)
    p.add_argument("--ground_truth")
    p = command(hops, "count nodes by hops from the medoid", "index")
    p.add_argument("--depth", type=int, default=9)
    p.add_argument("--ids", help="text file of ids to count; all nodes without it")
    p = command(convert, "write a vector file in another format", "vectors", "out")
    p.add_argument("--kind", choices=[*vecs.FORMATS, "parquet"], required=True)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--first", type=int, default=0)
    p.add_argument("--limit", type=int)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(arguments)
    return a.run(spark or SparkSession.builder.appName("vecloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
