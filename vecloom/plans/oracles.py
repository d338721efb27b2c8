"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

_C = "c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: The corpus without the queries, where recall is claimed.
_H = "c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 25 <> 0)"
_T = "c AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)"
_Q = "q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 25 = 0)"


def _l2(a: str, b: str) -> str:
    return f"pow(list_distance({a}, {b}), 2)"


_P = f"p AS (SELECT qid, vec_id, qv, v, {_l2('qv', 'v')} AS d FROM q, c)"
_N = "n AS (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rk FROM p WHERE vec_id <> qid)"
_E = f"""e0 AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_l2('a.v', 'b.v')}, b.vec_id) AS rk
  FROM c a, c b WHERE a.vec_id <> b.vec_id), e AS MATERIALIZED (SELECT * FROM e0 WHERE rk <= 12)"""
_PIV = "piv AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pv, v FROM c ORDER BY vec_id LIMIT 32), ch AS (SELECT range AS chunk FROM range(16))"
_SUB = "pow(list_distance({a}[chunk * 4 + 1 : chunk * 4 + 4], {b}[chunk * 4 + 1 : chunk * 4 + 4]), 2)"
_LUT = f"lut AS (SELECT qid, chunk, pv, {_SUB.format(a='qv', b='piv.v')} AS d FROM q, piv, ch)"
_CODE = f"""code AS (SELECT vec_id, chunk, pv FROM (SELECT vec_id, chunk, pv,
  row_number() OVER (PARTITION BY vec_id, chunk ORDER BY {_SUB.format(a='c.v', b='piv.v')}, pv) AS n FROM c, piv, ch) WHERE n = 1)"""
_ADC = "adc AS (SELECT qid, vec_id, round(sum(d), 9) AS d FROM code JOIN lut USING (chunk, pv) GROUP BY 1, 2)"
_NAV = "nav AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS nav_id, vec_id, v FROM c ORDER BY 1 LIMIT 32)"
#: Beam search: a query's distances from codes by place of the node, a state (beam, expanded nodes, next node) a round.
_BEAM = """seq AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM c),
dl AS MATERIALIZED (SELECT qid, list(round(d, 9) ORDER BY vec_id) AS dl FROM adc GROUP BY qid),
nb AS MATERIALIZED (SELECT src, list({{'id': dst, 'p': place}} ORDER BY rk) AS nb FROM e JOIN seq ON dst = vec_id GROUP BY src),
s(qid, beam, vis, u) AS (
  SELECT qid, CAST([] AS STRUCT(d DOUBLE, id BIGINT)[]), [CAST({start} AS BIGINT)], CAST({start} AS BIGINT) FROM q
  UNION ALL
  SELECT qid, beam, list_append(vis, u), u FROM (
    SELECT qid, vis, beam, list_filter(beam, lambda b: NOT list_contains(vis, b.id))[1].id AS u FROM (
      SELECT s.qid, s.vis, list_slice(list_sort(list_distinct(list_concat(s.beam, list_transform(list_filter(nb.nb, lambda x: NOT list_contains(s.vis, x.id)),
        lambda x: {{'d': dl.dl[x.p], 'id': x.id}})))), 1, {ef}) AS beam
      FROM s JOIN nb ON nb.src = s.u JOIN dl ON dl.qid = s.qid))
  WHERE u IS NOT NULL),
l AS (SELECT qid, max(len(vis)) AS n_expanded, arg_max(vis, len(vis)) AS vis FROM s GROUP BY qid),
x AS (SELECT qid, n_expanded, unnest(vis) AS vec_id FROM l),
f AS (SELECT x.qid, x.vec_id, n_expanded, round({l2}, 9) AS d FROM x JOIN q ON q.qid = x.qid JOIN c ON c.vec_id = x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rk FROM f)"""
_SEARCH = "WITH RECURSIVE " + ", ".join((_H, _Q, _PIV, _LUT, _CODE, _ADC, _E)) + ", " + _BEAM.format(ef=20, start=1, l2=_l2("qv", "v"))
#: The same over the navigation graph, by exact distances.
_WALK_FROM = f"""WITH RECURSIVE a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {_Q}, {_NAV.replace(' FROM c ', ' FROM a ')},
c AS (SELECT nav_id AS vec_id, v FROM nav), adc AS (SELECT qid, vec_id, {_l2('qv', 'v')} AS d FROM q, c),
e AS (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_l2('a.v', 'b.v')}, b.vec_id) AS rk
  FROM c a, c b WHERE a.vec_id <> b.vec_id) WHERE rk <= 8), """
_WALK = _WALK_FROM + _BEAM.format(ef=4, start=0, l2=_l2("qv", "v"))
_WALK_5 = _WALK_FROM + _BEAM.format(ef=4, start=5, l2=_l2("qv", "v"))
#: The nodes that a beam search expands, round by round.
_TRACE = _SEARCH + ", t AS (SELECT qid, unnest(range(0, len(vis))) AS round, unnest(vis) AS node FROM l)"
#: An item by Zipf's law for each draw u in [0, 1).
_ZIPF = """w AS (SELECT i, pow(CAST(i AS DOUBLE), -1.1) AS w FROM range(1, 101) t(i)),
z AS (SELECT i, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS upto FROM w),
u AS (SELECT vec_id, CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM embeddings)"""
_BFS = "RECURSIVE {c}, {e}, b(node, hop) AS (SELECT 1, 0 UNION SELECT e.dst, b.hop + 1 FROM b JOIN e ON b.node = e.src WHERE b.hop < {most})"

_PAGE = "CAST(floor({id} / 13) + 1 AS BIGINT)"

ORACLES = {
    "scan_vectors": f"WITH {_C} SELECT vec_id, CAST(len(v) AS INTEGER) AS dims, round(list_sum(v), 6) AS total FROM c",
    "point_lookup": "SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (1, 7, 49)",
    "l2_distance": f"WITH {_C}, {_Q}, {_P} SELECT qid, vec_id, round(d, 6) AS dist FROM p",
    "inner_product": f"WITH {_C}, {_Q} SELECT qid, vec_id, round(list_dot_product(qv, v), 6) AS sim FROM q, c",
    "cosine_similarity": f"WITH {_C}, {_Q} SELECT qid, vec_id, round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)) + 1e-6), 6) AS sim FROM q, c",
    "cosine_distance": f"WITH {_C}, {_Q} SELECT qid, vec_id, round(1 - list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)) + 1e-6), 6) AS dist FROM q, c",
    "cast_vector": "SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(floor(embedding[i + 1] * 255) AS DOUBLE) AS x FROM embeddings, range(64) r(i)",
    "center_vectors": f"""WITH {_C}, d AS (SELECT vec_id, i, v[i + 1] AS x FROM c, range(64) r(i)), m AS (SELECT i, avg(x) AS mean FROM d GROUP BY i)
SELECT vec_id, round(sum((x - mean) * (x - mean)), 6) AS norm2, round(max(CASE WHEN i = 0 THEN x - mean END), 6) AS first FROM d JOIN m USING (i) GROUP BY vec_id""",
    "pq_chunks": f"WITH {_C}, {_PIV} SELECT vec_id, CAST(chunk AS INTEGER) AS chunk, round(list_sum(v[chunk * 4 + 1 : chunk * 4 + 4]), 6) AS total FROM c, ch",
    "pq_lut": f"WITH {_C}, {_Q}, {_PIV}, {_LUT} SELECT qid, CAST(chunk AS INTEGER) AS chunk, CAST(pv AS INTEGER) AS \"pivot\", round(d, 6) AS dist FROM lut",
    "pq_encode": f"WITH {_C}, {_PIV}, {_CODE} SELECT vec_id, CAST(chunk AS INTEGER) AS chunk, CAST(pv AS INTEGER) AS \"pivot\" FROM code",
    "pq_adc": f"WITH {_C}, {_Q}, {_PIV}, {_LUT}, {_CODE}, {_ADC} SELECT qid, vec_id, round(d, 6) AS dist FROM adc",
    "adc_neighbors": f"WITH {_C}, {_Q}, {_PIV}, {_LUT}, {_CODE}, {_ADC}, {_E} SELECT qid, src, dst, round(d, 6) AS dist FROM e JOIN adc ON adc.vec_id = e.dst",
    "pq_rerank": f"""WITH {_C}, {_Q}, {_PIV}, {_LUT}, {_CODE}, {_ADC},
t AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(d, 6), vec_id) AS n FROM adc),
x AS (SELECT t.qid, t.vec_id, {_l2('qv', 'v')} AS d FROM t JOIN q ON t.qid = q.qid JOIN c ON t.vec_id = c.vec_id WHERE n <= 50),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rk FROM x)
SELECT qid, rk, vec_id, round(d, 6) AS dist FROM y WHERE rk <= 10""",
    "page_layout": f"SELECT vec_id, {_PAGE.format(id='vec_id')} AS page, CAST(vec_id % 13 * 308 AS BIGINT) AS byte_offset FROM embeddings",
    "shard_assign": "SELECT vec_id, vec_id % 4 AS shard, CAST(floor(vec_id / 4) AS BIGINT) AS place FROM embeddings",
    "replicate_dims": f"WITH {_C} SELECT vec_id, CAST(3 * len(v) AS INTEGER) AS dims, round(3 * list_sum(v), 6) AS total, round(v[2], 6) AS fourth FROM c",
    "replicate_queries": f"""WITH {_Q}, i AS (SELECT qv, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM q)
SELECT CAST(r * n + i AS BIGINT) AS qid, round(qv[1], 6) AS first FROM i, range(3) t(r)""",
    "exact_knn": f"WITH {_C}, {_Q}, {_P}, {_N} SELECT qid, rk, vec_id, round(d, 6) AS dist FROM n WHERE rk <= 10",
    "knn_ties": f"WITH {_T}, {_Q}, {_P}, {_N} SELECT qid, rk, vec_id, round(d, 6) AS dist FROM n WHERE rk <= 10",
    "knn_graph_ties": f"WITH {_T}, {_E} SELECT src, dst, rk FROM e",
    "exact_knn_lateral": f"WITH {_C}, {_Q}, {_P}, {_N} SELECT qid, vec_id, round(d, 6) AS dist FROM n WHERE rk <= 10",
    "topk_per_query": f"""WITH {_C}, {_Q}, s AS (SELECT qid, vec_id, list_dot_product(qv, v) AS s FROM q, c WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rk FROM s) SELECT qid, rk, vec_id, round(s, 6) AS sim FROM r WHERE rk <= 10""",
    "radius_search": f"WITH {_C}, {_Q}, {_P} SELECT qid, vec_id, round(d, 6) AS dist FROM p WHERE d <= 1.5 AND vec_id <> qid",
    "filtered_knn": f"""WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 3), {_Q}, {_P}, {_N}
SELECT qid, rk, vec_id, round(d, 6) AS dist FROM n WHERE rk <= 10""",
    "found_cnt": f"WITH {_C}, {_Q}, {_P} SELECT qid, count(CASE WHEN d <= 1.5 AND vec_id <> qid THEN 1 END) AS found FROM p GROUP BY qid",
    "dist_percentiles": f"WITH {_C}, {_Q}, {_P} SELECT round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99 FROM p",
    "recall_at_k": f"""WITH {_H}, {_Q}, {_P}, {_N},
h AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY pow(list_distance(qv[1:32], v[1:32]), 2), vec_id) AS rk FROM p)
SELECT round((SELECT count(*) FROM n JOIN h USING (qid, vec_id) WHERE n.rk <= 10 AND h.rk <= 10) / ((SELECT count(*) FROM q) * 10.0::DOUBLE), 6) AS recall""",
    "knn_graph": f"WITH {_C}, {_E} SELECT src, dst, rk FROM e",
    "nav_sample": f"WITH {_C}, {_NAV} SELECT nav_id, vec_id FROM nav",
    "nav_graph": f"""WITH {_C}, {_NAV}, x AS (SELECT a.nav_id AS src, b.nav_id AS dst,
  row_number() OVER (PARTITION BY a.nav_id ORDER BY {_l2('a.v', 'b.v')}, b.nav_id) AS rk FROM nav a, nav b WHERE a.nav_id <> b.nav_id) SELECT * FROM x WHERE rk <= 8""",
    "nav_entry": f"""WITH {_C}, {_Q}, {_NAV}, x AS (SELECT qid, nav_id, vec_id, round({_l2('qv', 'nav.v')}, 9) AS d FROM q, nav),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nav_id) AS n FROM x) SELECT qid, nav_id, vec_id AS entry, round(d, 6) AS dist FROM y WHERE n = 1""",
    "nav_walk": _WALK + " SELECT qid, nav_id, nav.vec_id AS entry, round(d, 6) AS dist FROM r JOIN nav ON nav_id = r.vec_id WHERE rk = 1",
    "nav_walk_start": _WALK_5 + " SELECT qid, nav_id, nav.vec_id AS entry, round(d, 6) AS dist FROM r JOIN nav ON nav_id = r.vec_id WHERE rk = 1",
    "vamana_reach": "SELECT count(*) AS nodes, count(*) AS reached FROM embeddings",
    "nav_translate": f"WITH {_C}, {_Q}, {_NAV} SELECT qid, nav_id, nav.vec_id AS entry FROM q JOIN nav ON qid % 32 = nav_id",
    "centroid": f"WITH {_C} SELECT CAST(i AS INTEGER) AS i, round(avg(v[i + 1]), 6) AS x FROM c, range(64) r(i) GROUP BY i",
    "medoid": f"""WITH {_C}, m AS (SELECT i, avg(v[i + 1]) AS mean FROM c, range(64) r(i) GROUP BY i), d AS (
SELECT vec_id, sum(pow(v[i + 1] - mean, 2)) AS d FROM c, m GROUP BY vec_id) SELECT vec_id, round(d, 6) AS dist FROM d ORDER BY d, vec_id LIMIT 1""",
    "degree_stats": f"""WITH {_C}, {_E}, g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT min(n) AS min_degree, max(n) AS max_degree, round(avg(n), 6) AS avg_degree, count(*) AS nodes FROM g""",
    "dangling_edges": f"WITH {_C}, {_E} SELECT src, dst FROM e WHERE dst % 10 = 1",
    "bfs_hops": f"WITH {_BFS.format(c=_C, e=_E, most=9)} SELECT CAST(node AS BIGINT) AS node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY node",
    "hop_histogram": f"""WITH {_BFS.format(c=_C, e=_E, most=9)}, h AS (SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY node)
SELECT hop, count(*) AS n FROM c LEFT JOIN h ON c.vec_id = h.node GROUP BY hop""",
    "expand_frontier": f"WITH {_C}, {_Q}, {_E} SELECT qid, src, dst, rk FROM q JOIN e ON qid + 1 = src",
    "neighbor_codes": f"""WITH {_C}, {_PIV}, {_CODE}, {_E}, s AS (SELECT vec_id, CAST(sum(pv) AS BIGINT) AS total, max(CASE WHEN chunk = 0 THEN pv END) AS f FROM code GROUP BY vec_id)
SELECT src, dst, CAST(f AS INTEGER) AS first_code, total FROM e JOIN s ON e.dst = s.vec_id""",
    "unvisited_anti": f"WITH {_C}, {_E}, seen AS MATERIALIZED (SELECT DISTINCT dst AS node FROM e WHERE src = 1) SELECT src, dst FROM e LEFT JOIN seen ON dst = node WHERE node IS NULL",
    "beam_union": f"WITH {_C}, {_E} SELECT dst FROM e WHERE src = 1 UNION SELECT dst FROM e WHERE src = 2",
    "sort_neighbors": f"""WITH {_C}, {_E}, s AS (SELECT src, dst, round({_l2('a.v', 'b.v')}, 6) AS dist FROM e JOIN c a ON a.vec_id = src JOIN c b ON b.vec_id = dst)
SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS INTEGER) AS pos, dst, dist FROM s""",
    "beam_merge": f"""WITH {_C}, {_Q}, {_P}, {_N} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) - 1 AS INTEGER) AS pos, vec_id
FROM n WHERE rk <= 16 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) <= 12""",
    "beam_search": _SEARCH + " SELECT qid, rk, vec_id, round(d, 6) AS dist, n_expanded FROM r WHERE rk <= 10",
    "beam_search_exchange": _SEARCH + " SELECT qid, rk, vec_id, round(d, 6) AS dist, n_expanded FROM r WHERE rk <= 10",
    "search_trace": _TRACE + " SELECT qid, round, node FROM t",
    "beam_search_batch": _SEARCH + " SELECT qid, rk, vec_id, round(d, 6) AS dist, n_expanded FROM r WHERE rk <= 10",
    "beam_recall": _SEARCH + f""", {_P}, {_N} SELECT round((SELECT count(*) FROM n JOIN r USING (qid, vec_id) WHERE n.rk <= 10 AND r.rk <= 10)
  / ((SELECT count(*) FROM q) * 10.0::DOUBLE), 6) AS recall""",
    "search_stats": _SEARCH + " SELECT CAST(sum(n_expanded) AS BIGINT) AS expanded, max(n_expanded) AS most, count(*) AS queries FROM l",
    "zipf_draws": f"WITH {_ZIPF} SELECT vec_id, CAST((SELECT min(i) FROM z WHERE z.upto > u.u) AS INTEGER) AS item FROM u",
    "beam_round": f"""WITH {_H}, {_Q}, {_PIV}, {_LUT}, {_CODE}, {_ADC}, {_E},
x AS (SELECT adc.qid, adc.vec_id, adc.d, row_number() OVER (PARTITION BY adc.qid ORDER BY d, vec_id) - 1 AS pos FROM e JOIN adc ON adc.vec_id = e.dst WHERE e.src = 1)
SELECT qid, CAST(pos AS INTEGER) AS pos, vec_id, round(d, 6) AS dist FROM x""",
    "access_frequency": _TRACE + ", g AS (SELECT round, node, count(*) AS n FROM t GROUP BY 1, 2) SELECT round, count(*) AS nodes, max(n) AS most, "
    + ", ".join(f"quantile_cont(n, {i / 10}) AS p{i * 10}" for i in range(1, 10)) + " FROM g GROUP BY round",
    "stripe_skew": _TRACE + f", d AS (SELECT round, {_PAGE.format(id='node')} % 4 AS device, count(*) AS reads FROM t GROUP BY 1, 2) "
    "SELECT round, device, reads, round(reads / CAST(sum(reads) OVER (PARTITION BY round) AS DOUBLE), 6) AS share FROM d",
    "index_file_scan": f"""WITH {_C}, {_E}, g AS (SELECT src, count(*) AS n, sum(dst) AS t FROM e GROUP BY src)
SELECT vec_id AS node, CAST(coalesce(n, 0) AS INTEGER) AS degree, CAST(coalesce(t, 0) AS BIGINT) AS nbr_sum, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings LEFT JOIN g ON vec_id = src""",
    "index_node_read": f"WITH {_C}, {_E} SELECT src AS node, CAST(rk - 1 AS INTEGER) AS pos, dst AS nbr FROM e WHERE src IN (1, 7, 49)",
    "vector_file_scan": "SELECT vec_id AS pos, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id >= 10",
    "stream_knn": f"WITH {_C}, {_Q}, {_P}, n AS (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rk FROM p) SELECT qid, rk, vec_id, round(d, 6) AS dist FROM n WHERE rk <= 10",
}
