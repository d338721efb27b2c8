"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, license_scan, mixing, packing, pii, sharding, simhash, substring_dedup, topk, toxicity, trie, whitening
from ._common import cut, documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_licenses", F.array_join("families", ",").alias("families"), F.round("probability", 4).alias("probability"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(*mixing.with_row_key(documents(spark, sf_dir)))
    position = F.try_element_at("takes", F.lit(1))["position"]
    out = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round(position, 9).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_conversations(turns.unionByName(extra))
    turn = F.transform(chat.read_back(F.col("formatted")), lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    read = done.select("conv_id", "formatted", turn.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(documents(spark, sf_dir), readers=sharding.READERS)
    return out.select(F.col("id").alias("doc_id"), "bytes", "shard", F.col("local_depth").cast("int").alias("local_depth"), "shard_bytes", "shard_docs")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), TOKENIZER, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(documents(spark, sf_dir))
    kind = F.array(*map(F.lit, pii.KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(k).eqNullSafe)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts[:4], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *counts[4:])


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    base = own.select(F.col("conv_id").alias("base"), F.col("ids").alias("base_ids"), F.col("bytes").alias("base_bytes"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9)).cast("int")
    rebuilt = lambda c: F.concat(F.coalesce(F.slice(f"base_{c}", F.lit(1), h), F.array().cast("array<bigint>")), F.slice(c, h + 1, F.size(c))).alias(c)
    both = own.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    return trie.trie_nodes(cut(both.select("conv_id", rebuilt("ids"), rebuilt("bytes"))))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_mix_sources, op3_exact_top_k, op4_simhash_dedup, op5_toxicity,
    op6_exact_dedup, op7_chat_format, op8_shard, op9_pack, op10_personal_data, op11_substring_dedup, op12_whitening, op13_prefix_trie)}

_SIZE = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def _inverse(y: str, knots) -> str:
    """mixing.inverse_demand() in SQL."""
    cases = []
    for before, start, weight, slope in reversed(mixing.segments(knots)):
        d = f"({y} - {before!r}::DOUBLE)"
        root = f"sqrt(greatest(0.0::DOUBLE, {weight * weight!r}::DOUBLE + {2 * slope!r}::DOUBLE * {d}))"
        cases.append(f"WHEN {y} >= {before!r}::DOUBLE THEN {start!r}::DOUBLE + CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {d} / ({weight!r}::DOUBLE + {root}) END")
    return f"CASE {' '.join(cases)} END"


_POSITION = "CASE " + " ".join(f"WHEN (rnk - 1) % 3 = {i} THEN {_inverse('y', k)}" for i, k in enumerate(mixing.SCHEDULES)) + " END"

ORACLES = {
    "op2_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src, {_SIZE} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY no_source, src) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM r),
f AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
     - coalesce(sum(most) OVER (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(weight) OVER (ORDER BY full_at, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM f),
m AS (SELECT *, max(CASE WHEN full_at > lvl THEN lvl END) OVER () AS top FROM l),
t AS (SELECT *, CASE WHEN top IS NULL THEN most ELSE least(most, top * weight) END AS target FROM m),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.no_source, d.src ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at
  FROM d JOIN t ON d.no_source = t.no_source AND d.src = t.src),
k AS (
  SELECT *, greatest(0, least(size, demand - begin_at)) AS once, greatest(0, least(size, demand - begin_at - source_size)) AS twice,
    CAST(begin_at AS DOUBLE) / nullif(demand, 0) AS y FROM c)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN round({_POSITION}, 9) END AS position
FROM k""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM a q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)""",
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
          + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS n FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id, lone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op8_shard": f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits FROM documents),
m AS (SELECT least({sharding.SHARD_BYTES}, CAST(floor(sum(bytes) / {sharding.READERS}) AS BIGINT)) AS most FROM d),
p AS (SELECT doc_id, CAST(l AS INTEGER) AS local_depth, bits >> (60 - l) AS bucket, bytes FROM d, range(0, 21) r(l)),
s AS (SELECT local_depth, bucket, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY 1, 2),
b AS (
  SELECT p.doc_id, p.bytes, p.local_depth, p.bucket, s.shard_bytes, s.shard_docs, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.local_depth) AS n
  FROM p JOIN s ON p.local_depth = s.local_depth AND p.bucket = s.bucket, m WHERE s.shard_bytes <= m.most OR s.shard_docs = 1)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN local_depth = 0 THEN '' ELSE lpad(format('{{:b}}', bucket), local_depth, '0') END AS shard, local_depth, shard_bytes, shard_docs
FROM b WHERE n = 1""",
    "op11_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
x AS (SELECT w.r, w.i FROM w JOIN f ON w.h = f.h WHERE f.first < w.doc_id OR (w.doc_id IS NULL AND f.first IS NOT NULL)),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
c AS (
  SELECT p.r, p.i, p.word, max(x.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN x ON x.r = p.r AND x.i = p.i),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS id, CAST(octet_length(encode(text)) AS BIGINT) AS b FROM t),
o AS (SELECT conv_id, list(struct_pack(i := id, b := b) ORDER BY turn NULLS FIRST, id) AS turns FROM k GROUP BY conv_id),
c AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, xor(list_reduce(
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(o.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns FROM c LEFT JOIN o ON o.conv_id = c.base),
p AS (SELECT conv_id, d, list_slice(turns, 1, d) AS pre, len(turns) = d AS is_end FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '') AS ends
  FROM p GROUP BY pre, d),
k2 AS (SELECT list_slice(pre, 1, d - 1) AS above, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(k2.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * pre[d].b ELSE 0 END AS own FROM n LEFT JOIN k2 ON n.pre = k2.above),
s AS (
  SELECT list_slice(pre, 1, a) AS above, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.above = w.pre LEFT JOIN n u ON w.d > 0 AND u.pre = list_slice(w.pre, 1, w.d - 1)""",
}
