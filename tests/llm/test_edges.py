"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom.llm import chat, exact_dedup, license_scan, mixing, packing, pii, sharding, simhash, topk, toxicity
from vecloom.llm._common import with_row_key
from vecloom.llm.queries import TOKENIZER

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id string, `_row` int, size string, kept string, score string, take string, bucket int"
LONG = "word1 other-word2 " * 30_000


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, "x", "y", 1, "z", "k", "s", "t", 2)


ROWS = [
    row(1, "one  two\tthree"), row(2, "one two three"), row(2, "one two three"), row(3, None), row(4, ""), row(None, "one two three"),
    row(None, None, None), row(5, "a b"), row(6, LONG, None), row(7, "idiot 1d10t\nAll rights reserved. a.b@c.de 1.2.3.4 +1 (499) 555-6503", "b"), row(8, " \t\n")]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_exact_dedup(nasty, empty):
    out = exact_dedup.exact_dedup(nasty).collect()
    assert len(out) == len(ROWS)
    same = [r for r in out if r.group_size == 5 - 1]
    assert {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    blank = [r for r in out if r.group_size == 3]
    assert {r.keep_id for r in blank} == {3} and sum(r.kept for r in blank) == 1
    kept = exact_dedup.drop_exact_copies(nasty)
    assert kept.columns == nasty.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8]
    assert exact_dedup.exact_dedup(empty).collect() == [] and exact_dedup.drop_exact_copies(empty).collect() == []


def test_repeated_rows_without_id_keep_one(spark):
    out = exact_dedup.exact_dedup(spark.createDataFrame([(None, "x")] * 3, "doc_id bigint, text string")).collect()
    assert [r.keep_id for r in out] == [None] * 3 and sum(r.kept for r in out) == 1


def test_simhash(nasty, empty):
    out = simhash.near_dedup(nasty).collect()
    assert len(out) == len(ROWS)
    zero = [r for r in out if r.fp == 0]
    assert {r.component_id for r in zero} == {3} and len(zero) == 4 and sum(r.kept for r in zero) == 1
    assert {r.component_id for r in out if r.id in (1, 2)} == {1}
    kept = simhash.drop_near_copies(nasty)
    assert kept.columns == nasty.columns and len({r.component_id for r in out}) == kept.count()
    assert simhash.near_dedup(empty).collect() == []


def test_simhash_links_a_crowd_exactly(spark):
    """Hundreds of fingerprints within a few bits, through the path of full keys, equal brute force."""
    base, prints = 0x123456789ABCDEF0 >> 1, set()
    for i in range(40):
        for j in range(i, 40):
            prints.add(base ^ 1 << i ^ 1 << j if (i * j) % 3 else base ^ 1 << i ^ 1 << (j + 20) ^ 1 << 50)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    from vecloom.llm._graph import components

    root = {r.node: r.root for r in components(found).collect()}
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: root.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_golay_words_two_bits_apart_share_a_codeword():
    import numpy as np

    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 21, size=200):
        i, j = rng.choice(21, 2, replace=False)
        near = simhash.codewords(np.array([x, x ^ (1 << i) ^ (1 << j)]), 21)
        assert set(near[0]) & set(near[1]) and len(set(near[0])) <= 6


def test_mixing(spark, nasty, empty):
    plan = mixing.plan_mix(*with_row_key(nasty)).collect()
    assert len(plan) == len(ROWS) and all(0 <= r.taken <= 2 * r.size and r.taken == sum(t.words for t in r.takes) for r in plan)
    for source_size, target in {(r.source_size, r.target) for r in plan}:
        assert target <= 2 * source_size + 1e-9
    out = mixing.mix(nasty)
    assert out.columns == nasty.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in plan)
    assert mixing.mix(empty).collect() == [] and mixing.plan_mix(*with_row_key(empty)).collect() == []


def test_targets_equal_iterative_resharing(spark):
    sizes = {"a": 100, "b": 5000, "c": 10, "d": 900, "e": 40, "f": 3000}
    df = spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "no_source boolean, source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df, mixing.WEIGHTS, 1.5, 2.0).collect()}
    weight = dict(zip(sorted(sizes), (3, 1, 2, 3, 1, 2)))
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in sizes if s not in full}
        over = [s for s, t in rest.items() if t > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
    assert got == pytest.approx(full | rest)


def test_toxicity(spark, nasty, empty):
    model = toxicity.learn(nasty, labels(spark))
    scored = toxicity.score_toxicity(nasty, model)
    scores = {r.doc_id: r.score_ for r in scored.collect()}
    assert scored.count() == len(ROWS) and all(0 <= s <= 1 for s in scores.values())
    assert scores[7] >= 0.3 > scores[4]
    kept = toxicity.drop_toxic(nasty, labels(spark, [(None, 1, 1), (1, 1, None), (2, 1, 0)]))
    assert kept.columns == nasty.columns and kept.count() == len(ROWS) - 1
    assert toxicity.drop_toxic(empty, labels(spark)).collect() == []


@pytest.mark.parametrize("text,hit", [
    ("you 1d10t", True), ("уоu ѕtupid thing", True), ("in the trash can", False), ("trash, can", True), ("moronic", False), ("$cum!", True), ("", False)])
def test_folding_and_exceptions(text, hit):
    model = toxicity.Model({w: (4.0, True) for w in toxicity.SEEDS})
    assert bool(model.hits(*toxicity.fold(text))) is hit


def test_packing(nasty, empty):
    out = packing.pack(nasty, TOKENIZER).collect()
    assert sum(r.length for r in out if r.doc_id == 6) == [r.doc_tokens for r in out if r.doc_id == 6][0]
    assert all(len(r.ids) == r.length for r in out) and len({r.sequence_id for r in out}) == len(out)
    assert [r.ids for r in out if r.doc_id == 4] == [[1]]
    assert all(r.length == packing.LENGTH >> (r.sequence_id >> packing.BUCKET_BIT) for r in out)
    assert packing.pack(empty, TOKENIZER).collect() == []


@pytest.mark.parametrize("text", [
    "It's I'LL don'T x's's 'sS", "ÀÉÎ ß straße ÿ", "İstanbul ΣΑΣ ﬁ ½ ² µ ª", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "é ́x", "日本語 テスト 한국어", "1234 5a6 __x__ a_b", "🙂🙂 ok‍", "\x00 \x7f \x01a", "don’t “quoted”"])
def test_stretches_equal_the_tokenizer(text):
    import numpy as np
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(TOKENIZER)
    got = np.frombuffer(packing.Stretches(known).ids(text), dtype="<u4").tolist()
    assert got == known.encode(text, add_special_tokens=False).ids


def test_personal_data(nasty, empty):
    out = {r.id: r.spans for r in pii.find_personal_data(nasty).collect()}
    assert [s.kind for s in out[7]] == [0, 1, 3] and out[3] == []
    done = pii.sanitise(nasty)
    assert done.columns == nasty.columns and done.count() == len(ROWS)
    assert {r.doc_id: r.text for r in done.collect()}[7] == "idiot 1d10t\nAll rights reserved. <EMAIL> <IP> <PHONE>"
    assert pii.find_personal_data(empty).collect() == [] and pii.sanitise(empty).collect() == []


def test_revealing_words(spark):
    rows = [(i, f"note {c} from Zorblatt contact boss@corp{0}.com about {d} today") for i, (c, d) in enumerate([("red", "cars"), ("blue", "trees"), ("green", "ships"), ("pink", "maps")])]
    rows += [(100 + i, f"note of the day number about common things today {i}") for i in range(60)]
    out = {r.id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    words = {rows[i][1][s.start : s.end] for i in range(4) for s in out[i] if s.kind == 4}
    assert "Zorblatt" in words and not words & {"note", "about", "today", "red", "cars"} and all(not out[100 + i] for i in range(60))


@pytest.mark.parametrize("text", ["@a.b@c.d", "a@b c@d.e", "x.y@z.w.v@q.r", "..%@a-.b", "a@b..c", "@@a@b.c"])
def test_emails_equal_the_pattern(text):
    import re

    assert list(pii.emails(text)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_licenses(nasty, empty):
    out = {r.id: r for r in license_scan.scan_licenses(nasty).collect()}
    assert out[7].families == ["Proprietary"] and out[7].n_licenses == 1
    assert out[3].families == [] and license_scan.scan_licenses(empty).collect() == []
    assert license_scan.scan_licenses(nasty).count() == len(ROWS)


def test_sharding(nasty, empty):
    out = sharding.assign_shards(nasty, limit=100).collect()
    assert len(out) == len(ROWS)
    for shard in {r.shard for r in out}:
        mine = [r for r in out if r.shard == shard]
        assert sum(r.bytes for r in mine) == mine[0].shard_bytes and len(mine) == mine[0].shard_docs and len(shard) == mine[0].local_depth
        assert mine[0].shard_bytes <= 100 or len(mine) == 1
    assert sharding.assign_shards(empty).collect() == []


def test_shards_split_only_where_too_large(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    out = sharding.assign_shards(df, limit=4000).collect()
    bits = {r.doc_id: r.b for r in df.select("doc_id", sharding.hash_bits(F.col("doc_id").cast("string")).alias("b")).collect()}
    size = {r.id: r.bytes for r in out}

    def split(ids, depth):
        if sum(size[i] for i in ids) <= 4000 or len(ids) == 1:
            return {i: depth for i in ids}
        halves = [[i for i in ids if bits[i] >> (59 - depth) & 1 == b] for b in (0, 1)]
        return {k: v for half in halves if half for k, v in split(half, depth + 1).items()}

    want = split(list(size), 0)
    assert {r.id: r.local_depth for r in out} == want
    assert all(r.shard == format(bits[r.id] >> (60 - want[r.id]), f"0{want[r.id]}b") for r in out if want[r.id])


def test_chat(spark):
    rows = [(1, 0, "user", "a<b&amp;"), (1, 1, "assistant", None), (1, 1, "assistant", "</turn>\n<turn user>"), (None, 0, None, "x"), (None, None, "assistant", "y"), (2, 5, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(turns).select("conv_id", chat.read_back(F.col("formatted")).alias("m"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: ([(m.role, m.text) for m in r.m], r.loss) for r in out if r.conv_id is not None}
    assert got == {
        1: ([("user", "a<b&amp;"), ("assistant", ""), ("assistant", "</turn>\n<turn user>")], "</turn>\n<turn user>"), 2: ([("assistant", "")], "")}
    assert sorted((r.m[0].role, r.m[0].text, r.loss) for r in out if r.conv_id is None) == [("", "x", ""), ("assistant", "y", "y")]
    assert chat.format_conversations(turns.filter("false")).collect() == []


def test_reply_trees_rank_branches(spark):
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 9.0), (5, 3, 1.0), (6, 5, 1.0), (7, 6, None), (10, 99, 2.0), (20, 21, 1.0), (21, 20, 1.0), (22, 21, 1.0)]
    messages = spark.createDataFrame(rows, "id bigint, parent bigint, score double")
    out = sorted((r.root, r["rank"], r.leaf, r.score, r.path) for r in chat.best_paths(messages, 2).collect())
    assert out == [(1, 1, 4, 10.0, [1, 2, 4]), (1, 2, 7, 7.0, [1, 3, 5, 6, 7]), (10, 1, 10, 2.0, [10])]


def test_reply_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, 1.0) for i in range(70)]
    side = [(100 + i, 99 + i if i else 40, 0.5) for i in range(9)]
    messages = spark.createDataFrame(chain + side, "id bigint, parent bigint, score double")
    out = {r.leaf: (r["rank"], r.score, r.path) for r in chat.best_paths(messages, 2).collect()}
    assert out == {69: (1, 70.0, list(range(70))), 108: (2, 45.5, [*range(41), *range(100, 109)])}


def test_exact_dedup_over_many_partitions(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(120)]
    want = {}
    for i, text in rows:
        want.setdefault(text, []).append(i)
    for n in (1, 2, 23):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
        assert got == {i: (min(want[t]), len(want[t]), i == min(want[t])) for i, t in rows}


def test_mix_spreads_rows_without_an_id(spark):
    rows = [(None, "a", "one two three")] * 40 + [(i, "b", "four five") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    plan = mixing.plan_mix(*mixing.with_row_key(df)).collect()
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source_size, []).append(r)
    assert sorted(by_source) == [80, 120]
    for some in by_source.values():
        assert sum(r.taken for r in some) == round(some[0].target) and all(r.taken <= 2 * r.size for r in some)


def test_mix_spreads_rows_with_one_id(spark, monkeypatch):
    rows = [(7, "a", "one two three")] * 300 + [(i, "a", "four five") for i in range(100, 160)] + [(i, "b", "six") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    base, key = mixing.with_row_key(df)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    plan = mixing.plan_mix(base, key)
    got = plan.collect()
    for size in {r.source_size for r in got}:
        some = [r for r in got if r.source_size == size]
        assert sum(r.taken for r in some) == round(some[0].target) and all(r.taken <= 2 * r.size for r in some)
        starts = sorted((t.position, t["pass"], t.words) for r in some for t in r.takes)
        assert len(starts) == len({(p, n) for p, n, _ in starts})
    assert len(got) == len(rows) and [tuple(r) for r in plan.orderBy("row").collect()] == sorted((tuple(r) for r in got), key=lambda r: r[0])


def test_packing_forgets_long_stretches_and_writes_buckets(spark, tmp_path):
    known = packing.worker(TOKENIZER)
    long = "xyz" * 400
    want = known.tokenizer.encode(long, add_special_tokens=False).ids
    assert list(np.frombuffer(known.ids(long), dtype="<u4")) == want and long not in known
    packed = packing.pack(spark.createDataFrame([(1, long), (2, None)], "doc_id bigint, text string"), TOKENIZER)
    packing.write_buckets(packed, str(tmp_path / "buckets"))
    read = spark.read.parquet(str(tmp_path / "buckets"))
    assert read.filter("length != size(ids)").count() == 0
    got = [i for r in read.filter("doc_id = 1").orderBy("start").collect() for i in r.ids]
    assert got == [*want, packing.END_ID]


def test_top_k(spark):
    rows = [(0, [1.0, 0.5], 1), (50, [0.5, 1.0], 2), (1, [1.0, 1.0], 3), (2, [1.0, 1.0], 4), (3, None, 5), (4, [float("nan"), 1.0], 6), (5, [None, 1.0], 7), (6, [2.0], 8), (None, [9.0, 9.0], 9), (7, [-3.0, -3.0], 1), (8, [], 2), (2, [1.0, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()]
    want = [(0, 1, 1, 98304), (0, 2, 2, 98304), (0, 3, 2, 98304), (0, 4, 50, 65536), (0, 5, 7, -294912), (50, 1, 1, 98304), (50, 2, 2, 98304), (50, 3, 2, 98304), (50, 4, 0, 65536), (50, 5, 7, -294912)]
    assert sorted(out) == want
    assert topk.exact_top_k(df.filter("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_equals_brute_force_over_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(400, 7)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    ints = np.floor(256 * m).astype(int)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, n_lists=3, depth=5).collect()}
    for q in range(0, 400, 50):
        scores = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, scores[i]) for i in order]


def test_top_k_over_equal_vectors_equals_brute_force(spark):
    """A third of the rows share a vector, queries among them; ids repeat, with the same and with other vectors."""
    rng = np.random.default_rng(9)
    m = np.round(rng.normal(size=(90, 4)), 1)
    m[::3] = m[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(3, [float(x) for x in m[0]])] * 4 + [(50, [9.0, 9.0, 9.0, 9.0]), (1, [float(x) for x in m[0]]), (0, [float(x) for x in m[0]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    ints = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows]
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, depth=5).collect():
        got[r.query_id, r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 90, 10):
        asked = min(v for i, v in ints if i == q)
        scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in ints if i != q)[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, -s) for s, i in scores]
    assert len(got) == 45


def test_shards_split_rows_with_one_id_and_without(spark):
    rows = [(None, "x" * 50)] * 400 + [(7, "y" * 50)] * 300 + [(i, "z" * 50) for i in range(100, 300)] + [(9, "w" * 5000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), limit=2000).collect()
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(r)
    assert len(out) == len(rows) and all(sum(r.bytes for r in some) <= 2000 or len(some) == 1 for some in held.values())
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(None if i % 9 == 0 else i, "x" * (i % 50), i) for i in range(300)], "doc_id bigint, text string, shard int")
    sharding.write_shards(df, str(tmp_path / "shards"), limit=500)
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r.shard for r in read.collect()) == list(range(300))
    assert max(r.n for r in read.groupBy("shard_").agg(F.sum(F.length("text")).alias("n")).collect()) <= 500


def test_reply_trees_take_one_row_an_id(spark):
    chain = [(i, i - 1 if i else None, 1.0) for i in range(12)] * 2 + [(None, 3, 5.0), (4, 99, 0.5), (4, None, 1.0)]
    messages = spark.createDataFrame(chain, "id bigint, parent bigint, score double")
    assert chat.best_steps(messages).count() == 12
    assert [(r.leaf, r.score, r.path) for r in chat.best_paths(messages).collect()] == [(11, 12.0, list(range(12)))]


def test_chat_passes_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 1, 2, 3), (1, 1, "assistant", "b", 1, 2, 3)], "conv_id bigint, turn bigint, role string, text string, id int, n int, lone int")
    assert [r.formatted for r in chat.format_conversations(turns).collect()] == ["<turn user>a</turn>\n<turn assistant>b</turn>\n"]


@pytest.mark.parametrize("n, fan_in", [(1, 4), (5, 2), (16, 2), (17, 4), (23, 4)])
def test_rounds_follow_the_number_of_runs(spark, n, fan_in):
    rows = [(i, r, f"d{i % 9}") for i, r in enumerate([r for r in range(n) for _ in range(6)])]
    runs = spark.createDataFrame(rows, "id bigint, run int, sha string").select(
        "run", "sha", F.lit(1).alias("chars"), F.lit(1).alias("sum64"), F.struct(F.lit(False).alias("no_id"), "id").alias("best"), F.lit(1).alias("n"))
    levels = exact_dedup.merge_tree(runs, n, fan_in)
    left = [level.select("run").distinct().count() for level in levels]
    assert left[-1] == 1 and all(b == -(-a // fan_in) for a, b in zip(left, left[1:]))
    got = {r.sha: (r.best.id, r.n) for r in levels[-1].collect()}
    assert got == {f"d{j}": (min(i for i, _, s in rows if s == f"d{j}"), sum(s == f"d{j}" for _, _, s in rows)) for j in {i % 9 for i in range(len(rows))}}


def test_string_ids(spark):
    rows = [("b", "one two three", "s"), ("a", "one  two three", "s"), (None, None, None), ("c", "mail x.y@z.org", "t")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert {r.id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()}["b"] == "a"
    assert {r.id: r.component_id for r in simhash.near_dedup(df).collect()}["b"] == "a"
    assert sorted(r.doc_id or "" for r in packing.pack(df, TOKENIZER).filter("start = 0").collect()) == ["", "a", "b", "c"]
    assert {r.id for r in sharding.assign_shards(df).collect()} == {"a", "b", "c", None}
    assert {r.id for r in license_scan.scan_licenses(df).collect()} == {"a", "b", "c", None}
    assert {r.id: len(r.spans) for r in pii.find_personal_data(df).collect()}["c"] == 1
    assert mixing.mix(df).count() >= 3
    assert toxicity.drop_toxic(df, spark.createDataFrame([("a", 1)], "doc_id string, toxic int")).count() == 4
    turns = spark.createDataFrame([("x", 0, "user", "hi")], "conv_id string, turn int, role string, text string")
    assert chat.format_conversations(turns).first().conv_id == "x"
    near = spark.createDataFrame([("p", [1.0]), ("q", [2.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.exact_top_k(near, F.col("vec_id") == "p").collect()] == [("p", "q")]


@pytest.mark.parametrize("text", ["ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "ïdíöt", "id\u200biot", "i.d.i.o.t", "i d i o t", "1d1ot", "10ser", "c1own"])
def test_spellings_fold(text):
    model = toxicity.Model({w: (4.0, True) for w in toxicity.SEEDS})
    assert model.hits(*toxicity.fold(f"you {text} there")) and not model.hits(*toxicity.fold("a.b.c.d or 1 0 1 0"))


def test_scores_keep_a_column_of_that_name(nasty):
    out = toxicity.score_toxicity(nasty, toxicity.Model({"idiot": (4.0, True)}))
    assert out.columns == [*nasty.columns, "score_"] and {r.score for r in out.collect()} == {"s"}


def brute_terms(texts):
    """Revealing words by plain counting over all texts: (row, start, end)."""
    import math

    met, df, entity_df, spans = {}, {}, {}, []
    for text in texts:
        base = pii.base_spans(text)
        base += [s for s in pii.secrets(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
        spans.append(base)
        words = [w for w in pii.terms(text) if not any(a < w[1] and w[0] < b for _, a, b in base)]
        for w in {w for _, _, w in pii.terms(text)}:
            df[w] = df.get(w, 0) + 1
        here = {}
        for k, s, e in base:
            near = [w[2] for w in words if w[1] <= s][-pii.WINDOW :] + [w[2] for w in words if w[0] >= e][: pii.WINDOW]
            for name in pii.entities(k, text[s:e]):
                for w in set(near):
                    here.setdefault((name, w), []).append(tuple(near))
        for name in {n for k, s, e in base for n in pii.entities(k, text[s:e])}:
            entity_df[name] = entity_df.get(name, 0) + 1
        for pair, around in here.items():
            met.setdefault(pair, []).append(min(around, key=lambda a: pii.xxhash.xxh64_intdigest(" ".join(a)) >> 1))
    found = set()
    for (name, w), around in met.items():
        p = min(1.0, len(around) / df[w])
        n, z2 = len(set(around)) / p, pii.QUANTILE**2
        least = (p + z2 / 2 / n - pii.QUANTILE * math.sqrt(max(0.0, p * (1 - p) / n + z2 / 4 / n / n))) / (1 + z2 / n)
        if least >= pii.GENERALISE and math.log2(least * len(texts) / entity_df[name]) >= pii.LEAST_BITS:
            found.add(w)
    return {i: sorted((s, e) for s, e, w in pii.terms(t) if w in found and not any(a < e and s < b for _, a, b in spans[i])) for i, t in enumerate(texts)}


def test_revealing_words_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    texts = []
    for i in range(300):
        words = rng.choices(common, k=rng.randrange(3, 40))
        if i % 4 == 0:
            owner = rng.randrange(6)
            value = [f"jane{rng.randrange(99)}@firm{owner}.com", f"10.0.{owner}.{rng.randrange(255)}", f"+1 (555) 55{owner}-{rng.randrange(1000, 9999)}", f"{'ab12' * 5}{owner}{rng.randrange(10**8, 10**9)}cdef"][i // 4 % 4]
            at = rng.randrange(len(words))
            words[at:at] = [f"secretname{chr(97 + owner)}{'abcd'[i // 4 % 4]}", value][:: rng.choice((1, -1))]
        texts.append(" ".join(words))
    texts += ["", "a" * 5000 + " x@y.org " + "longword" * 300] + [texts[0]] * 3
    out = {r.id: sorted((s.start, s.end) for s in r.spans if s.kind == pii.TERM) for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()}
    want = brute_terms(texts)
    assert out == want and sum(map(len, want.values())) > 20


def test_thousands_of_revealing_words(spark):
    """Each of 1,500 owners has a word of its own beside every value; words that all share reveal none."""
    import random

    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda n: "".join(letters[n // 26**i % 26] for i in range(4))
    common, texts = [f"shared{name(i)}" for i in range(300)], []
    for owner in range(1500):
        own, value = f"of{name(owner * 7)}", [f"user@site{owner}.net", f"10.{owner // 250}.{owner % 250}.7", f"+44 20 {1000 + owner} 0{rng.randrange(1000, 9999)}"][owner % 3]
        for _ in range(rng.choice((1, 5, 9))):
            words = rng.choices(common, k=rng.randrange(8, 25))
            at = rng.randrange(len(words))
            words[at:at] = [own, value][:: rng.choice((1, -1))]
            texts.append(" ".join(words))
        if owner % 2:  # its word elsewhere, without the value
            texts += [f"{own} {' '.join(rng.choices(common, k=9))}" for _ in range(rng.randrange(4))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {r.id: sorted((s.start, s.end) for s in r.spans if s.kind == pii.TERM) for r in pii.find_personal_data(df).collect()}
    want = brute_terms(texts)
    assert out == want
    found = {texts[i][s:e] for i, spans in want.items() for s, e in spans}
    assert len(found) > 800 and not any(w.startswith("shared") for w in found)


def test_secrets():
    text = 'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" and 1234567890123456789012345 or abcdefghijklmnopqrstuvwxyzabc or aaaaaaaaaaaaaaaaaaaaaa11111111'
    assert [text[s:e] for _, s, e in pii.secrets(text)] == ["cb1a9fee807a05366fcb8b6c95c7c565ede51a72"]
