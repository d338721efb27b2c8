"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.dataset as ds
import pytest
from vecloom.llm import queries as q
from vecloom.llm import trie


def plain(convs):
    """convs: id -> list of (symbol, bytes). Rows of all nodes, by (smallest member, depth)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    first = {p: min(m) for p, m in members.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    out = {}
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out[first[p], len(p)] = (first[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_op13_equals_all_prefixes(spark, sf_dir):
    turns = defaultdict(list)
    for r in ds.dataset(f"{sf_dir}/conversations.parquet").to_table().to_pylist():
        role, text = r["role"] or "", r["text"] or ""
        turns[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, (role, text), len(text.encode())))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + v[h:]
    assert rows(q.op13_prefix_trie(spark, sf_dir)) == plain(rebuilt)


def seqs(spark, convs):
    return spark.createDataFrame([(c, [s for s, _ in t], [b for _, b in t]) for c, t in convs.items()], "conv_id bigint, ids array<bigint>, bytes array<bigint>").repartition(3)


@pytest.mark.parametrize("local_turns", [1, 20, 10**6])
def test_rounds_and_local_buckets_agree(spark, local_turns):
    rng = random.Random(local_turns)
    deep = [(s, s % 7) for s in range(30)]
    convs = {c: deep[: rng.choice([0, 3, 30])] + [(rng.randrange(3), rng.randrange(1, 2)) for _ in range(rng.randrange(4))] for c in range(150)}
    convs |= {1000 + i: deep[:12] for i in range(60)}  # one sequence that a third has
    convs = {c: [(s, 5 + s % 3) for s, _ in t] for c, t in convs.items()}
    assert rows(trie.trie_nodes(seqs(spark, convs), local_turns)) == plain(convs)


def test_one_sequence_and_none(spark):
    for convs in ({5: [(1, 2), (2, 3)], 4: [(1, 2), (2, 3)]}, {7: []}, {7: [], 8: []}, {1: [(3, 4)]}):
        assert rows(trie.trie_nodes(seqs(spark, convs))) == plain(convs)
    assert trie.trie_nodes(seqs(spark, {})).collect() == []


def test_nulls_ties_and_repeated_rows(spark):
    table = [
        (1, 0, "user", "hi"), (1, None, None, None), (1, 0, "assistant", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 0, "user", "hi"),
        ("3", 1, "user", "ä" * 10_000)]
    df = spark.createDataFrame([(str(c) if c is not None else None, t, r, x, 1, "y") for c, t, r, x in table], "conv_id string, turn bigint, role string, text string, n int, ids string")
    turns = {"1": ["", ""], "2": ["user", "hi"]}
    got = rows(trie.prefix_trie(df))
    assert {k[0] for k in got} == {"1", "2", "3"} and got["1", 0][:4] == (None, 3, 3, 3) and max(d for _, d in got) == 3 and turns
    assert got["3", 1][:2] == ("1", 1) and got["2", 2][2] == 0
    assert trie.prefix_trie(df.limit(0)).collect() == []
