"""Substring dedup and its index against plain search."""

import hashlib
import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from vecloom.llm import queries as q
from vecloom.llm import substring_dedup
from vecloom.llm.fm_index import FMIndex


def plain(rows, width=50):
    """rows: (doc_id, text). For each, words, words that go, and the text that stays."""
    first = {}
    order = lambda d: (d is None, d)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w not in first or order(d) < order(first[w]):
                first[w] = d
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if order(first[tuple(words[i : i + width])]) < order(d):
                gone[i : i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((d, len(words), sum(gone), kept))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def operator(df):
    got = [(r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()]
    return sorted(got, key=lambda r: ((r[0] is None, r[0]), r[1:]))


def test_op11_equals_plain_search(spark, sf_dir):
    rows = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    want = {(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in plain([(r["doc_id"], r["text"]) for r in rows])}
    got = [tuple(r) for r in q.op11_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert len(got) == len(rows) and set(got) == want and sum(r[2] > 0 for r in got) > 5


def passages(rng, n_docs, vocabulary, passages):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.choice([20, 49, 50, 51, 80, 300]))] for _ in range(passages)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(shared)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            words += [word() for _ in range(rng.randrange(60))] + (p if rng.random() < 0.5 else p[a:b])
        rows.append((d if rng.random() < 0.9 else rng.choice([None, 3, 7]), rng.choice([" ", "\t", "\n \r\x0b\x0c"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    rows = passages(rng, 120, (3, 2000)[seed - 1], 12)
    rows += [rows[5]] * 3 + [(500 + i, rows[6][1]) for i in range(5)] + [(None, None), (None, ""), (4, None), (600, "a " * 500), (601, "a " * 700), (2, " ".join(r[1] or "" for r in rows[:80]))]
    df = spark.createDataFrame([(d, t, 1, "x", b"y") for d, t in rows], "doc_id bigint, text string, row int, id string, words binary").repartition(4)
    assert operator(df) == plain(rows)


def test_one_hot_passage_streams_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_KEYS", 16)
    monkeypatch.setattr(substring_dedup, "MOST_KEYS", 16)
    rng = random.Random(3)
    hot = [f"h{i}" for i in range(120)]
    rows = [(d, " ".join([f"a{rng.randrange(10**6)}" for _ in range(70)] + hot + [f"b{rng.randrange(10**6)}" for _ in range(d % 60)])) for d in range(150)]
    assert operator(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_empty_and_string_ids(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    text = " ".join(map(str, range(60)))
    assert operator(spark.createDataFrame([("b", text), ("a", text), ("c", "short")], "doc_id string, text string")) == plain([("b", text), ("a", text), ("c", "short")])


@pytest.mark.parametrize("vocabulary", [1, 2, 40])
def test_matching_statistics_equal_plain_search(vocabulary):
    rng = np.random.default_rng(vocabulary)
    texts = [rng.integers(1, vocabulary + 1, n) for n in (0, 1, 70, 200, 33)]
    texts.append(texts[3][20:150].copy())
    width = 50
    index = FMIndex(texts, vocabulary + 1, width)
    asked = np.stack([np.concatenate((texts[3][:90], rng.integers(1, vocabulary + 1, 60))), rng.integers(1, vocabulary + 1, 150), np.full(150, -1), np.concatenate((rng.integers(1, vocabulary + 1, 60), [-1], texts[2][:70], [-1] * 19))], axis=1)
    runs = {tuple(t[i : i + n]) for t in texts for n in range(1, width + 1) for i in range(len(t) - n + 1)}
    found = index.statistics(asked)
    for j, column in enumerate(asked.T.tolist()):
        for i in range(len(column)):
            n = 0
            while n < width and i + n < len(column) and tuple(column[i : i + n + 1]) in runs:
                n += 1
            assert found[i, j] == n
