"""The near-dedup stage of the pipeline against all pairs."""

import random

import corpus_pipeline
import pyarrow.dataset as ds
import pytest
from vecloom.llm import near_dedup


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def first_of_all_pairs(texts):
    root, sets = {d: d for d in texts}, {d: grams(t) for d, t in texts.items()}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(d) for d in ids})


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def documents():
    """Near copies at all distances about the threshold, a large group of them, and a passage that many texts share."""
    rng, out = random.Random(4), ["", " \n", "one two", "One  two", "one two three"]
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    for n in (30, 80, 200):
        for times in range(1, 13):
            base = fresh(n)
            out += [" ".join(base), " ".join(changed(rng, base, times))]
    large, passage = fresh(100), fresh(40)
    out += [" ".join(changed(rng, large, rng.randrange(1, 3))) for _ in range(60)]
    out += [" ".join(passage + fresh(rng.randrange(2, 30))) for _ in range(40)]
    return dict(enumerate(out))


def test_finds_all_pairs_of_made_texts(spark):
    texts = documents()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    want = first_of_all_pairs(texts)
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(df).collect()) == want and len(want) < len(texts) - 60


def test_stage_finds_all_pairs_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()}
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) == first_of_all_pairs(texts)


@pytest.mark.parametrize("rows", [[], [(None, None), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (5, None)]])
def test_nulls_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(df).collect()) == ([1, 5] if rows else [])


def test_families_below_the_threshold_are_not_compared(spark, monkeypatch):
    """Texts that share much of their words, none of them near another: few pairs at any number of families."""
    def family(rng, size):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        return [" ".join(base[:175] + [f"own{rng.randrange(10**9)}" for _ in range(45)]) for _ in range(size)]

    met, plain = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda sets, pairs: met.append(pairs.count()) or plain(sets, pairs))
    for families in (10, 20):
        rng = random.Random(families)
        texts = [t for _ in range(families) for t in family(rng, 50)] + [t for _ in range(families // 2) for t in family(rng, 100)]
        texts += [texts[0], texts[0].replace("own", "other", 1)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
        kept = {r.doc_id for r in near_dedup.drop_near_copies(df).collect()}
        assert kept == set(range(len(texts) - 2))
    assert sum(met) <= 4 * 10
