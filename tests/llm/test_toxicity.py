"""Toxicity: the scan against a plain search of every entry, on a whole table; spellings."""

import math

import pyarrow.dataset as ds
import pytest
from vecloom.llm import queries as q
from vecloom.llm import toxicity


def plain_hits(model, text):
    """Every entry and exception, searched one by one."""
    plain, folded = toxicity.fold(text)

    def places(entry, whole):
        word, at = toxicity.fold(entry)[1], -1
        while word and (at := folded.find(word, at + 1)) >= 0:
            end = at + len(word)
            if not (at and plain[at - 1].isalnum()) and not (whole and end < len(plain) and plain[end].isalnum()):
                yield at, end

    harmless = [p for phrase in model.exceptions for p in places(phrase, True)]
    best = {}
    for entry, (weight, whole) in model.entries.items():
        for s, e in places(entry, whole):
            if not any(a <= s and e <= b for a, b in harmless) and weight > best.get(s, 0.0):
                best[s] = weight
    return list(best.values()), len(plain.split())


def test_op5_equals_a_plain_search(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()}
    got = {r.doc_id: r.score for r in q.op5_toxicity(spark, sf_dir).collect()}
    found = 0
    for d, text in texts.items():
        weights, words = plain_hits(model, text)
        total = sum(weights)
        z = model.curve[0] + model.curve[1] * math.log1p(total) + model.curve[2] * math.log1p(100 * total / (words + 20))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), abs=1e-9)
        found += bool(weights)
    assert got.keys() == texts.keys() and found > 0


@pytest.mark.parametrize("spelling", ["ıdıot", "ɪᴅɪᴏᴛ", "id!ot", "id|ot", "idiøt", "idiooooot", "iiidddiiioooттт", "IDIOT", "1d1օt", "mооооrоn", "ꜱᴄᴜᴍ", "lоооооser", "trаааsh", "stսpid", "i d i o t", "ｉｄｉｏｔ"])
def test_spellings_of_the_lexicon(spelling):
    model = toxicity.Model({w: (4.0, False) for w in toxicity.SEEDS})
    assert toxicity.Model.hits(model, *toxicity.fold(f"you {spelling} there"))


@pytest.mark.parametrize("text", ["Stop! It was a day | a night.", "Really?! Yes!", "a|b", "1000 000", "idol", "The committee agreed.", "aaa bbb"])
def test_clean_texts_have_none(text):
    model = toxicity.Model({w: (4.0, False) for w in toxicity.SEEDS})
    assert not model.hits(*toxicity.fold(text))
