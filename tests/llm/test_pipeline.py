"""Each stage of the pipeline against brute force on what the stage before kept."""

import re
from collections import Counter

import corpus_pipeline
from test_near_dedup import first_of_all_pairs
from vecloom.llm import toxicity
from vecloom.llm.queries import TOKENIZER


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    columns, docs = ["doc_id", "text", "lang", "source", "n_chars"], spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name == "toxicity":
            model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {r.doc_id for r in before if model.score(model.features(r.text or "")) < 0.3}
            assert {r.doc_id for r in after} == want and len(want) < len(before)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "simhash_dedup":
            assert sorted(r.doc_id for r in after) == first_of_all_pairs({r.doc_id: r.text or "" for r in before})
        elif name == "mixing":
            size, got = Counter(), Counter()
            for r in before:
                size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            for r in after:
                got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
            full = {}
            while True:
                left = 1.5 * sum(size.values()) - sum(full.values())
                rest = {s: left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in size if s not in full}
                over = {s: 2.0 * size[s] for s, t in rest.items() if t > 2 * size[s]}
                if not over:
                    break
                full |= over
            longest = {s: max(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before if r.source == s) for s in size}
            assert all(abs(got[s] - t) <= longest[s] / 2 + 1 for s, t in (full | rest).items())
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(TOKENIZER)
            want = Counter((r.doc_id, tuple([*known.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in before)
            assert sum(r.length for r in after) == sum(len(ids) * n for (_, ids), n in want.items())
            assert len({r.sequence_id for r in after}) == len(after) and all(len(r.ids) == r.length and r.offset == 0 for r in after)
            pieces = {(r.doc_id, r.start, tuple(r.ids)) for r in after}
            for d, ids in want:
                starts = {s for x, s, p in pieces if x == d and ids[s : s + len(p)] == p}
                assert 0 in starts
        before = after


def test_run_applies_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)


def test_run_on_no_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_nulls_and_repeated_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    nulls = spark.createDataFrame([(None,) * 5, (None, "one two three four five six", None, None, None), (1 << 40, None, "en", "src0", 0), (1 << 40, " ", "en", None, 1)], docs.schema)
    docs.union(docs).union(nulls).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.sequence_id for r in out}) == len(out) > 0 and None in {r.doc_id for r in out}
