"""The registered queries against brute force over a whole small table."""

import hashlib
import re
import zlib
from collections import defaultdict

import pyarrow.dataset as ds
import pytest
import xxhash
from vecloom.llm import queries as q


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def simhash_of(text, width=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4_equals_all_pairs(spark, sf_dir, texts):
    prints = {d: simhash_of(t) for d, t in texts.items()}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op4_simhash_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_op1_finds_every_notice_and_no_other(spark, sf_dir, texts):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary"}
    want = {d: ",".join(sorted({f for s, f in lines.items() if s in t.split("\n")})) for d, t in texts.items()}
    got = {r.doc_id: r.families for r in q.op1_license_scan(spark, sf_dir).collect()}
    assert got == want


def test_op5_is_right_on_held_out_rows(spark, sf_dir):
    rows = {r.doc_id: r for r in q.op5_toxicity(spark, sf_dir).collect()}
    labels = ds.dataset(f"{sf_dir}/labels.parquet").to_table().to_pylist()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [(rows[x["doc_id"]].predicted, x["toxic"]) for x in labels if rows[x["doc_id"]].held_out]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_op9_has_each_token_once(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(q.TOKENIZER)
    rows, seen = defaultdict(list), set()
    for r in q.op9_pack(spark, sf_dir).collect():
        rows[r.doc_id].append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.sequence_id not in seen
        seen.add(r.sequence_id)
    assert rows.keys() == texts.keys()
    for d, text in texts.items():
        ids = [*known.encode(text, add_special_tokens=False).ids, 1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        at = 0
        for r in sorted(rows[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(raw[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids)


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_of(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)}
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]


def test_op10_base_equals_the_patterns(spark, sf_dir, texts):
    for r in q.op10_personal_data(spark, sf_dir).collect():
        base = base_of(texts[r.doc_id])
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in written.split(",") if s]
