"""Personal data: patterns, and information-theoretic sanitisation of what gives it away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern, and secrets as long
strings of high entropy. Each value found is a protected entity, and so is what it shares with others:
an address's owner and domain, a network, the leading digits of a phone or card number, as single
values seldom recur. Words near an entity can reveal it as well. Counts over the whole corpus estimate
how strongly: of the documents that have the word, the share that have the entity near it, taken at the
lower end of its 95 % confidence interval (Wilson), so that a single meeting proves little and copies of
one passage count as one observation. That bound p(e|t) is the word's disclosure, if it is also more
than chance: log2 p(e|t) / p(e), the least mutual information, must reach ``LEAST_BITS``. Words over the
disclosure threshold are generalised to the kind of entity that they reveal most, those over the
higher one are removed.

Three passes over the texts: spans and entities, with the words around them; document frequencies of
just those words; places of the words that reveal something (none if there are no such words). What a
pass needs to know of the one before goes to the workers as a bitmap of fixed size (false hits of it
are dropped by a join), never as a list that grows with the corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, with_row_key

KINDS = ("email", "ip", "card", "phone", "term", "secret")
TERM, SECRET = 4, 5
#: Words on either side of an entity that may reveal it.
WINDOW = 6
#: Least probability of an entity given a word from which on the word is generalised, or removed.
GENERALISE, REMOVE = 1 / 3, 1 / 2
#: Least information on the entity in a word that reveals it; quantile of the confidence bound.
LEAST_BITS, QUANTILE = 3.0, 1.96
#: Length, digits, letters and bits a character that make a string of letters and digits a secret, at least.
SECRET_LENGTH, SECRET_MIX, SECRET_BITS = 24, 4, 3.0
#: Bits of the bitmap that goes to the workers (8 MiB).
BITMAP_BITS = 1 << 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: no match can begin within one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_NO_LETTER = re.compile(r"[^A-Za-z]+")
_LONG = re.compile(rf"[A-Za-z0-9]{{{SECRET_LENGTH},}}+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right.

    They are found from the @ outward, which takes linear time on long runs of letters.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, by kind, then start."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strings that are too long and too mixed for words or numbers."""
    out = []
    for m in _LONG.finditer(text):
        digits = len(_NO_DIGIT.sub("", m[0]))
        if SECRET_MIX <= digits <= len(m[0]) - SECRET_MIX and entropy(m[0]) >= SECRET_BITS:
            out.append((SECRET, *m.span()))
    return out


def entities(kind: int, value: str) -> list[str]:
    """A value as one entity, however it is written, and what it shares with others, each with its kind before it."""
    digits = _NO_DIGIT.sub("", value)
    if kind == 0:
        local, domain = value.lower().split("@", 1)
        owner = _NO_LETTER.sub("", local)
        names = [value.lower(), f"@{domain}", *([f"{owner}@"] if len(owner) > 2 else [])]
    elif kind == 1:
        names = [value, value.rpartition(".")[0]]
    elif kind == 2:
        names = [digits, digits[:6]]
    elif kind == 3:
        names = [digits, digits[:-4]]
    else:
        names = [value]
    return [f"{kind}{name}" for name in names]


def terms(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]


def outside(words: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """The words that no span touches."""
    covered = sorted((a, b) for _, a, b in spans)
    out, at, end = [], 0, 0
    for w in words:
        while at < len(covered) and covered[at][0] < w[1]:
            end = max(end, covered[at][1])
            at += 1
        if w[0] >= end:
            out.append(w)
    return out


def meetings(text: str, spans: list[tuple[int, int, int]]) -> dict[tuple[str, str], int]:
    """(entity, term) -> one of the surroundings in which they meet: WINDOW whole words on either side of a value."""
    words = outside(terms(text), spans)
    starts, ends, met = [w[0] for w in words], [w[1] for w in words], {}
    for kind, start, end in spans:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        here = [w[2] for w in words[max(0, left - WINDOW) : left] + words[right : right + WINDOW]]
        around = xxhash.xxh64_intdigest(" ".join(here)) >> 1
        for pair in ((e, w) for e in entities(kind, text[start:end]) for w in set(here)):
            met[pair] = min(around, met.get(pair, around))
    return met


def bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term) & (BITMAP_BITS - 1)


def bitmap(words: DataFrame):
    """A bitmap of the column term, broadcast: its size is fixed, whatever the number of words."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bits = np.fromiter((bit(x.as_py()) for x in part.column(0)), dtype=np.int64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 5), pa.array(1 << (bits & 31))], ["at", "bits"])

    held = words.select("term").mapInArrow(batches, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITMAP_BITS >> 5, dtype=np.uint32)
    for row in held.toLocalIterator():
        out[row["at"]] = row["bits"]
    return words.sparkSession.sparkContext.broadcast(out)


def known_to(bits: np.ndarray, words: set[str]) -> list[str]:
    return [w for w in words if bits[(b := bit(w)) >> 5] >> (b & 31) & 1]


def scan(rows: DataFrame) -> DataFrame:
    """row, id, base, entities, met of every text: spans, distinct entities, and the words that they meet."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("around", pa.int64())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans, names, met = [], [], []
            for text in (x.as_py() or "" for x in part.column(2)):
                base = base_spans(text)
                found = base + [s for s in secrets(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                names.append(sorted({e for k, s, e in found for e in entities(k, text[s:e])}))
                met.append([{"entity": e, "term": w, "around": a} for (e, w), a in meetings(text, found).items()] if found else [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, span), pa.array(names, pa.list_(pa.string())), pa.array(met, pair)], ["row", "id", "base", "entities", "met"])

    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    return cut(rows.select("row", "id", "text").mapInArrow(
        batches, f"row {of['row']}, id {of['id']}, base array<struct<kind:int,start:bigint,end:bigint>>, entities array<string>, met array<struct<entity:string,term:string,around:bigint>>"))


def frequencies(texts: DataFrame, bits) -> DataFrame:
    """term, df: documents that have it, for terms in the bitmap."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in parts:
            for text in (x.as_py() or "" for x in part.column(0)):
                found.update(known_to(bits.value, set(_TERM.findall(text.lower()))))
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["term", "n"])
                    found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    return texts.mapInArrow(batches, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def least_share(hits: Column, of: Column) -> Column:
    """The lower end of the confidence interval (Wilson) of a share of hits."""
    p, z2 = hits / of, QUANTILE * QUANTILE
    return (p + z2 / 2 / of - QUANTILE * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / of + z2 / 4 / of / of))) / (1 + F.lit(z2) / of)


def disclosure(scanned: DataFrame, texts: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """term, disclosure, of: the words that reveal some entity at the threshold or over, how much at most, and its kind."""
    met = scanned.select(F.explode("met").alias("m")).select("m.*")
    met = met.groupBy("entity", "term", "around").agg(F.count("*").alias("docs")).groupBy("entity", "term").agg(F.sum("docs").alias("docs"), F.count("*").alias("contexts"))
    met = cut(met)
    n = scanned.count()
    known = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_df"))
    words = frequencies(texts, bitmap(met.select("term").distinct()))
    found = met.join(words, "term").join(known, "entity")
    share = F.least(F.col("docs") / F.col("df"), F.lit(1.0))
    least = least_share(F.col("contexts").cast("double"), F.col("contexts") / share)
    bits = F.log2(F.col("disclosure") * F.lit(float(n)) / F.col("entity_df"))
    found = found.withColumn("disclosure", least).filter((F.col("disclosure") >= generalise) & (bits >= LEAST_BITS))
    most = F.max(F.struct("disclosure", F.substring("entity", 1, 1).cast("int").alias("of"))).alias("m")
    return found.groupBy("term").agg(most).select("term", "m.*")


def revealing_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """row, terms: spans (start, end, term, disclosure, of) of revealing words in each text that has some."""
    bits = bitmap(found)
    kind = rows.schema["row"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, hits = [], []
            for i, text in enumerate(x.as_py() or "" for x in part.column(1)):
                if wanted := set(known_to(bits.value, set(_TERM.findall(text.lower())))):
                    some = [w for w in outside(terms(text), base_spans(text) + secrets(text)) if w[2] in wanted]
                    at += [i] * len(some)
                    hits += some
            if hits:
                columns = [part.column(0).take(pa.array(at)), *(pa.array(c) for c in zip(*hits))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "start", "end", "term"])

    spans = rows.select("row", "text").mapInArrow(batches, f"row {kind}, start bigint, end bigint, term string").join(found, "term")
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "term", "disclosure", "of"))).alias("terms"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """One row per row of df: row (its key), id, spans, an array of (kind, start, end, disclosure, of).

    Kinds are 0 to 3 for the patterns, then 5 for secrets, then 4 for revealing words, in this order,
    each by start; places count code points, end exclusive. disclosure, and the kind that is revealed,
    are set for words only. Rows count as documents one by one; copies of a passage count as one
    observation. A null text is empty; ids may be null, repeated and of any type. An empty table gives
    an empty result; other columns are not read.
    """
    return search(*with_row_key(df), id_col, text_col, generalise)


def search(base: DataFrame, key: str, id_col: str, text_col: str, generalise: float) -> DataFrame:
    rows = base.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = scan(rows)
    found = cut(disclosure(scanned, rows.select("text"), generalise))
    span = lambda k, s, e, d, of: F.struct(k.alias("kind"), s.alias("start"), e.alias("end"), d.alias("disclosure"), of.alias("of"))
    none = lambda kind: F.lit(None).cast(kind)
    of_patterns = F.transform("base", lambda x: span(x["kind"], x["start"], x["end"], none("double"), none("int")))
    if not found.take(1):
        return scanned.select("row", "id", of_patterns.alias("spans"))
    of_words = F.transform("terms", lambda x: span(F.lit(TERM), x["start"], x["end"], x["disclosure"], x["of"]))
    joined = scanned.drop("entities", "met").join(revealing_spans(rows, found), "row", "left")
    return joined.select("row", "id", F.when(F.col("terms").isNull(), of_patterns).otherwise(F.concat(of_patterns, of_words)).alias("spans"))


def sanitise_text(text: str, spans: list, remove: float = REMOVE) -> str:
    """The text without its personal data: values by their kind, words by the kind that they reveal, or removed."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        out.append(text[at : s["start"]])
        if s["kind"] != TERM:
            out.append(f"<{KINDS[s['kind']].upper()}>")
        elif s["disclosure"] < remove:
            out.append(f"<word of {KINDS[s['of']]}>")
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """df with its texts sanitised; a null text stays null.

    Every row is sanitised, those with null or repeated ids and repeated rows too; find_personal_data()
    says what is found. An empty table stays empty; columns may have any names.
    """
    base, key = with_row_key(df)
    found = search(base, key, id_col, text_col, generalise).select(F.col("row").alias(key), F.struct("spans").alias(f"{key}s"))
    joined = base.join(found, key)
    place, last = joined.columns.index(text_col), joined.columns.index(f"{key}s")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [None if t is None else sanitise_text(t, s["spans"], remove) for t, s in zip(part.column(place).to_pylist(), part.column(last).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return joined.mapInArrow(batches, joined.schema).drop(key, f"{key}s")
