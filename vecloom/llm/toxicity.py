"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms (full width, mathematical, ligatures) and accented letters
to the plain ones, without marks and characters that do not show, in lower case; letters that are
spelled out one by one are joined, ! and | inside a word are an i, and a letter that is drawn out (three
times or more) is there once; then look-alike letters go to the Latin ones, digits and signs to
the letters they stand for, and l to i, as the digit 1 stands for either. One Aho-Corasick pass then finds the lexicon's entries, whole words or word
beginnings, and the exception phrases, inside which entries do not count. The weights that are found
add up; their sum and their density in the text's words give the score by a logistic curve.

Lexicon, weights, exceptions and curve are learned from labelled rows; without toxic ones a small
built-in lexicon holds. Learning uses at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of their id: that is the only bound, and all that is learned from them follows from their
whole texts. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, forget, free_name

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Toxic documents an entry is found in, at least, and how much likelier (log odds) it is there.
SUPPORT, ODDS = 4, 2.5
PREFIXES = range(4, 9)
#: Distinct words that begin alike before the beginning counts as an entry.
FAMILY = 3

#: Used where there are no labels.
SEEDS = ("idiot", "moron", "scum", "loser", "stupid", "worthless", "pathetic", "disgusting", "trash", "clown")
SEED_WEIGHT, SEED_CURVE = 4.0, (-4.0, 2.0, 1.0)
#: Phrases in which an entry is meant harmlessly.
HARMLESS = ("trash can", "trash bin", "clown fish", "stupid simple", "sore loser rule")

#: Letters of other scripts, digits and signs, with what they stand for.
LOOKALIKES = dict(zip("аеорсухівкмнтгьѕјԁɡαβεηικνορτυχ012345789@$", "aeopcyxibkmhtrbsjdgabenikvoptuxoizeastbgas")) | {"l": "i"}
#: Small capitals, Armenian letters, and letters with a stroke or without a dot.
LOOKALIKES |= dict(zip("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijkimnoprstuvwyz"))
LOOKALIKES |= dict(zip("օոսհյցքզ", "onuhjgpq")) | dict(zip("øđłħŧƀıȷɨ", "odihtbiji"))
_TABLE = str.maketrans(LOOKALIKES)
_WORDS = re.compile(r"[^\W_](?:[^\W_]|[@$](?=[^\W_]))*")
#: Four letters or more, one by one, with a sign or a space between them.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\x20.*_·•-][^\W_]){3,}(?![^\W_])")
#: A sign for i inside a word, and a letter that is drawn out.
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1\1+")
_BETWEEN = re.compile(r"[\x20.*_·•-]")


class _Plain(dict):
    """For str.translate(): of each character its plain letters in lower case, without marks and what does not show."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code).lower())
        self[code] = "".join(c for c in parts.lower() if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
        return self[code]


_PLAIN = _Plain()


def fold(text: str) -> tuple[str, str]:
    """The text in plain letters, and folded; both of one length."""
    plain = text.lower() if text.isascii() else text.translate(_PLAIN)
    plain = _SPELLED.sub(lambda m: _BETWEEN.sub("", m[0]), plain)
    if "!" in plain or "|" in plain:
        plain = _INNER.sub("i", plain)
    plain = _DRAWN.sub(r"\1", plain)
    return plain, plain.translate(_TABLE)


@dataclass
class Model:
    """entries: folded word or beginning -> (weight, whole word); exceptions: folded phrases; curve: logistic."""

    entries: dict[str, tuple[float, bool]]
    exceptions: tuple[str, ...] = HARMLESS
    curve: tuple[float, float, float] = SEED_CURVE
    machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.entries, self.exceptions, self.curve

    def __setstate__(self, state) -> None:
        self.entries, self.exceptions, self.curve = state
        self.machine = None

    def automaton(self):
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                if folded := fold(phrase)[1]:
                    self.machine.add_word(folded, (len(folded), None, True, phrase))
            for entry, (weight, whole) in self.entries.items():
                folded = fold(entry)[1]
                self.machine.add_word(folded, (len(folded), weight, whole, entry))
            self.machine.make_automaton()
        return self.machine

    def hits(self, plain: str, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, entry) outside exceptions; of overlapping ones the heavier."""
        if not self.entries and not self.exceptions:
            return []
        found, harmless, n = [], [], len(plain)
        for last, (length, weight, whole, entry) in self.automaton().iter(folded):
            start, end = last - length + 1, last + 1
            if start and plain[start - 1].isalnum() or whole and end < n and plain[end].isalnum():
                continue
            harmless.append((start, end)) if weight is None else found.append((start, end, weight, entry))
        if harmless:
            found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e in harmless)]
        best: dict[int, tuple[int, int, float, str]] = {}
        for x in found:
            if x[0] not in best or best[x[0]][2] < x[2]:
                best[x[0]] = x
        return list(best.values())

    def features(self, text: str) -> tuple[float, float, int, int]:
        """Sum of weights, its density in the words, hits, words."""
        plain, folded = fold(text)
        hits, words = self.hits(plain, folded), len(plain.split())
        weight = sum(x[2] for x in hits)
        return math.log1p(weight), math.log1p(100 * weight / (words + 20)), len(hits), words

    def score(self, features) -> float:
        z = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """toxic, text of at most ``rows`` labelled documents that may be learned from, one an id."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("string").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # so that the broadcast is bounded
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    return cut(texts.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))


def words_of(plain: str, folded: str) -> set[str]:
    """Folded words: runs of letters, digits and the signs that stand for letters."""
    return {folded[m.start() : m.end()] for m in _WORDS.finditer(plain)}


def candidates_of(text: str) -> set[str]:
    """A text's possible entries: words, with a space at the end, and beginnings."""
    words = words_of(*fold(text))
    return {f"{w} " for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def count(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """entry, n: documents of rows that have each candidate (of those wanted)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: Counter = Counter()
        for part in parts:
            for text in part.column(0):
                have = candidates_of(text.as_py() or "")
                found.update(have if wanted is None else have & wanted)
                if len(found) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["entry", "n"])
                    found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    return rows.select("text").mapInArrow(batches, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def log_odds(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Of the candidates that are much likelier in toxic documents, how much."""
    odds = {c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean.get(c, 0) + 0.5) / (n_clean + 1)) for c, t in toxic.items()}
    return {c: x for c, x in odds.items() if x >= ODDS}


def holders(rows: DataFrame, wanted: set[str]) -> list[list[str]]:
    """Of each (toxic) row, the wanted candidates in it: as many rows as are learned from, at most."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            have = [sorted(candidates_of(text.as_py() or "") & wanted) for text in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.list_(pa.string()))], ["have"])

    return [r["have"] for r in rows.select("text").mapInArrow(batches, "have array<string>").collect()]


def choose(odds: dict[str, float], toxic: dict[str, int], have: list[list[str]]) -> dict[str, tuple[float, bool]]:
    """The lexicon: words, and beginnings that several words share, each with its log odds.

    The strongest come first, and an entry must mark enough toxic documents that fewer than two
    entries before it mark: words that copies of one document happen to share do not. So there are
    at most 2 / SUPPORT entries a toxic document.
    """
    family: Counter = Counter()
    for c in toxic:
        if c.endswith(" "):
            family.update(c[:n] for n in PREFIXES if len(c) > n)
    within: dict[str, list[int]] = {}
    for i, some in enumerate(have):
        for c in some:
            within.setdefault(c, []).append(i)
    marked, entries = [0] * len(have), {}
    for c in sorted(within, key=lambda c: (-toxic[c] * odds[c], not c.endswith(" "), len(c), c)):
        word, whole = c.rstrip(" "), c.endswith(" ")
        if word in entries or not whole and family[c] < FAMILY or any(word[:n] in entries and not entries[word[:n]][1] for n in PREFIXES if n < len(word)):
            continue
        if sum(marked[i] < 2 for i in within[c]) >= SUPPORT:
            entries[word] = (round(odds[c], 6), whole)
            for i in within[c]:
                marked[i] += 1
    return entries


def phrases(folded: str, start: int, end: int) -> Iterator[str]:
    """An entry's place in a text with the word before it, and with the one after it."""
    if start > 1 and folded[start - 1] == " ":
        word = folded[folded.rfind(" ", 0, start - 1) + 1 : start - 1]
        if word.isalpha():
            yield f"{word} {folded[start:end]}"
    if folded[end : end + 1] == " ":
        after = folded.find(" ", end + 1)
        word = folded[end + 1 : after if after >= 0 else len(folded)]
        if word.isalpha():
            yield f"{folded[start:end]} {word}"


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression on two features, by Newton steps with a small ridge."""
    a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, a.T @ (y - p) - ridge * w), -2, 2)
    return tuple(round(float(v), 9) for v in w)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled documents (label column toxic); the built-in one if none is toxic, or all are."""
    known = sample(docs, labels, id_col, text_col, rows)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return Model({w: (SEED_WEIGHT, True) for w in SEEDS})
    often = count(known.filter("toxic"), None).filter(F.col("n") >= SUPPORT)
    toxic = {r["entry"]: r["n"] for r in often.collect()}  # of a bounded sample
    clean = {r["entry"]: r["n"] for r in count(known.filter("not toxic"), set(toxic)).collect()}
    odds = log_odds(toxic, clean, n[True], n[False])
    model = Model(choose(odds, toxic, holders(known.filter("toxic"), set(odds))))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for is_toxic, text in zip(part.column(0), part.column(1)):
                plain, folded = fold(text.as_py() or "")
                found = {p for start, end, _, _ in model.hits(plain, folded) for p in phrases(folded, start, end)}
                rows.append((is_toxic.as_py(), *model.features(text.as_py() or "")[:2], sorted(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.string())))], ["toxic", "a", "b", "phrases"])

    looked = cut(known.mapInArrow(batches, "toxic boolean, a double, b double, phrases array<string>"))
    spread = looked.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase")
    good = spread.agg(F.count_if(~F.col("toxic")).alias("good"), F.count_if("toxic").alias("bad"))
    learned = good.filter((F.col("good") >= SUPPORT) & (F.col("good") * n[True] > 10 * F.col("bad") * n[False]))
    learned = sorted(r["phrase"] for r in learned.select("phrase").collect())
    seen = looked.select("toxic", "a", "b").collect()
    curve = fit_curve(np.array([(r["a"], r["b"]) for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    return Model(model.entries, (*HARMLESS, *learned), curve)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col: how likely the text is toxic, 0 to 1.

    A null text scores as the empty one; null ids and repeated rows score like any other. An empty
    table gives an empty result; other columns pass through. If one of them is named score_col, it
    stays, and underscores are added to the score's name.
    """
    place, name = df.columns.index(text_col), free_name(df, score_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            scores = pa.array((model.score(model.features(text.as_py() or "")) for text in part.column(place)), pa.float64(), size=part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the documents that score at or over the threshold.

    Null ids and texts, ties and repeated rows are scored as score_toxicity() says, each row by itself;
    labels that are null, or of no document, teach nothing. An empty table stays empty; columns may
    have any names.
    """
    score = free_name(df, "_score")
    scored = score_toxicity(df, learn(df, labels, id_col, text_col), text_col, score)
    return scored.filter(F.col(score) < threshold).drop(score)
