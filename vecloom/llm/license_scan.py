"""License scans by a trained paragraph classifier. Native: DataFrame functions on the scan's path.

A logistic regression over sparse word bigrams and trigrams tells licence families and an unknown
class apart; the ends of sentences count as words, so that a phrase within a sentence is not a notice.
It is trained on the driver from the templates below (a fixed number of rows: each wording cut, garbled
and set into other words). The unknown class is learned from licences of other families, from the same
vocabulary in other order and from everyday sentences that speak of licences. Probabilities are
calibrated by temperature scaling on rows that training did not see: models that lack some wordings,
of known and of other licences, classify these, and garbled copies of those that they know; the former
count as the share ``UNSEEN`` of all. A paragraph has a licence if its family is likely
enough, if it then holds enough of the word n-grams of one of that family's templates, all those with the
template's version among them, and if no licence of another kind, or other version, is nearer. Templates
that several versions share (SHARED) confirm a licence only beside another paragraph that tells which it is.

The scan explodes every line and every paragraph of several lines of every whole text into the hashes
of its n-grams, joins them with the model (a broadcast: its size is that of the templates) and adds up
the weights per paragraph; the partial sums of a partition come before the shuffle. Texts, paragraphs
and lines without any of a few parts of words end before that: what is near enough to a template has
one of them, as more of its n-grams than may be missing do.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import with_row_key

#: Templates of each family, from the public texts of the licences and their usual notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "MIT License",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Templates that other versions of the family have as well.
SHARED = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "You should have received a copy of the GNU General Public License along with this program.",
)
UNKNOWN = "unknown"
#: Sentences that speak of such things without granting a licence.
EVERYDAY = (
    "You need a license to drive a car on public roads.", "The fishing licence is valid for one year.", "She was released under the bridge at night.",
    "He reserved all the seats in the first row.", "The general public was free to visit the work.", "Version 2.0 of the song was released in May.",
    "The source of the river is in the mountains.", "They have the right to use this road.", "All rights and duties of the members are written down.",
    "A copy of the letter was sent to the office.", "The work was done under the terms of the agreement.", "Students of MIT released a new album.",
    "The Apache helicopter landed in the field.", "The commons were open to all creative people.", "Without warranty the radio was cheap.",
)
#: Licences of other families and other versions: what resembles one of these more than a known family is unknown.
OTHERS = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Released under the ISC License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "This is free and unencumbered software released into the public domain.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    "Mozilla Public License Version 1.1",
    "The Apache Software License, Version 1.1",
    "Licensed under the Apache License, Version 1.1.",
    "Licensed under the BSD 2-Clause License.",
    "BSD 2-Clause License",
    "Licensed under CC BY 3.0.",
    "Licensed under CC BY-NC 3.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-License-Identifier: LGPL-3.0-or-later",
    "SPDX-License-Identifier: LGPL-2.1-only",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: MPL-1.1",
    "SPDX-License-Identifier: CC-BY-SA-4.0",
    "SPDX-License-Identifier: CC-BY-3.0",
)
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6
VARIANTS, SEED, FOLDS, UNSEEN = 12, 7, 4, 0.1
#: The end of a sentence, as a word.
END = "\ue000"
END_RE = r"[.!?;:]+(?=\s|$)"
ENDS_RE = END + r"(?:[^a-z0-9\x{80}-\x{10FFFF}]*" + END + ")+"
WORDS_RE = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: From the end of a line over lines without words; comment marks made of letters.
BLANK_RE = r"\n[^a-z0-9\x{80}-\x{10FFFF}]*\n"
COMMENT_RE = r"(?m)^[\x20\t]*+(?:rem|dnl)(?![^\x20\t\n])"
#: Words that are too common to tell whether a text is worth a look.
COMMON = frozenset("the of and to in is a an or for by this that you with be any as at may on it all are not from can under used have file copy work code form made".split())


def words_of(text: str) -> list[str]:
    """As the scan splits them."""
    text = re.sub(END_RE, f" {END} ", text.lower())
    out = "".join(c if "a" <= c <= "z" or "0" <= c <= "9" or c >= "\u0080" else " " for c in text).split()
    out = [END, *out, END]
    return [w for i, w in enumerate(out) if not (i and w == out[i - 1] == END)]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def version_grams(grams: frozenset[str] | set[str]) -> frozenset[str]:
    """The pairs of words among n-grams that carry a number: a text without one of them has another version, or none."""
    pairs = [g.split(" ") for g in grams]
    return frozenset(" ".join(p) for p in pairs if len(p) == 2 and END not in p and any(w.isdigit() for w in p))


@cache
def anchors() -> tuple[str, ...]:
    """Words of which every text has one that holds MIN_SIMILARITY of some template's n-grams.

    Of each template words are taken, long ones before short ones and then the one that is in most of
    its n-grams not yet covered, until more n-grams are covered than may be missing.
    """
    taken: list[str] = []
    for text in sorted((t for texts in TEMPLATES.values() for t in texts), key=len):
        grams = [g.split(" ") for g in grams_of(words_of(text))]
        while True:
            rest = [g for g in grams if not any(w in taken for w in g)]
            if len(grams) - len(rest) > (1 - MIN_SIMILARITY) * len(grams):
                break
            counts = Counter(w for g in rest for w in set(g) if w != END and w not in COMMON and not w.isdigit())
            taken.append(min(counts, key=lambda w: (len(w) < 5, -counts[w], w)))
    return tuple(taken)


def worth_a_look(text: Column) -> Column:
    """Whether a text in lower case can hold a licence: a long anchor is in it, or a short one as a word.

    The text goes through an array of one, so that it is computed once for all anchors.
    """
    long = [a for a in anchors() if len(a) > 4 and not any(b != a and len(b) > 4 and b in a for b in anchors())]
    short = "|".join(a for a in anchors() if len(a) < 5)

    def found(t: Column) -> Column:
        by_part = reduce(lambda a, b: a | b, [F.contains(t, F.lit(word)) for word in long])
        return by_part | F.rlike(t, F.lit(rf"(?<![a-z0-9])(?:{short})(?![a-z0-9])")) if short else by_part

    return F.exists(F.array(text), found)


@dataclass(frozen=True)
class Model:
    """families (the last is unknown), intercepts; weights: n-gram -> one per family; templates: (family, n-grams)."""

    families: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    templates: tuple[tuple[str, frozenset[str]], ...]
    temperature: float

    def probabilities(self, text: str) -> list[float]:
        z = np.array(self.intercepts)
        for g in grams_of(words_of(text)):
            z = z + np.array(self.weights.get(g, [0.0] * len(z)))
        p = np.exp((z - z.max()) / self.temperature)
        return list(p / p.sum())

    def similarity(self, text: str, family: str) -> float:
        """Share of the n-grams of the family's nearest template that a text has; none of a template of another version."""
        grams = grams_of(words_of(text))
        return max(len(t & grams) / len(t) if f == UNKNOWN or version_grams(t) <= grams else 0.0 for f, t in self.templates if f == family)

    def licence(self, text: str) -> tuple[str, float, float] | None:
        """family, probability, similarity of a paragraph that has a licence."""
        p = self.probabilities(text)
        family = self.families[int(np.argmax(p))]
        if family == UNKNOWN or max(p) < MIN_PROBABILITY:
            return None
        near = self.similarity(text, family)
        return (family, max(p), near) if near >= MIN_SIMILARITY and near > self.similarity(text, UNKNOWN) else None


def _rows(rng: random.Random) -> list[tuple[list[str], str, int]]:
    """Training rows: words, family, fold of the wording (-1: none, rows that are always trained on)."""
    everything = [w for texts in TEMPLATES.values() for t in texts for w in words_of(t)]
    filler = [w for t in EVERYDAY for w in words_of(t) if w != END] + [f"{a}{b}" for a in ("th", "on", "er", "la", "de", "sch") for b in ("an", "ing", "ent", "os", "it")]
    some = lambda most: rng.choices(filler, k=rng.randrange(most))
    out, wordings = [], [(t, family) for family, texts in TEMPLATES.items() for t in texts] + [(t, UNKNOWN) for t in OTHERS]
    for number, (text, family) in enumerate(wordings):
        inner = words_of(text)[1:-1]
        for i in range(VARIANTS):
            words = [w for w in inner if i == 0 or rng.random() > 0.04]
            out.append(([END, *(some(12) if i else []), END, *words, END, *(some(12) if i else []), END], family, number % FOLDS))
        if len(inner) < 6:  # a phrase as short as that, within a sentence, is none
            out += [([END, *some(8), "word", *inner, "word", *some(8), END], UNKNOWN, -1) for _ in range(VARIANTS)]
    for text in EVERYDAY:
        out += [([END, *some(6), *words_of(text), *some(6), END], UNKNOWN, -1) for _ in range(VARIANTS // 3)]
    out += [([END, *rng.choices(everything, k=rng.randrange(1, 25)), END], UNKNOWN, -1) for _ in range(VARIANTS * 24)]
    return out


@cache
def train() -> Model:
    """The classifier; the same every time."""
    rows = _rows(random.Random(SEED))
    families = (*sorted(TEMPLATES), UNKNOWN)
    names = sorted({g for texts in (*TEMPLATES.values(), OTHERS, EVERYDAY) for x in texts for g in grams_of(words_of(x))})
    place = {g: i for i, g in enumerate(names)}
    x, y = np.zeros((len(rows), len(names) + 1)), np.zeros((len(rows), len(families)))
    x[:, -1] = 1
    for i, (words, family, _) in enumerate(rows):
        x[i, [place[g] for g in grams_of(words) if g in place]] = 1
        y[i, families.index(family)] = 1
    fold = np.array([f for _, _, f in rows])

    def fit(kept: np.ndarray) -> np.ndarray:
        a, b = x[kept], y[kept]
        w, speed = np.zeros((a.shape[1], len(families))), np.zeros((a.shape[1], len(families)))
        for _ in range(200):
            z = a @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.5 * (a.T @ (p - b) / len(a) + 1e-5 * w)
            w += speed
        return w

    spare = (np.arange(len(rows)) % 5 == 4) & (fold >= 0)
    held = [(x @ fit((fold != f) & ~spare), (fold == f), (fold != f) & spare) for f in range(FOLDS)]
    z = np.concatenate([z[new | old] for z, new, old in held])
    truth = np.concatenate([y[new | old] for _, new, old in held])
    share = np.concatenate([np.where(new[new | old], UNSEEN / new.sum(), (1 - UNSEEN) / old.sum()) for _, new, old in held])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(share[:, None] * truth * (s - np.log(np.exp(s).sum(axis=1, keepdims=True)))).sum())

    temperature = min((0.5 + 0.05 * i for i in range(150)), key=loss)
    w = fit(fold >= -1)
    weights = {g: tuple(round(float(v), 6) for v in w[i]) for g, i in place.items()}
    templates = tuple((family, frozenset(grams_of(words_of(t)))) for family, texts in (*sorted(TEMPLATES.items()), (UNKNOWN, OTHERS)) for t in texts)
    return Model(families, tuple(round(float(v), 6) for v in w[-1]), weights, templates, temperature)


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """gram (its hash), number, w0 ... of each n-gram that the model knows; as large as the templates."""
    names = [f"w{i}" for i in range(len(model.families))]
    rows = [(g, i, *model.weights[g]) for i, g in enumerate(sorted(model.weights))]
    table = spark.createDataFrame(rows, f"text string, number int, {', '.join(f'{n} double' for n in names)}")
    parts = F.split("text", " ")
    gram = F.when(F.size(parts) == 2, F.xxhash64(parts[0], parts[1])).otherwise(F.xxhash64(parts[0], parts[1], F.try_element_at(parts, F.lit(3))))
    return table.select(gram.alias("gram"), "number", *names)


def scan_paragraphs(base: DataFrame, key: str, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """row, paragraph, line, family, probability, similarity, sure of every paragraph or line that has a licence.

    Paragraphs lie between lines without words (blank, or comment marks only) and are counted from 0,
    as are the lines of each. A paragraph of several lines is classified line by line and as a whole,
    its lines joined, as licence texts are wrapped; as a whole it is line -1, and left out if one of
    its lines has that licence by itself. similarity is the share of the template's n-grams that it
    has, for the nearest template of the family; sure is whether a template that is not SHARED is near enough.
    """
    model, spark = model or train(), base.sparkSession
    names = [f"w{i}" for i in range(len(model.families))]
    texts = base.select(F.col(key).alias("row"), F.lower(text_col).alias("text")).filter(worth_a_look(F.col("text")))
    parts = F.split(F.regexp_replace("text", COMMENT_RE, ""), BLANK_RE)
    lines = texts.select("row", F.posexplode_outer(parts).alias("paragraph", "whole")).filter(worth_a_look(F.col("whole")))
    lines = lines.select("row", "paragraph", F.split("whole", "\n").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.array_join("lines", " "))).otherwise(F.array().cast("array<string>"))
    lines = lines.select("row", "paragraph", F.posexplode_outer(F.concat(whole, "lines")).alias("line", "text"), F.size(whole).alias("first"))
    lines = lines.select("row", "paragraph", (F.col("line") - F.col("first")).alias("line"), "text").filter(worth_a_look(F.col("text")))
    ended = F.concat(F.lit(f"{END} "), F.regexp_replace("text", END_RE, f" {END} "), F.lit(f" {END}"))
    words = F.filter(F.split(F.regexp_replace(ended, ENDS_RE, END), WORDS_RE), lambda w: w != "")
    lines = lines.select("row", "paragraph", "line", words.alias("w"))
    pairs = "transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1]))"
    triples = "if(size(w) > 2, transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], w[i + 1], try_element_at(w, i + 3))), array())"
    lines = lines.filter(F.size("w") > 1)
    grams = lines.select("row", "paragraph", "line", F.explode(F.expr(f"array_distinct(concat({pairs}, {triples}))")).alias("gram"))
    known = grams.join(F.broadcast(model_table(spark, model)), "gram")
    sums = known.groupBy("row", "paragraph", "line").agg(*[F.sum(n).alias(n) for n in names], F.collect_set("number").alias("numbers"))
    z = [(F.col(n) + F.lit(b)) / F.lit(model.temperature) for n, b in zip(names, model.intercepts)]
    most = F.greatest(*z)
    scored = sums.select("row", "paragraph", "line", "numbers", F.array(*[F.exp(v - most) for v in z]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("e", F.array_max("e"))
    scored = scored.select("row", "paragraph", "line", "numbers", (F.array_max("e") / total).alias("probability"), F.element_at(F.array(*map(F.lit, model.families)), best.cast("int")).alias("family"))
    scored = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))
    place = {g: i for i, g in enumerate(sorted(model.weights))}
    numbers, shared = (lambda grams: sorted(place[g] for g in grams)), {frozenset(grams_of(words_of(t))) for t in SHARED}
    of = {family: [(numbers(grams), numbers(version_grams(grams)) if family != UNKNOWN else [], grams not in shared) for f, grams in model.templates if f == family] for family in model.families}
    template = "array<struct<grams:array<int>,version:array<int>,own:boolean>>"
    compare = spark.createDataFrame([(f, of[f], of[UNKNOWN]) for f in model.families if f != UNKNOWN], f"family string, templates {template}, others {template}")
    part = lambda t: F.when(F.size(F.array_except(t["version"], "numbers")) == 0, F.size(F.array_intersect("numbers", t["grams"])) / F.size(t["grams"])).otherwise(0.0)
    share = lambda templates: F.array_max(F.transform(templates, part))
    own = share(F.filter("templates", lambda t: t["own"]))
    near = scored.join(F.broadcast(compare), "family").withColumn("similarity", share("templates")).filter(F.col("similarity") > share("others"))
    near = near.select("row", "paragraph", "line", "family", "probability", "similarity", (own >= MIN_SIMILARITY).alias("sure"))
    last = F.max("line").over(Window.partitionBy("row", "paragraph", "family"))
    near = near.filter(F.col("similarity") >= MIN_SIMILARITY).withColumn("last", last)
    return near.filter((F.col("line") >= 0) | (F.col("last") < 0)).drop("last")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: row (its key), id, n_licenses, families, probability.

    n_licenses counts the lines with a licence and the paragraphs that have one only as a whole, families lists theirs in order without repeats
    (empty if none), probability is the least certain of them (null if none). A paragraph that versions of a
    licence share counts only in a text that has another one of that version. A null or empty text has none; null ids and repeated rows are scanned like any other. An empty table gives an empty result;
    other columns are not read.
    """
    base, key = with_row_key(df)
    met = scan_paragraphs(base, key, text_col)
    sure = met.withColumn("known", F.max("sure").over(Window.partitionBy("row", "family"))).filter("known")
    found = sure.groupBy("row").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("family")).alias("found"), F.min("probability").alias("probability"))
    rows = base.select(F.col(key).alias("row"), F.col(id_col).alias("id"))
    return rows.join(found, "row", "left").select(
        "row", "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce("found", F.expr("cast(array() as array<string>)")).alias("families"), "probability")
