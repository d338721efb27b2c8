"""Licence texts as files have them: wrapped, and in comments."""

import random
import re
import textwrap

import pytest
from vecloom.llm import license_scan

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program."""
FAMILIES = {"BSD-3-Clause": (BSD, 2), "MIT": (MIT, 2), "Apache-2.0": (APACHE, 2), "GPL-3.0": (GPL, 2)}


@pytest.fixture(scope="module")
def found(spark):
    marks = {"plain": "", "hash": "# ", "slashes": "// ", "star": " * ", "rem": "REM "}
    rows, of = [], {}
    for family, (text, n) in FAMILIES.items():
        for mark in marks.values():
            of[len(rows)] = (family, n)
            rows.append((len(rows), "code = 1\n\n" + textwrap.indent(text, mark, lambda line: True) + "\n\nmore = 2"))
    rows += [(90, "The source of the river\nis in the mountains.\nAll members have rights\nand duties."), (91, "a line\nReleased under the MIT License.\nanother line")]
    return of, {r.id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_wrapped_texts_have_their_licence(found):
    of, got = found
    assert {i: got[i].families for i in of} == {i: [family] for i, (family, _) in of.items()}
    assert all(got[i].n_licenses >= n for i, (_, n) in of.items())


def test_prose_has_none_and_a_notice_counts_once(found):
    _, got = found
    assert (got[90].n_licenses, got[91].n_licenses, got[91].families) == (0, 1, ["MIT"])


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
NONE = (LGPL, AGPL, ISC, EPL, "The chef said all rights reserved tables are gone.", "He was released under the MIT license bridge, they say.", "Licensed under CC BY-SA 4.0.",
        "The notice said that copies of the software were sold, and the source of the river was modified.", "Students hold a license of the general public library version.")


def test_other_licences_and_prose_are_unknown(spark):
    rows = [(i, t) for i, t in enumerate(NONE)] + [(100 + i, " ".join(t.split())) for i, t in enumerate(NONE)]
    assert {tuple(r.families) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {()}


def by_hand(text, model):
    """(paragraph, line, family) of a text, with the model on the driver."""
    text = re.sub(r"(?m)^[ \t]*(?:rem|dnl)(?![^ \t\n])", "", text.lower())
    out = []
    for p, whole in enumerate(re.split("\n[^a-z0-9\u0080-\U0010ffff]*\n", text)):
        lines = whole.split("\n")
        found = {i: model.licence(line) for i, line in enumerate(lines)}
        if len(lines) > 1 and (joined := model.licence(" ".join(lines))) and joined[0] not in {x[0] for x in found.values() if x}:
            found[-1] = joined
        out += [(p, i, x[0], round(float(x[1]), 9), round(x[2], 9)) for i, x in found.items() if x]
    return sorted(out)


def test_scan_equals_the_model_on_every_paragraph(spark):
    rng, model = random.Random(2), license_scan.train()
    known = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    pool = known + list(license_scan.OTHERS) + list(license_scan.EVERYDAY) + list(NONE) + ["Größe 🙂 der Datei 𝐚𝐛; \u2028 x", "rem dnl", "// ----", "", "a.b.c", "!!!"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(pool).split(" ")
            words = [w for w in words if rng.random() > 0.05] if rng.random() < 0.5 else words
            parts.append(rng.choice(["\n", " ", "\n// "]).join([" ".join(words[:9]), " ".join(words[9:])]) if rng.random() < 0.5 else " ".join(words))
        texts.append(rng.choice(["\n", "\n\n", "\n # \n", " "]).join(parts))
    base = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    got = {}
    for r in license_scan.scan_paragraphs(base, "row").collect():
        got.setdefault(r["row"], []).append((r.paragraph, r.line, r.family, round(r.probability, 9), round(r.similarity, 9)))
    want = {i: by_hand(t, model) for i, t in enumerate(texts)}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and len(got) > 60
