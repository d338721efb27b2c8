"""Licences whose versions differ, short forms, and shards of very many rows with one id."""

import pytest
from pyspark.sql import functions as F
from vecloom.llm import license_scan, sharding

GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program."""
MPL11 = """The contents of this file are subject to the Mozilla Public License
Version 1.1 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.mozilla.org/MPL/"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
APACHE_HEAD = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
CASES = (
    (GPL2, ""), ("This work is licensed under the GNU General Public License, version 2.", ""), ("SPDX-License-Identifier: GPL-2.0-or-later", ""),
    (MPL11, ""), ("Licensed under the Apache License, Version 1.1.", ""), ("The Apache Software License, Version 1.1", ""), ("Licensed under CC BY 3.0.", ""), ("Licensed under CC BY-NC 3.0.", ""),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ""), ("BSD 2-Clause License\n\n" + BSD2, ""), ("Licensed under the BSD 2-Clause License.", ""), (BSD2, ""),
    ("// SPDX-License-Identifier: BSD-2-Clause", ""), ("SPDX-License-Identifier: LGPL-3.0-or-later", ""), ("SPDX-License-Identifier: AGPL-3.0-or-later", ""), ("SPDX-License-Identifier: ISC", ""),
    ("MIT License", "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2020 Somebody", "MIT"), ("# SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY-4.0"), (APACHE_HEAD, "Apache-2.0"), ("Mozilla Public License Version 2.0\n==================================", "MPL-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", ""),
    ("BSD 3-Clause License\n\n" + BSD2, "BSD-3-Clause"), ("He met students of the MIT license office.", ""), ("The licence of the driver was in the car.", ""))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "code = 1\n\n" + text + "\n\nmore = 2") for i, (text, _) in enumerate(CASES)]
    return {r.id: ",".join(r.families) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_versions_and_short_forms(found):
    assert {CASES[i][0]: f for i, f in found.items()} == dict(CASES)


def test_shards_of_one_id_keep_the_limit(spark):
    df = spark.range(200_000).select(F.lit(7).alias("doc_id"), F.lit("x" * 10).alias("text")).unionByName(spark.range(50).select(F.col("id").cast("int").alias("doc_id"), F.lit("y" * 10).alias("text")))
    shards = sharding.assign_shards(df, limit=20).groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.max("shard_bytes").alias("told"), F.max("shard_docs").alias("docs_told"), F.max("local_depth").alias("depth"))
    worst = shards.agg(F.max("bytes"), F.sum("docs"), F.sum(F.when((F.col("bytes") != F.col("told")) | (F.col("docs") != F.col("docs_told")) | (F.length("shard") != F.col("depth")), 1).otherwise(0))).first()
    assert tuple(worst) == (20, 200_050, 0)
    names = [r.shard for r in shards.select("shard").collect()]
    ordered = sorted(names)
    assert len(set(names)) == len(names) and not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))
