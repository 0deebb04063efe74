"""Language ID, mixing, quality rules and licences: small cases and brute force."""

import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from noctule.llm import langid, licenses, mixing, quality
from noctule.llm import text as T
from noctule.llm.queries import license_sql

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs.where(~T.in_fold(F.col("doc_id"), 5, 0)), "text", "lang")


def test_held_out_languages(docs, model):
    held = docs.where(T.in_fold(F.col("doc_id"), 5, 0))
    assert held.count() == sum(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in docs.select("doc_id").collect())
    right = [r["lang"] == r["lang_pred"] for r in langid.predict(held, model).collect()]
    assert sum(right) >= 0.95 * len(right)


def test_a_text_of_two_languages(spark, docs, model):
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars between 1500 and 6000").collect()}
    half = lambda t: " ".join(t.split()[:150])
    rows = [(half(texts["fr"]) + "\n" + half(texts["de"]), 1.0), (half(texts["es"]), 2.0)]
    both, one = langid.predict(spark.createDataFrame(rows, "text string, score double"), model).collect()
    assert 0.35 < both["lang_shares"]["fr"] < 0.65 and 0.35 < both["lang_shares"]["de"] < 0.65
    assert set(one["lang_shares"]) == {"es"} and one["score"] > 0.99


def test_texts_without_letters_and_empty_tables(spark, model):
    rows = spark.createDataFrame([(None,), ("",), ("12 +-%",), ("x" * 300_000,), ("x" * 300_000,)], "text string")
    out = langid.predict(rows, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in out[:3]] == [("und", 0.0)] * 3
    assert out[3] == out[4] and out[3]["lang_pred"] in model[0]
    assert langid.predict(rows.limit(0), model).collect() == []
    nothing = langid.learn(rows.limit(0).withColumn("lang", F.lit("x")), "text", "lang")
    assert {r["lang_pred"] for r in langid.predict(rows, nothing).collect()} == {"und"}


def filled(sizes, weights, most):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in sizes}
        full |= over


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, ["a", "b", "c", None, "Z"][0 if i % 3 else i % 5], " ".join(["w"] * (i % 17)), 9) for i in range(900)] + [(901, "b", None, 9), (None, "b", "x y", 9), (None, "b", "x y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    return docs, lambda d: mixing.mix(d, "source", T.n_words(F.col("text")), mixing.identity(F.col("doc_id"), F.col("text")), mixing.word_share(F.col("text")))


def test_mixture_meets_its_targets(mixed):
    docs, mix = mixed
    out = mix(docs).collect()
    assert len(out) == 903 and out == mix(docs.repartition(5)).orderBy("doc_id").collect() or sorted(map(str, out)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert target == pytest.approx(filled(sizes, (5, 2, 1), 3))
    assert all(r["source_size"] == sizes[r["source"]] for r in out)
    assert all(abs(taken[s] - target[s]) <= 16 for s in sizes)


def test_mixture_without_rows_or_words(mixed):
    docs, mix = mixed
    assert mix(docs.limit(0)).collect() == []
    assert {(r["size"], r["target"], r["taken"]) for r in mix(docs.where("text = ''")).collect()} == {(0, 0.0, 0)}


def test_heavier_rows_are_drawn_more_often(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("source"), F.lit(1).alias("n"), (F.col("id") % 2 * 3 + 1).cast("double").alias("w"), F.md5(F.col("id").cast("string")).alias("h"))
    first = rows.withColumn("k", mixing.sampling_key(F.col("h"), F.col("w"))).orderBy(F.desc("k")).limit(1000)
    assert 0.75 < first.where("w = 4").count() / 1000 < 0.85  # 4 of 5 expected


def test_keys_of_low_quality_are_spread_and_do_not_underflow(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 4_000, "a").otherwise("b").alias("source"), F.md5(F.col("id").cast("string")).alias("h"))
    for quality in (1.0, 0.1, 0.01, 1e-4, 1e-9):
        out = mixing.mix(rows, "source", F.lit(1).cast("long"), F.col("h"), F.lit(quality)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 1 for r in out) and any(0 < r["taken"] < 16_000 for r in out)
        key = mixing.sampling_key(F.col("h"), F.lit(quality))
        bins = rows.groupBy(mixing.key_bin(key)).count().agg(F.max("count")).first()[0]
        assert bins <= 20 and rows.select(key).distinct().count() == 20_000


def covered(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def test_quality_measures_against_brute_force(spark):
    texts = ["", None, "  \n ", "a b c d", "a b c d e", "a a a a a a a", "a b c d e f a b c d e", "x y z w v u x y z w v q\nx y z w v\nx y z w v\n\n", "é# ß$ |\n" * 30,
             " ".join(str(i % 50) for i in range(40_000)), "a b c d e a b c d e a b c d e f g h i j k l m n o p q r s t"]
    out = quality.judge(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, text string, n_words int")).orderBy("i").collect()
    for t, r in zip(texts, out):
        words, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == covered(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * covered(words) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(spark.createDataFrame([], "text string")).collect() == []


def test_quality_plan_is_one_projection(docs):
    plan = quality.judge(docs).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_extract_all") <= 6


def test_labelled_quality(spark, docs):
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").join(docs, "doc_id")
    rows = quality.judge(labels).where("n_words >= 10 AND toxic = 0").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


MIT = """Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark):
    texts = [MIT, "words\nand words\nLicensed under the Apache License, Version 2.0.", None, "", "software and licence in passing", MIT + "\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"]
    out = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r["licenses"] for r in out] == ["MIT", "Apache-2.0", "", "", "", "MIT|CC-BY-NC-4.0", ""]
    assert [r["n_known"] for r in out] == [4, 1, 0, 0, 0, 6, 1] and out[-1]["n_unmatched"] == 1
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    link.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    twin = sorted(link.execute(license_sql()).fetchall())
    assert twin == [(r["i"], r["licenses"], r["n_known"], r["n_unmatched"]) for r in out]
    assert licenses.scan(spark.createDataFrame([], "text string")).collect() == []


def test_every_known_sentence_has_an_anchor_and_is_normalised(spark):
    rows = spark.createDataFrame(list(licenses.SENTENCES.items()), "id string, s string")
    assert rows.where(~F.col("s").rlike(licenses.ANCHOR)).count() == 0
    assert rows.where(licenses.normalised(F.col("s")) != F.col("s")).count() == 0
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)
    assert math.isfinite(len(licenses.RULES))


LINES = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
         "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}


def test_licence_lines_of_documents_against_a_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {name: 0 for name in LINES.values()}
    for r in licenses.scan(docs).collect():
        lines = {LINES[x] for x in (r["text"] or "").split("\n") if x in LINES}
        assert set(filter(None, r["licenses"].split("|"))) == lines
        for name in lines:
            found[name] += 1
    assert all(found.values())


def test_rights_reserved(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" \
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n" \
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n" \
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    texts = ["words\nAll rights reserved.", "Copyright (c) 2020 X. All rights reserved.", "Copyright (c) 2020 X\nAll rights reserved.", "Copyright 2020 X, all rights reserved",
             f"Copyright (c) 2020, X. All rights reserved.\n\n{bsd}", f"Copyright (c) 2020, X\nAll rights reserved.\n\n{bsd}"]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [(r["licenses"], r["n_unmatched"]) for r in out] == [("Proprietary", 0)] * 4 + [("BSD-2-Clause", 0)] * 2


APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ISC = """Copyright 2020 X

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
BSD = """Copyright 2020 X

Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and
   the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
   and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written permission.
"""
GNU = """Copyright (C) 2020  X

This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {2}General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (MIT, "MIT"), (APACHE, "Apache-2.0"), (ISC, "ISC"), (BSD % ENDORSE, "BSD-3-Clause"), (BSD % "", "BSD-2-Clause"), (MPL, "MPL-2.0"), (MPL.replace("https", "http"), "MPL-2.0"), (MPL.split(" If")[0], "MPL-2.0"),
    (GNU.format("program", ";", "", ";", "2"), "GPL-2.0-or-later"), (GNU.format("program", ":", "", ",", "3"), "GPL-3.0-or-later"), (GNU.format("program", ";", "", ";", "3"), "GPL-3.0-or-later"),
    (GNU.format("program", ";", "", ",", "2"), "GPL-2.0-or-later"), (GNU.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later"), (GNU.format("library", ":", "Lesser ", ",", "2.1"), "LGPL-2.1-or-later"),
    (GNU.format("program", ";", "", ";", "2").split("\n\nThis program is dist")[0], "GPL-2.0-or-later"), (MPL.replace("2.0", "1.1"), ""),
    *((GNU.format(what, ";", title, ",", version).replace(f"Foundation, either version {version} of the License, or\n(at your option) any later version.", "Foundation.").replace(
        "Public License as published", f"Public License version {version} as published"), name)
      for what, title, version, name in (("program", "", "2", "GPL-2.0"), ("program", "", "3", "GPL-3.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("program", "Lesser ", "3", "LGPL-3.0"), ("program", "Affero ", "3", "AGPL-3.0"))),
    (GNU.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0-or-later"), (GNU.format("library", ";", "Lesser ", ",", "3"), "LGPL-3.0-or-later"),
    ("Copyright 2020 X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    ("Copyright (c) 2020 X\n\nThis software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\n"
     "execute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:", "BSL-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("To the extent possible under law, Some One has waived all copyright and related or neighboring rights to This Work.", "CC0-1.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
]


def test_every_rule_on_its_notice(spark):
    assert {name for _, name in NOTICES if name} | {"Proprietary"} == {name for name, _ in licenses.RULES}
    rows = [(i, t) for i, t in enumerate(y for t, _ in NOTICES for y in (t, "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")), t.replace("\n\n", "\nAll rights reserved.\n\n", 1)))]
    out = licenses.scan(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()
    for k, (t, name) in enumerate(NOTICES):
        plain, line, below = out[3 * k:3 * k + 3]
        assert (plain["licenses"], line["licenses"]) == (name, name), t
        if name:
            assert below["licenses"] == name and (plain["n_unmatched"], line["n_unmatched"], below["n_unmatched"]) == (0, 0, 0), t
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    link.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(link.execute(license_sql()).fetchall()) == [(r["i"], r["licenses"], r["n_known"], r["n_unmatched"]) for r in out]


def test_a_wrapped_grant_below_a_notice_in_two_lines(spark):
    text = "Copyright 2020 X\nAll rights reserved.\n\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License."
    assert licenses.scan(spark.createDataFrame([(text,)], "text string")).first()["licenses"] == "CC-BY-4.0|Proprietary"
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    link.execute("INSERT INTO documents VALUES (1, ?)", [text])
    assert link.execute(license_sql()).fetchall()[0][1] == "CC-BY-4.0|Proprietary"


PROBES = [
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier:MIT\nimport x", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"), ("// spdx-license-identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ("SPDX-License-Identifier: 0BSD", "0BSD"), ("SPDX-License-Identifier: LicenseRef-Own", ""), ("MIT License", "MIT"), ("MIT License\n\nCopyright (c) 2020 X\n\n" + MIT.split("\n\n", 1)[-1], "MIT"),
    ("This file is released under the MIT license.", "MIT"), ("All source code of this project is licensed under the terms of the BSD 3-Clause License.", "BSD-3-Clause"), ("It is distributed under the GPLv2.", "GPL-2.0"),
    ("The library is available under the Mozilla Public License 2.0.", "MPL-2.0"), ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("Released under the license.", ""), ("The MIT people are licensed drivers.", ""), ("This software is provided by us.", "")]


def test_tags_headings_and_short_grants(spark):
    rows = list(enumerate(t for t, _ in PROBES)) + [(100, None), (101, "Licensed under CC BY 4.0. " + "words " * 200_000 + "\nMIT License"), (102, "MIT License"), (102, "MIT License")]
    table = spark.createDataFrame(rows, "i int, text string")
    for name in ("_pair", "_ids", "_eaten", "row", "licenses"):
        table = table.withColumn(name, F.lit("own"))
    out = licenses.scan(table).orderBy("i").collect()
    assert [r["licenses"] for r in out] == [name for _, name in PROBES] + ["", "MIT|CC-BY-4.0", "MIT", "MIT"] and {r["_ids"] for r in out} == {r["row"] for r in out} == {"own"}
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    link.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(link.execute(license_sql()).fetchall()) == sorted((r["i"], r["licenses"], r["n_known"], r["n_unmatched"]) for r in out)
