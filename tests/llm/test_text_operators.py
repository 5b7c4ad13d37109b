import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docmeter.llm import chat, language, licenses, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, line string"


def _documents(spark):
    line = "One of these lines is a plain sentence, with a few more words than most."
    texts = [
        None, "", " \n \t", "word", "\n".join([line] * 30), " ".join(["again"] * 80) + ".",
        "\n".join([f"{line} {i}." for i in range(9)] + ["home | about | help | news", "No mark at the end", "All RIGHTS reserved. ", "Ends well。"]),
        "\n".join(f"item{i} | item{i + 1} | more{i}" for i in range(40)), " ".join(f"w{i}!!" for i in range(90)), "é ü x " * 40 + "end.\r\nLast line.\n\n",
        " ".join(f"x{i}" for i in range(60_000)) + ".",
        "Released under the MIT License.\nAll rights reserved.", "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0.\nx", "Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.",
    ]
    texts.append("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.")
    rows = [(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "x", None, None, None, None, None), rows[4]], DOCS)


def _same(frame, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        arrow = table.toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow")
    columns = sorted(frame.columns)
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == want


@pytest.mark.parametrize("operator, sql", [(lambda d: quality.clean_lines(d, with_text=False), quality.ORACLE_SQL), (licenses.scan_licenses, licenses.ORACLE_SQL)])
def test_documents_equal_sql(spark, operator, sql):
    docs = _documents(spark)
    _same(operator(docs), sql, documents=docs)
    assert operator(docs.limit(0)).count() == 0


def test_cleaned_text_loses_failed_lines_only(spark):
    got = {r.doc_id: r for r in quality.clean_lines(_documents(spark)).collect()}
    assert got[0].clean_text is None and got[4].clean_text.count("\n") == 29
    assert "home |" not in got[6].clean_text and "No mark" not in got[6].clean_text and "RIGHTS" not in got[6].clean_text and got[6].clean_text.endswith("Ends well。")
    assert got[7].clean_text == "" and not got[7].kept
    kept = quality.stage(spark, _documents(spark), "").collect()
    assert all(len(r.text) == r.n_chars for r in kept) and {r.doc_id for r in kept} == {i for i, r in got.items() if r.kept}


def test_licenses_by_rule(spark):
    got = {r.doc_id: (r.licenses, r.kind) for r in licenses.scan_licenses(_documents(spark)).collect()}
    assert got[11] == ("MIT;all rights reserved", "reserved") and got[12] == ("MIT", "permissive") and got[13] == ("CC-BY-NC-4.0", "noncommercial")
    assert got[14] == ("", "none") and got[15] == ("ISC", "permissive")
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())


APACHE = """ Copyright (C) 2008 The Project

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """Copyright (C) 2008 Someone

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def _commented(text, mark):
    return "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))


def test_licenses_in_comments(spark):
    grant = licenses.SENTENCES["mit-grant"].split()
    texts = [
        "/*\n" + _commented(APACHE, " *") + "\n */", _commented(GPL, "#"), _commented(APACHE, "//"),
        _commented(GPL.replace("\n\n", "\n").replace("free software:", "free software;"), "#"),
        "\n".join(f"*{w:^100}*" for w in ["Copyright 2008 Someone", *grant]), "All rights reserved not\nhere, nor: licensed under the mit license",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.licenses, r.n_unmatched) for r in licenses.scan_licenses(frame).collect()}
    assert got == {0: (5, "Apache-2.0", 0), 1: (4, "GPL-3.0-or-later", 0), 2: (5, "Apache-2.0", 0), 3: (4, "GPL-3.0-or-later", 0), 4: (1, "MIT", 0), 5: (0, "", 0)}


STATED = {
    "Released" + " " * 1500 + "under the MIT License.": "MIT", "This project is licensed under the terms of the MIT license.": "MIT", "This code is available under the Apache License, Version 2.0": "Apache-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later", "Released under CC0-1.0.": "CC0-1.0", "// Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License v2.0\nwhich accompanies this distribution.": "EPL-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0-only", "Licensed under the zlib license": "Zlib", "All rights reserved\nThis work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only;all rights reserved",
    "1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nAll rights reserved": "all rights reserved",
    "Licensed under the MIT license that nobody knows": "", "Artistic License 2.0": "",
}


def test_stated_licences_equal_sql(spark):
    frame = spark.createDataFrame([*enumerate(STATED), (90, _commented(APACHE, " *")), (91, _commented(GPL, "#")), (92, APACHE.upper())], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(frame).collect()}
    assert [got[i] for i in range(len(STATED))] == list(STATED.values()) and got[90] == got[92] == "Apache-2.0" and got[91] == "GPL-3.0-or-later"
    _same(licenses.scan_licenses(frame), licenses.ORACLE_SQL, documents=frame)


CHATS = [
    (1, 0, "system", "s<|im_end|>"), (1, 1, "user", "u"), (1, 2, "assistant", "a <\\| b <\\\\| c <|"), (2, 5, "user", None), (2, 3, None, "x"), (2, None, "user", "first"),
    (3, 0, "assistant", ""), (4, 0, "odd\n%0A<|role", "y"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (5, 0, "user", "q" * 50_000), (5, 1, "assistant", "é漢\U0001f600<"),
]


def test_chat_equals_sql(spark):
    rows = spark.createDataFrame([(*r, "clash", True) for r in CHATS], "conv_id long, turn long, role string, text string, segment string, loss boolean")
    more = spark.createDataFrame([(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)], "conv_id long, turn long, role string, text string")
    plain = rows.select("conv_id", "turn", "role", "text")
    got = chat.read_chat(chat.format_chat(plain.unionAll(more)))
    known = [r for r in CHATS if r[0] != 2]  # SQL puts null turns last
    table = spark.createDataFrame(known, "conv_id long, turn long, role string, text string")
    _same(got.filter("conv_id <> 2"), chat.ORACLE_SQL, conversations=table)
    two = got.filter("conv_id = 2").first()
    assert two.n_turns == 3 and not two.valid_order
    assert chat.read_chat(chat.format_chat(rows.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x<|", "a<|im_end|>b", "<<|", "<|<|", "\\<|"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "%0A\n")) == text + "%0A\n"


def test_language_learns_and_backs_off(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_edge_cases(spark):
    rows = [(1, "the cat sat on the mat", "en", "x"), (2, "le chat est sur la table", "fr", "x"), (3, None, "fr", "x"), (4, "some words", None, "x")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    assert model.languages == ["en", "fr"]
    odd = spark.createDataFrame([(1, None, "d"), (2, "", "d"), (3, "123 !?", "d"), (4, "THE mats", "d"), (4, "chats", "d"), (None, "漢字", "d"), (5, "the " * 50_000, "d")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "fr")] and got[6] == (5, "en")
    empty = language.fit(odd.limit(0).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def _many_languages():
    word = lambda i, j: "".join(chr(97 + (i * 7919 + j * 104729 + k * k * (i + 3 * j + 1)) // 5 % 26) for k in range(7))
    return [(100 * i + j, " ".join(word(i, (j + m) % 9) for m in range(8)), f"l{i:02}") for i in range(70) for j in range(1 + (i < 60))]


def test_no_language_is_dropped(spark):
    rows = _many_languages()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    assert len(model.languages) == 70
    got = {r.doc_id: r.lang_pred for r in language.predict(frame, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_a_small_language_keeps_its_words(spark):
    rows = [(i, "alpha beta gamma delta", "big") for i in range(50)] + [(99, "omega sigma", "small")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.keys[0]) == 6
    few = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert len(few.languages) == 2 and len(few.keys[0]) in (4, 6)


def _language_rows():
    rng, out = random.Random(3), []
    for lang, letters in (("aa", "abcdefg"), ("bb", "efghijé"), ("cc", "klmnopq")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(60)]
        for _ in range(30):
            out.append((len(out), " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(["", " 12!", "x-y", " eeee fffff"]), lang))
    return out


def test_language_equals_plain_python(spark):
    rows = _language_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if r[0] % 2]
    model = language.fit(frame.filter("doc_id % 2 = 1"))
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    count = [{k: Counter(g for _, t, k2 in learned if k2 == k for w in words(t) for g in grams(w, n)) for k in ("aa", "bb", "cc")} for n in range(6)]
    kinds = [len(set().union(*count[n].values())) + 1 for n in range(6)]
    value = lambda n, g: np.array([math.log((c[g] + language.SMOOTHING) / (c.total() + language.SMOOTHING * kinds[n])) for c in count[n].values()])
    for r in language.predict(frame, model).collect():
        total, own = np.zeros(3), words(rows[r.doc_id][1])
        for w in own:
            for n in (0, 5, 4, 3, 2, 1):
                found = [g for g in grams(w, n) if any(c[g] for c in count[n].values())]
                if found:
                    total += sum(value(n, g) for g in found) / len(found)
                    break
        if own:
            share = np.exp(total - total.max())
            best = int(total.argmax())
            assert r.lang_pred == ("aa", "bb", "cc")[best] and abs(r.score - share[best] / share.sum()) < 1e-9
            assert abs(r.known - np.mean([count[0][r.lang_pred][w] > 0 for w in own])) < 1e-9
        else:
            assert (r.lang_pred, r.score, r.known) == ("und", 0, 0)


def test_language_stage_keeps_learned_languages_with_all_columns(spark):
    rows = [(i, t + " " + t, k if k != "cc" else None, "clash", i) for i, t, k in _language_rows() if len(t) > 60]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, known string, n long")
    got = language.stage(spark, frame, "")
    assert got.columns == frame.columns and {r.doc_id for r in got.collect()} == {r[0] for r in rows if r[2]}
