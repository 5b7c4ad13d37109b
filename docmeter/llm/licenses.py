"""License scans by sentence rules: known sentences to identifiers, identifier sequences to ordered licence rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, and names besides the identifier, of each licence that a sentence can state ("licensed under the ..."): all
#: normalised (lower case, other characters than a-z and 0-9 to one space).
LICENCES = {
    "MIT": ("permissive", "mit license", "expat license"),
    "Apache-2.0": ("permissive", "apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "BSD-2-Clause": ("permissive", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("permissive", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("permissive", "isc license"),
    "Zlib": ("permissive", "zlib license"),
    "BSL-1.0": ("permissive", "boost software license version 1 0", "boost software license 1 0"),
    "Artistic-2.0": ("permissive", "artistic license 2 0", "artistic license version 2 0"),
    "Unlicense": ("permissive", "the unlicense"),
    "CC0-1.0": ("permissive", "cc0 1 0 universal license", "cc0 license", "creative commons zero v1 0 universal license"),
    "CC-BY-4.0": ("permissive", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"),
    "CC-BY-SA-4.0": ("copyleft", "creative commons attribution sharealike 4 0 international license", "creative commons attribution share alike 4 0 international license"),
    "CC-BY-NC-4.0": ("noncommercial", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution non commercial 4 0 international license"),
    "GPL-2.0-only": ("copyleft", "gnu general public license version 2", "gnu gpl version 2", "gpl version 2", "gnu gpl v2", "gpl v2", "gplv2"),
    "GPL-2.0-or-later": ("copyleft", "gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gpl v2 or later"),
    "GPL-3.0-only": ("copyleft", "gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gnu gpl v3", "gpl v3", "gplv3"),
    "GPL-3.0-or-later": ("copyleft", "gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gpl v3 or later"),
    "LGPL-2.1-only": ("copyleft", "gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgpl v2 1"),
    "LGPL-2.1-or-later": ("copyleft", "gnu lesser general public license version 2 1 or later", "lgpl v2 1 or later"),
    "LGPL-3.0-only": ("copyleft", "gnu lesser general public license version 3", "gnu lgpl version 3", "lgpl v3"),
    "LGPL-3.0-or-later": ("copyleft", "gnu lesser general public license version 3 or later", "lgpl v3 or later"),
    "AGPL-3.0-only": ("copyleft", "gnu affero general public license version 3", "gnu agpl version 3", "agpl v3", "agplv3"),
    "AGPL-3.0-or-later": ("copyleft", "gnu affero general public license version 3 or later", "agpl v3 or later"),
    "MPL-2.0": ("copyleft", "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "EPL-1.0": ("copyleft", "eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license v1 0 which accompanies this distribution"),
    "EPL-2.0": ("copyleft", "eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v2 0 which accompanies this distribution", "eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    "CDDL-1.0": ("copyleft", "common development and distribution license version 1 0", "common development and distribution license 1 0"),
}

#: Other known sentences by identifier, normalised likewise.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-header": "licensed under apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-terms": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "asf-header": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "asf-notice": "see the notice file distributed with this work for additional information regarding copyright ownership",
    "asf-licenses": "the asf licenses this file to you under the apache license version 2 0 the license",
    "gpl2-only-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-header": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-header": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl3-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cddl-header": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "artistic2-use": "you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version",
    "cc0-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "reserved": "all rights reserved",
}
#: One sentence for each way to state a licence: its identifier and its names in plain words, and its SPDX tag.
SENTENCES |= {
    f"{how} {licence}#{k}": f"{words} {name}"
    for licence, (_, *names) in LICENCES.items()
    for how, words, said in (("states", "licensed under", [re.sub("[^a-z0-9]+", " ", licence.lower()), *names]), ("tag", "spdx license identifier", [re.sub("[^a-z0-9]+", " ", licence.lower())]))
    for k, name in enumerate(said)
}


@dataclass(frozen=True)
class Rule:
    """A licence and the sentences that stand for it, one after the other among a text's known sentences."""

    licence: str
    kind: str
    sentences: tuple[str, ...]


#: The first rule that matches takes its sentences, so that a rule stands before those that it contains.
RULES = (
    Rule("Apache-2.0", "permissive", ("apache-header", "apache-compliance", "apache-copy", "apache-warranty", "apache-terms")),
    Rule("BSD-3-Clause", "permissive", ("bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")),
    Rule("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    Rule("GPL-3.0-or-later", "copyleft", ("gpl3-header", "gpl-hope", "gpl-warranty", "gpl-details")),
    Rule("GPL-2.0-or-later", "copyleft", ("gpl2-header", "gpl-hope", "gpl-warranty", "gpl-details")),
    Rule("BSD-2-Clause", "permissive", ("bsd-source", "bsd-binary", "bsd-warranty")),
    Rule("GPL-3.0-or-later", "copyleft", ("gpl3-header",)),
    Rule("GPL-2.0-or-later", "copyleft", ("gpl2-header",)),
    Rule("MIT", "permissive", ("mit-grant",)),
    Rule("Apache-2.0", "permissive", ("apache-header",)),
    Rule("Apache-2.0", "permissive", ("asf-header", "asf-notice", "asf-licenses", "apache-compliance", "apache-copy", "apache-warranty", "apache-terms")),
    Rule("Apache-2.0", "permissive", ("asf-licenses",)),
    Rule("Apache-2.0", "permissive", ("asf-header",)),
    Rule("GPL-2.0-only", "copyleft", ("gpl2-only-header", "gpl-hope", "gpl-warranty", "gpl-details")),
    Rule("GPL-2.0-only", "copyleft", ("gpl2-only-header",)),
    Rule("LGPL-2.1-or-later", "copyleft", ("lgpl21-header", "lgpl-hope", "gpl-warranty", "lgpl-details")),
    Rule("LGPL-2.1-or-later", "copyleft", ("lgpl21-header",)),
    Rule("LGPL-3.0-or-later", "copyleft", ("lgpl3-header", "lgpl-hope", "gpl-warranty", "lgpl-details")),
    Rule("LGPL-3.0-or-later", "copyleft", ("lgpl3-header",)),
    Rule("AGPL-3.0-or-later", "copyleft", ("agpl3-header", "gpl-hope", "gpl-warranty", "agpl-details")),
    Rule("AGPL-3.0-or-later", "copyleft", ("agpl3-header",)),
    Rule("Zlib", "permissive", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    Rule("Zlib", "permissive", ("zlib-grant",)),
    Rule("BSL-1.0", "permissive", ("boost-grant",)),
    Rule("CDDL-1.0", "copyleft", ("cddl-header", "apache-compliance")),
    Rule("CDDL-1.0", "copyleft", ("cddl-header",)),
    Rule("Artistic-2.0", "permissive", ("artistic2-use",)),
    Rule("CC0-1.0", "permissive", ("cc0-waived",)),
    Rule("ISC", "permissive", ("isc-grant", "isc-warranty")),
    Rule("ISC", "permissive", ("isc-grant",)),
    Rule("MPL-2.0", "copyleft", ("mpl2-form",)),
    Rule("Unlicense", "permissive", ("unlicense-domain",)),
    Rule("all rights reserved", "reserved", ("reserved",)),
    *(Rule(licence, kind, (k,)) for licence, (kind, *_) in LICENCES.items() for k in SENTENCES if k.startswith((f"states {licence}#", f"tag {licence}#"))),
)
KINDS = ("reserved", "noncommercial", "copyleft", "permissive")

_SPACE = r"[\x20\x09-\x0D]"
#: Where a sentence ends besides line ends: marks before white space or the end.
_MARKS = rf"[.;!?]+({_SPACE}+|\z)|\x01"
#: Every known sentence holds one of these within a word, so that a text without any has no known sentence.
ANCHORS = ("licen", "reserved", "redistribut", "warranty", "permi", "software", "released", "distributed", "published", "available", "waived")


#: Between words of a sentence: every line break stands twice, for a match takes one with each line that it bounds.
_GAP = r"(?: |\n\n)"


def _any_of(sentences: list[str]) -> str:
    return "|".join(x.replace(" ", _GAP) for x in sorted(sentences, key=len, reverse=True))


_ANY_KNOWN = rf"\n(?:{_any_of(list(SENTENCES.values()))})\n"
#: A stated licence, whatever words it begins with.
_STATED = (
    rf"\n(?:(?:[a-z0-9]+ ){{1,7}}(?:is|are){_GAP})?(?:licensed|released|distributed|published|(?:made{_GAP})?available){_GAP}under{_GAP}(?:the{_GAP}terms{_GAP}of{_GAP})?(?:(?:the|a|an){_GAP})?"
    rf"({_any_of([x.removeprefix('licensed under ') for x in SENTENCES.values() if x.startswith('licensed under ')])})\n"
)


def _known(text: Column) -> Column:
    """Positions in SENTENCES (from 1) of a lower-cased text's known sentences, in order.

    A known sentence starts and ends where a line or a sentence does, and may run over any such places within; of two
    that start at one place the longer counts.
    """
    names = F.array(*[F.lit(x) for x in SENTENCES.values()])
    pieces = F.regexp_replace(F.regexp_replace(text, _MARKS, "\n"), "[^a-z0-9\n]+", " ")
    pieces = F.concat(F.lit("\n"), F.regexp_replace(pieces, r"[ \n]*\n[ \n]*", "\n"), F.lit("\n"))
    pieces = F.regexp_replace(F.regexp_replace(pieces, r"^\n ", "\n"), r" \n\z", "\n")
    pieces = F.regexp_replace(F.replace(pieces, F.lit("\n"), F.lit("\n\n")), _STATED, "\nlicensed under $1\n")
    found = F.regexp_extract_all(pieces, F.lit(_ANY_KNOWN), F.lit(0))
    return F.transform(found, lambda s: F.array_position(names, F.trim(F.replace(F.replace(s, F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit("")))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences`` (known ones), ``licenses`` (sorted, joined by ``;``), ``kind`` (the strictest of
    ``reserved, noncommercial, copyleft, permissive``, or ``none``) and ``n_unmatched`` (known sentences in no rule).

    A known sentence counts wherever it starts and ends at a line end or a sentence end, so that comment marks, wrapped
    lines and an unpunctuated line before it hide none.
    Rules are tried in order on what earlier ones left; a rule matches as often as its sentences follow each other.
    Null, empty and very long texts are treated alike (null: nothing known). Repeated rows and null ids keep a row each;
    other columns are not read; an empty table gives an empty one. One pass without a shuffle, in expressions only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    some, nothing = reduce(or_, [F.contains("text", F.lit(x)) for x in ANCHORS]), F.array().cast("array<bigint>")
    rows = rows.select("doc_id", F.when(some, _known(F.col("text"))).otherwise(nothing).alias("known"))
    number = {k: i + 1 for i, k in enumerate(SENTENCES)}
    rules = F.array(*[F.struct(F.lit("".join(f"<{number[s]}>" for s in r.sentences)).alias("ids"), F.lit(r.licence).alias("licence"), F.lit(r.kind).alias("kind")) for r in RULES])
    start = F.struct(F.array_join(F.transform("known", lambda k: F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"), F.array().cast("array<string>").alias("kinds"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        more = lambda have, x: F.when(hit, F.array_append(have, x)).otherwise(have)
        return F.struct(F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"), more(state["found"], rule["licence"]).alias("found"), more(state["kinds"], rule["kind"]).alias("kinds"))

    rows = rows.withColumn("state", F.when(F.size("known") > 0, F.aggregate(rules, start, step)))
    kind = F.lit("none")
    for name in reversed(KINDS):
        kind = F.when(F.array_contains("state.kinds", name), name).otherwise(kind)
    return rows.select(
        "doc_id",
        F.size("known").cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("state.found")), ";"), F.lit("")).alias("licenses"),
        kind.alias("kind"),
        F.coalesce(F.length("state.left") - F.length(F.replace("state.left", F.lit("<"))), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    number = {k: i + 1 for i, k in enumerate(SENTENCES)}
    steps, before = [], "s0"
    for i, r in enumerate(RULES):
        ids = "".join(f"<{number[s]}>" for s in r.sentences)
        steps.append(f"s{i + 1} AS (SELECT r, replace(rest, '{ids}', '|') AS rest, CASE WHEN contains(rest, '{ids}') THEN list_append(found, '{r.licence}') ELSE found END AS found, CASE WHEN contains(rest, '{ids}') THEN list_append(kinds, '{r.kind}') ELSE kinds END AS kinds FROM {before})")
        before = f"s{i + 1}"
    names = ", ".join(f"'{x}'" for x in SENTENCES.values())
    order = " ".join(f"WHEN list_contains(kinds, '{k}') THEN '{k}'" for k in KINDS)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, lower(coalesce(text, '')) AS text FROM documents),
p AS (SELECT doc_id, r, regexp_replace(regexp_replace(text, '{_MARKS}', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM d),
q AS (SELECT doc_id, r, regexp_replace(regexp_replace(chr(10) || regexp_replace(t, '[ \n]*\n[ \n]*', chr(10), 'g') || chr(10), '^\n ', chr(10)), ' \n\z', chr(10)) AS t FROM p),
n AS (SELECT doc_id, r, list_transform(regexp_extract_all(regexp_replace(replace(t, chr(10), chr(10) || chr(10)), '{_STATED}', chr(10) || 'licensed under \1' || chr(10), 'g'), '{_ANY_KNOWN}'), lambda s: list_position([{names}], trim(replace(replace(s, chr(10) || chr(10), ' '), chr(10), '')))) AS known FROM q),
s0 AS (SELECT r, array_to_string(list_transform(known, lambda x: '<' || x || '>'), '') AS rest, []::VARCHAR[] AS found, []::VARCHAR[] AS kinds FROM n WHERE len(known) > 0),
{", ".join(steps)}
SELECT doc_id, len(known)::BIGINT AS n_sentences, coalesce(array_to_string(list_sort(list_distinct(found)), ';'), '') AS licenses, CASE {order} ELSE 'none' END AS kind, coalesce(length(rest) - length(replace(rest, '<', '')), 0)::BIGINT AS n_unmatched
FROM n LEFT JOIN {before} USING (r)
"""


ORACLE_SQL = _oracle()
