"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, marks and white space to single spaces) and mapped to the
identifier of a known license sentence or to 0. A known sentence may be wrapped over lines, with comment marks or blank
lines between; it counts as one, from the line or sentence it starts with to that it ends with. Sentences may have places for
names of holders and subjects. Short notices ("X is licensed under the ...") and SPDX lines are built from names and
identifiers; each license of a notice or SPDX expression that has several ("A or B", "A WITH x AND B") is a sentence of its
own, and identifiers that SPDX has replaced count as those that replaced them. Ordered rules are sequences of identifiers; a rule matches where its
identifiers follow each other in the text. Longer rules come first, and a rule that lies inside an earlier match of a
longer one is not reported for it. Nothing is shuffled: all steps are expressions over one row, and only rows with an
anchor word of some known sentence are cut into sentences.

Defined results: null or empty text matches nothing; rows that match nothing are not returned; repeated rows are returned
each; a sentence that occurs twice counts twice; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of licenses and notices, as published, each with its number.
SENTENCES = {
    5: 'Licensed under the Apache License, Version 2.0 (the "License");',
    6: "you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    9: "See the License for the specific language governing permissions and limitations under the License.",
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    13: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    14: "{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    15: "{subject} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    16: "{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    17: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    18: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    19: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    20: "Neither the name of {holder} nor the names of {its} contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    25: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    22: "{subject} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    23: "{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    24: "{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    27: "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {holder}.",
    28: "The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    29: "{subject} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    30: "{subject} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    31: "{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    26: "This is free and unencumbered software released into the public domain.",
}
# Rules in order, (name of the license, sentence numbers in sequence); longer rules first.
RULES = [
    ("Apache-2.0", (5, 6, 7, 8, 9)),
    ("MIT", (10, 11, 12, 13)),
    ("BSD-4-Clause", (17, 18, 19, 27, 20)),
    ("BSD-4-Clause", (17, 18, 19, 27, 28)),
    ("BSD-3-Clause", (17, 18, 19, 20)),
    ("BSD-3-Clause", (17, 18, 19, 28)),
    ("BSD-4-Clause", (17, 18, 19, 27)),
    ("BSD-2-Clause", (17, 18, 19)),
    ("GPL-3.0-or-later", (14, 16)),
    ("GPL-2.0-or-later", (15, 16)),
    ("GPL-2.0-only", (29, 16)),
    ("LGPL-2.1-or-later", (22, 31)),
    ("LGPL-2.1-or-later", (22, 16)),
    ("LGPL-2.0-or-later", (30, 31)),
    ("LGPL-2.0-or-later", (30, 16)),
    ("LGPL-3.0-or-later", (23, 31)),
    ("LGPL-3.0-or-later", (23, 16)),
    ("AGPL-3.0-or-later", (24, 16)),
    ("Apache-2.0", (5, 6)),
    ("MIT", (10, 11)),
    ("GPL-3.0-or-later", (14,)),
    ("GPL-2.0-or-later", (15,)),
    ("GPL-2.0-only", (29,)),
    ("LGPL-2.1-or-later", (22,)),
    ("LGPL-2.0-or-later", (30,)),
    ("LGPL-3.0-or-later", (23,)),
    ("AGPL-3.0-or-later", (24,)),
    ("ISC", (21,)),
    ("MPL-2.0", (25,)),
    ("Unlicense", (26,)),
]
# SPDX identifiers, each known as the sentence "SPDX-License-Identifier: X".
SPDX = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-2.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 "
    "OpenSSL PHP-3.01 PostgreSQL Python-2.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
# How licenses are called in short notices.
NAMES = {
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
    "MIT": ["MIT License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
# Licenses of one version are those "or later" too, where a notice says so.
NAMES |= {name.removesuffix("-only") + "-or-later": [x + y for x in called for y in (" or later", "+")] for name, called in NAMES.items() if name.endswith("-only")}
# SPDX identifiers that others have replaced.
REPLACED = {f"{family}-{version}{plus}": f"{family}-{version}-{'or-later' if plus else 'only'}" for family, versions in (("GPL", "1.0 2.0 3.0"), ("LGPL", "2.0 2.1 3.0"), ("AGPL", "1.0 3.0"), ("GFDL", "1.2 1.3")) for version in versions.split() for plus in ("", "+")}
# How such a notice begins, with or without "the" before the name, and what may follow it.
LEADS = ["available", "dedicated", "distributed", "licensed", "made available", "offered", "provided", "published", "released"]
SUBJECTS = ["all code", "it", "the code", "the software", "this", "this code", "this document", "this file", "this library", "this package", "this program", "this project", "this repository", "this software", "this work"]
TAILS = ["see", "for details", "at your option", "in", "by", "with", "as", "unless", "copyright"]
NOTICE, IDENTIFIER = 100, 200  # numbers of the sentences of NAMES and of SPDX, in order
RULES += [(name, (NOTICE + i,)) for i, name in enumerate(NAMES)] + [(name, (IDENTIFIER + i,)) for i, name in enumerate(SPDX)]
# A known sentence holds at least one of these; other rows need no closer look.
ANCHORS = ("licens", "permission", "redistribut", "warrant", "holders", "free software", "unencumbered", "contributors", "in no event", "advertising", "endorse", "gpl", "apache", "cc by", "cc-by", "cc0", "creative commons", "mozilla", "boost", "mpl 2", "mpl-2", "epl 2", "epl-2")
# So does a notice of the one name that is a word of some language.
ANCHOR = "under[^a-z]+(?:the[^a-z]+)?(?:terms[^a-z]+of[^a-z]+(?:the[^a-z]+)?)?(?:either[^a-z]+of[^a-z]+)?(?:the[^a-z]+)?mit"
# The colon of an SPDX line does not end a sentence.
COLON = "license-identifier[ \t]*:"
# A sentence ends at a line feed, or at an end mark followed by white space, which then counts as a line feed.
ENDS = r"([.!?;:])[ \t\r]+"
MARKS = r"[^\p{L}\p{N}]+"
# What stands between words of a known sentence: pieces are joined by two line feeds.
GAP = r"(?: |\n\n)"
# Conditions that are often numbered, and what such a number becomes.
NUMBERED = (18, 19, 20, 27, 28)
NUMBER = rf"(?:(?:[0-9]{{1,2}}|[a-c]){GAP})?"


def normalise(sentence: str) -> str:
    """What expressions below make of a sentence, for the tables of known ones (ASCII)."""
    plain = re.sub(r"[^a-z0-9]+", " ", re.sub("([0-9])[+]", r"\1 plus", sentence.lower())).strip()
    return re.sub(" or (any )?later( version)?", " orlater", plain)


WORD = "[^ \n#]+"
# Places of a sentence: up to twelve words of holders, up to six of a subject, and a word that may be missing.
PLACES = {"holder": f"{WORD}(?:{GAP}{WORD}){{0,11}}?", "subject": f"{WORD}(?: {WORD}){{0,5}}?"}


def spaced(words: str) -> str:
    return GAP.join(words.split())


def sentence_pattern(sentence: str) -> str:
    out = spaced(normalise(re.sub(r"\{(\w+)\}", r" zz\1 ", sentence)))
    out = out.replace(f"zzits{GAP}", f"(?:(?:its|his|her|their|the|any|other){GAP})?")
    for place, pattern in PLACES.items():
        out = out.replace(f"zz{place}", pattern)
    return out


def either(many: list[str]) -> str:
    return "(?:" + "|".join(spaced(normalise(x)) for x in sorted(many, key=len, reverse=True)) + ")"


def patterns() -> list[tuple[str, str]]:
    """(pattern, what it becomes) of pieces between line feeds, in order; a number in braces is a group.

    First the beginning of a notice becomes "#under", and notices of several licenses become several; then known sentences, those of
    more words first, and notices become "#number".
    """
    long_: dict[str, int] = {}
    for number, sentence in SENTENCES.items():
        if long_.setdefault(normalise(sentence), number) != number:
            raise ValueError(f"sentence {number} is known twice")
    subject = f"(?:(?:{either(SUBJECTS)}|{PLACES['subject']}){GAP}(?:is|are)(?:{GAP}(?:also|dual))?{GAP})?(?:dual{GAP})?"
    lead = f"\n{subject}{either(LEADS)}{GAP}under{GAP}(?:either{GAP}(?:of{GAP})?)?(?:(?:the|an?){GAP})?(?:terms{GAP}of{GAP}(?:the{GAP}|either{GAP})?)?"
    some = either([x for names in NAMES.values() for x in names])
    several = f"\n#under ({some}(?:{GAP}license)?)(?:{GAP}license)?{GAP}(?:or|and){GAP}(?:under{GAP})?(?:(?:the|an?){GAP})?"
    sentences = [((NUMBER if number in NUMBERED else "") + sentence_pattern(SENTENCES[number]), number) for number in sorted(long_.values(), key=lambda n: -len(SENTENCES[n]))]
    tail = f"(?:{GAP}license)?(?:{GAP}{either(TAILS)}(?:{GAP}{WORD}){{0,20}}?)?"
    later = lambda name: "" if name.endswith(("-only", "-or-later")) else "(?: orlater)?"  # noqa: E731  which says nothing of these
    notices = [(f"#under {either(called)}{later(name)}{tail}", NOTICE + i) for i, (name, called) in enumerate(NAMES.items())]
    return [(f"{GAP}or{GAP}(?:any{GAP})?later(?:{GAP}version)?", " orlater"), *((f"\n{p}\n", f"\n#{n}\n") for p, n in sentences), (lead, "\n#under "), (several, "\n#under {1}\n\n#under "), (several, "\n#under {1}\n\n#under "), *((f"\n{p}\n", f"\n#{n}\n") for p, n in notices)]


LINE = "spdx license identifier "


def identifiers() -> dict[str, int]:
    """Parts of an SPDX expression and their numbers."""
    own = {x: IDENTIFIER + i for i, x in enumerate(SPDX)}
    return {normalise(x): n for x, n in own.items()} | {normalise(x): own[y] for x, y in REPLACED.items() if y in own}


def numbers() -> dict[str, int]:
    """What a sentence is after known ones became "#number", or a part of an SPDX line -> its number."""
    known = [*SENTENCES, *(NOTICE + i for i in range(len(NAMES)))]
    return {f"#{n}": n for n in known} | {LINE + x: n for x, n in identifiers().items()}


def sequence(text: Column) -> Column:
    """Identifiers of the sentences of a text, in order, as ',n,,n,' text with 0 for unknown ones; blanks are left out."""
    table = F.create_map(*(F.lit(x) for pair in numbers().items() for x in pair))
    low = F.regexp_replace(F.regexp_replace(F.lower(text), COLON, "license-identifier "), r"([0-9])\+", "$1 plus ")
    whole = F.regexp_replace(low, ENDS, "$1\n")
    clean = F.filter(F.transform(F.split(whole, "\n"), lambda s: F.trim(F.regexp_replace(s, MARKS, " "))), lambda s: s != "")
    # each piece stands between line feeds; all pieces of a known sentence together become its number
    marked = F.concat(F.lit("\n"), F.array_join(clean, "\n\n"), F.lit("\n"))
    for pattern, becomes in patterns():
        marked = F.regexp_replace(marked, pattern, becomes.replace("{1}", "$1"))
    # an SPDX expression is its identifiers, whatever exceptions they have
    parts = lambda s: F.transform(F.split(F.substr(s, F.lit(len(LINE) + 1)), " (?:or|and) "), lambda x: F.concat(F.lit(LINE), F.regexp_replace(x, " with .*$", "")))
    each = F.flatten(F.transform(F.filter(F.split(marked, "\n"), lambda s: s != ""), lambda s: F.when(F.startswith(s, F.lit(LINE)), parts(s)).otherwise(F.array(s))))
    found = F.transform(each, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0)))
    return F.array_join(F.transform(found, lambda n: F.concat(F.lit(","), n.cast("string"), F.lit(","))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, rule (its number from 1), n_hits and first_sentence (1 for the first) of each rule that matches."""
    low = F.lower(F.col(text))
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | F.contains(low, F.lit(word))
    rows = docs.where(anchored | low.rlike(ANCHOR)).select(F.col(id_col).alias(id_col), sequence(F.col(text)).alias("seq")).where(F.col("seq").rlike("[1-9]"))
    left, found, single = F.col("seq"), [], {}
    for i, (name, ids) in enumerate(RULES, 1):
        if len(ids) == 1:
            single[ids[0]] = (name, i)
            continue
        pattern = "".join(f",{n}," for n in ids)
        n = F.floor((F.length(left) - F.length(F.replace(left, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")
        at = (F.floor((F.length(F.regexp_replace(F.substring_index(left, pattern, 1), "[^,]", "")) + 1) / 2) + 1).cast("long")
        found.append(F.struct(F.lit(name).alias("license"), F.lit(i).alias("rule"), n.alias("n_hits"), at.alias("first_sentence")))
        # what a rule matches becomes as many 0 sentences, so that no later rule finds it again
        left = F.replace(left, F.lit(pattern), F.lit(",0," * len(ids)))
    # rules of one sentence come after all others and cannot take anything from each other
    names = F.create_map(*(F.lit(x) for n, (name, _) in single.items() for x in (f",{n},", name)))
    order = F.create_map(*(F.lit(x) for n, (_, i) in single.items() for x in (f",{n},", i)))
    rows = rows.select(id_col, F.filter(F.array(*found), lambda r: r["n_hits"] > 0).alias("long"), F.regexp_extract_all(left, F.lit("(,[0-9]+,)"), 1).alias("rest"))
    one = lambda x: F.struct(names[x].alias("license"), order[x].alias("rule"), F.size(F.filter("rest", lambda y: y == x)).cast("long").alias("n_hits"), F.array_position("rest", x).cast("long").alias("first_sentence"))
    single_hits = F.transform(F.filter(F.array_distinct("rest"), lambda x: F.map_contains_key(names, x)), one)
    return rows.select(id_col, F.explode(F.concat("long", single_hits)).alias("hit")).select(id_col, "hit.license", "hit.rule", "hit.n_hits", "hit.first_sentence")


def oracle() -> str:
    """The scan of documents in DuckDB SQL."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(k)}: {v}" for k, v in numbers().items()) + "}"
    anchors = " OR ".join([*(f"contains(lower(text), {quote(a)})" for a in ANCHORS), f"regexp_matches(lower(text), '{ANCHOR}')"])
    whole = f"regexp_replace(regexp_replace(regexp_replace(lower(text), '{COLON}', 'license-identifier ', 'g'), '([0-9])\\+', '\\1 plus ', 'g'), '{ENDS}', '\\1' || chr(10), 'g')"
    clean = f"list_filter(list_transform(string_split({whole}, chr(10)), lambda s: trim(regexp_replace(s, '{MARKS}', ' ', 'g'))), lambda s: s <> '')"
    steps = [f"m0 AS (SELECT doc_id, chr(10) || array_to_string({clean}, chr(10) || chr(10)) || chr(10) AS m FROM documents WHERE {anchors})"]
    for i, (pattern, becomes) in enumerate(patterns(), 1):
        said = becomes.replace("{1}", "\\1").replace("\n", "' || chr(10) || '")
        steps.append(f"m{i} AS (SELECT doc_id, regexp_replace(m, '{pattern}', '{said}', 'g') AS m FROM m{i - 1})")
    parts = f"list_transform(regexp_split_to_array(substr(s, {len(LINE) + 1}), ' (?:or|and) '), lambda x: '{LINE}' || regexp_replace(x, ' with .*$', ''))"
    each = f"flatten(list_transform(list_filter(string_split(m, chr(10)), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, '{LINE}') THEN {parts} ELSE [s] END))"
    steps.append(f"l0 AS (SELECT doc_id, array_to_string(list_transform({each}, lambda s: ',' || coalesce({table}[s], 0) || ','), '') AS s0 FROM m{len(patterns())})")
    last, hits = "l0", []
    for i, (name, ids) in enumerate(RULES, 1):
        p = "".join(f",{n}," for n in ids)
        hits.append(
            f"SELECT doc_id, {quote(name)} AS license, {i} AS rule, CAST((length(s) - length(replace(s, '{p}', ''))) // {len(p)} AS BIGINT) AS n_hits, "
            f"CAST(length(regexp_replace(split_part(s, '{p}', 1), '[^,]', '', 'g')) // 2 + 1 AS BIGINT) AS first_sentence FROM (SELECT doc_id, s{last[1:]} AS s FROM {last}) WHERE contains(s, '{p}')"
        )
        if len(ids) > 1:
            steps.append(f"l{i} AS (SELECT doc_id, replace(s{last[1:]}, '{p}', '{',0,' * len(ids)}') AS s{i} FROM {last})")
            last = f"l{i}"
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(hits)}"
