"""Licence scans by sentence rules, in DataFrame functions.

A text is cut into pieces at line ends and after ``.``, ``!``, ``?`` or ``;`` before white space.
Pieces are normalised (A-Z lower-cased, everything but a-z, 0-9 and points between digits becomes
one space, so comment marks go too). A piece, or pieces on consecutive lines that no sentence end or
blank line parts, are looked up among known licence sentences, the longest first. What is known gives
a sequence of identifiers; a licence rule is an ordered sequence of identifiers and matches where
the sequence holds it without a gap (other sentences in between do not count). The sequence is read
from left to right; at each place the longest rule matches, and its identifiers are used up, so a rule
that is part of a longer match says nothing.

Results: a row per input row, with ``sentence_ids`` (in order, with repeats) and ``licences``
(sorted, distinct; empty where nothing matches, also for null and empty texts). Texts and sentences
are read whole, however long; repeated rows repeat their results. Columns of the documents named
sentence_ids or licences (any case) give way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences by identifier, as licences and notices commonly state them (fixed values).
SENTENCES: dict[str, list[str]] = {
    "all-rights": ["All rights reserved."],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "Distributed under the MIT License.", "The MIT License (MIT)", "The MIT License", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Licensed under the Apache License, Version 2.0 (the \"License\").", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "Apache License, Version 2.0", "Apache License 2.0"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "Licensed under the GNU GPL version 3.", "Released under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "Released under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "gpl-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-only-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-fitness": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-redistribute": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "agpl-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "later-2": ["either version 2 of the License, or (at your option) any later version."],
    "later-2.1": ["either version 2.1 of the License, or (at your option) any later version."],
    "later-3": ["either version 3 of the License, or (at your option) any later version."],
    "only-2": ["version 2 of the License."],
    "lgpl3-notice": ["Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License v3.0."],
    "lgpl2.1-notice": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License v2.1."],
    "agpl-notice": ["Licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0."],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-sa-notice": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nd-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-notice": ["To the extent possible under law, the author has waived all copyright and related rights.", "Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd2-notice": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd3-notice": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-notice": ["ISC License", "Licensed under the ISC License."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "zlib-origin": ["The origin of this software must not be misrepresented;"],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "boost-grant": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0."],
}

#: Licence rules: a licence and an ordered sequence of sentence identifiers.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-3.0-or-later", ["gpl-terms", "later-3"]),
    ("GPL-3.0", ["gpl-only-3"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-2.0", ["gpl-terms", "only-2"]),
    ("GPL-2.0-or-later", ["gpl-terms", "later-2"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "later-3"]),
    ("LGPL-2.1", ["lgpl2.1-notice"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "later-2.1"]),
    ("LGPL-2.0-or-later", ["lgpl-terms", "later-2"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Zlib", ["zlib-origin", "zlib-altered"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-2.0", ["epl-notice"]),
    ("All-Rights-Reserved", ["all-rights"]),
]

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """The normal form of a sentence, as the expressions below make it."""
    s = sentence.translate(str.maketrans(UPPER, LOWERED))
    s = re.sub("[^a-z0-9.]+", " ", s)
    return re.sub(r"[. ]+( |$)", r"\1", s).strip(" .")


def known() -> dict[str, str]:
    """Normal form to identifier. A sentence with inner ends (``v. 2.0``) is known by its longest piece."""
    out = {}
    for name, sentences in SENTENCES.items():
        for s in sentences:
            pieces = [normalised(p) for p in re.split(r"(?<=[.!?;])\s+", s)]
            out[max(pieces, key=len)] = name
    return out


def pieces(text: Column) -> Column:
    """The text in normal form, cut into pieces: a line feed where a sentence, paragraph or comment block ends, a carriage return where only a line ends."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")
    s = F.regexp_replace(s, r"(?m)^[ \t]*[;!]+[ \t]+", "")  # comment marks that would end a sentence; others have no letters and go below
    s = F.regexp_replace(s, r"([.!?;])[ \t\r\n]+", "$1\u0001")
    s = F.regexp_replace(s, "[\r\n][^A-Za-z0-9]*[\r\n]", "\u0001")
    s = F.translate(s, UPPER + "\r\n\u0001", LOWERED + "\r\r\n")
    s = F.regexp_replace(s, "[^a-z0-9.\r\n]+", " ")
    s = F.regexp_replace(s, "[. ]+([ \r\n]|$)", "$1")
    s = F.regexp_replace(F.concat(F.lit("\n"), s, F.lit("\n")), "([\r\n]) +", "$1")
    return F.regexp_replace(s, "\r*\n[\r\n]*", "\n")


def telling() -> list[str]:
    """Words of which every known sentence has one: by cover, then length."""
    left = {s: {w for w in s.split() if w.isalpha() and len(w) > 3} or {w for w in s.split() if w.isalpha()} for s in known()}
    out = []
    while left:
        words = sorted({w for ws in left.values() for w in ws})
        out.append(max(words, key=lambda w: (sum(w in ws for ws in left.values()), len(w))))
        left = {s: ws for s, ws in left.items() if out[-1] not in ws}
    return out


def _either(line_end: str) -> str:
    """All known sentences, the longest first, where ``line_end`` may stand for a space."""
    longest = sorted(known(), key=lambda s: (-len(s), s))
    return "|".join(s.replace(".", "[.]").replace(" ", f"(?: |{line_end})") for s in longest)


def _sequences() -> dict[str, str]:
    """The rules as strings of identifiers (each between two spaces) to their licence, the longest first."""
    return {" " + "  ".join(ids) + " ": name for name, ids in sorted(RULES, key=lambda r: (-len(r[1]), r))}


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licences (columns of those names give way)."""
    look_up = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    pairs, rules = look_up(known()), look_up(_sequences())
    none = F.array().cast("array<string>")
    likely = F.col(text).rlike("(?i)" + "|".join(telling()))
    either = "[\r\n](" + _either("\r") + ")(?=[\r\n])"
    found = F.transform(F.regexp_extract_all(pieces(F.col(text)), F.lit(either), F.lit(1)), lambda s: F.element_at(pairs, F.translate(s, "\r", " ")))
    drop = [c for c in docs.columns if c.lower() in ("sentence_ids", "licences") and c != text]
    df = docs.drop(*drop).withColumn("sentence_ids", F.when(likely, found).otherwise(none))
    joined = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    hits = F.regexp_extract_all(joined, F.lit("(" + "|".join(s.replace(".", "[.]") for s in _sequences()) + ")"), F.lit(1))
    licences = F.sort_array(F.array_distinct(F.transform(hits, lambda s: F.element_at(rules, s))))
    return df.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences).otherwise(none))


def oracle() -> str:
    """DuckDB SQL for scanned(documents) as (doc_id, n_sentences, sentence_ids, licences).

    Line and sentence ends are doubled, so that one match ends with the first and the next begins with the second.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = " UNION ALL ".join(f"SELECT {quote(k)} AS s, {quote(v)} AS id" for k, v in sorted(known().items()))
    rules = " UNION ALL ".join(f"SELECT {quote(k)} AS seq, {quote(v)} AS licence" for k, v in _sequences().items())
    steps = [
        ("\\r\\n", "\\n"), ("(?m)^[ \\t]*[;!]+[ \\t]+", ""), ("([.!?;])[ \\t\\r\\n]+", "\\1\x01"), ("[\\r\\n][^A-Za-z0-9]*[\\r\\n]", "\x01"), None,
        ("[^a-z0-9.\\r\\n]+", " "), ("[. ]+([ \\r\\n]|$)", "\\1"), ("(^|[\\r\\n]) +", "\\1"), ("\\r*\\n[\\r\\n]*", "\\n"), ("\\n", "\\n\\n"), ("\\r", "\\r\\r"),
    ]
    raw = lambda s: " || ".join("chr(1)" if p == "\x01" else "chr(10)" if p == "\\n" else quote(p) for p in re.split("(\x01)", s) if p) or "''"
    s = "coalesce(text, '')"
    for step in steps:
        if step is None:
            s = f"translate({s}, '{UPPER}' || chr(13) || chr(10) || chr(1), '{LOWERED}' || chr(13) || chr(13) || chr(10))"
        elif step[1] == "\\n\\n" or step[1] == "\\r\\r":
            c = "chr(10)" if step[0] == "\\n" else "chr(13)"
            s = f"replace({s}, {c}, {c} || {c})"
        else:
            s = f"regexp_replace({s}, {quote(step[0])}, {raw(step[1])}, 'g')"
        if step and step[0].startswith("[. ]"):
            s = f"chr(10) || {s} || chr(10)"
    either = "[\\r\\n](" + _either("\\r\\r") + ")[\\r\\n]"
    return f"""
WITH known AS ({table}), rules AS ({rules}),
cut AS (SELECT doc_id, row_number() OVER () AS r, {s} AS pieces FROM documents),
parts AS (SELECT r, regexp_extract_all(pieces, {quote(either)}, 1) AS parts FROM cut),
each AS (SELECT r, replace(unnest(parts), chr(13) || chr(13), ' ') AS s, generate_subscripts(parts, 1) AS k FROM parts),
ids AS (SELECT r, list(id ORDER BY k) AS ids FROM each JOIN known USING (s) GROUP BY r),
hits AS (SELECT r, unnest(regexp_extract_all(' ' || array_to_string(ids, '  ') || ' ', {quote("(" + "|".join(x.replace(".", "[.]") for x in _sequences()) + ")")}, 1)) AS seq FROM ids),
found AS (SELECT r, list(DISTINCT licence ORDER BY licence) AS licences FROM hits JOIN rules USING (seq) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(array_to_string(licences, ' '), '') AS licences
FROM cut LEFT JOIN ids USING (r) LEFT JOIN found USING (r)"""
