"""Licence scans by canonical digest: normalise a text, hash it whole, and join the digest to those of known licences.

Normalising follows the matching guidelines for licence lists: case, punctuation and white space do not count, copyright lines
are left out, and equivalent spellings become one. What is hashed is a whole unit: the entire document, each block of it
between blank lines, and each line. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import private_names

# Equivalent spellings, as whole words of a line in lower case without punctuation; applied in this order.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "non commercial": "noncommercial",
    "share alike": "sharealike", "copyright holder": "copyright owner", "copyright holders": "copyright owners",
    "organisation": "organization", "favour": "favor", "whilst": "while", "acknowledgement": "acknowledgment",
    "by nc": "by noncommercial", "by sa": "by sharealike", "cc by": "creative commons attribution", "gnu gpl": "gnu general public license",
    "v2": "version 2", "v3": "version 3", "v 2": "version 2",
}
BLANK_LINES = r"\n[ \t\r]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©(]*(copyright *(\(c\)|©|[0-9])|\(c\) *[0-9]|©)"

# Licence texts and the notices by which documents name them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
# The names of each licence in notices, and the verb forms that stand before them; every pair is a notice.
NAMES: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3", "the GNU AGPL, version 3", "the AGPL v3", "AGPL-3.0"),
    "AGPL-3.0-or-later": ("the GNU Affero General Public License, version 3 or later", "the AGPL v3 or later", "AGPL-3.0-or-later"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License",
                     "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License",
                     "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 License", "the CC0 1.0 Universal License", "the Creative Commons Zero v1.0 Universal License"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License version 2.0", "the GNU GPL, version 2", "the GPL v2", "GPL-2.0"),
    "GPL-2.0-or-later": ("the GNU General Public License, version 2 or later", "the GNU GPL, version 2 or later", "the GPL v2 or later", "GPL-2.0-or-later"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License version 3.0", "the GNU GPL, version 3", "the GPL v3", "GPL-3.0"),
    "GPL-3.0-or-later": ("the GNU General Public License, version 3 or later", "the GNU GPL, version 3 or later", "the GPL v3 or later", "GPL-3.0-or-later"),
    "ISC": ("the ISC License", "ISC"),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL, version 2.1", "the LGPL v2.1", "LGPL-2.1"),
    "LGPL-2.1-or-later": ("the GNU Lesser General Public License, version 2.1 or later", "the LGPL v2.1 or later", "LGPL-2.1-or-later"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "the GNU LGPL, version 3", "the LGPL v3", "LGPL-3.0"),
    "LGPL-3.0-or-later": ("the GNU Lesser General Public License, version 3 or later", "the LGPL v3 or later", "LGPL-3.0-or-later"),
    "MIT": ("the MIT License", "MIT"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"),
}
VERBS = tuple(f"{who}{verb} under" for verb in ("licensed", "released", "distributed", "available", "made available") for who in (
    "", "This work is ", "This project is ", "This software is ", "This program is ", "This code is ", "This document is "))


def _editions(name: str) -> list[str]:
    """The whole text of a file of ``license_texts``, its addresses in both schemes, with and without what follows its terms."""
    text = resources.files("tablewright.llm").joinpath(f"license_texts/{name}.txt").read_text(encoding="utf-8")
    terms, mark, rest = text.partition("END OF TERMS AND CONDITIONS")
    texts = [text, terms, terms + mark] if mark else [text]
    texts += [text.replace("Copyright [yyyy] [name of copyright owner]", "")] if "[yyyy]" in text else []  # filled in, that is a copyright line
    return [t.replace("http://", "https://").replace("https://", scheme) for t in texts for scheme in ("http://", "https://")]


def _titled(text: str, *titles: str) -> list[str]:
    """A text with and without its title, and with or without the reservation of rights that may stand in a line of its own."""
    return [title + rights + text for title in ("", *(f"{t}\n\n" for t in titles)) for rights in ("", "All rights reserved.\n\n")]


def _bsd(text: str, *titles: str) -> list[str]:
    """The clauses may be numbered or not, and the disclaimer may say owner for holder, which is one spelling here."""
    bullets = text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    return [t for each in (text, bullets) for t in _titled(each, *titles)]


_TEXTS: Mapping[str, list[str]] = {
    "Apache-2.0": [_APACHE, *_editions("Apache-2.0")],
    "BSD-2-Clause": _bsd(_BSD_TERMS + _BSD_DISCLAIMER, "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": _bsd(_BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER, "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "CC-BY-SA-4.0": _editions("CC-BY-SA-4.0"),
    "CC0-1.0": _editions("CC0-1.0"),
    "GPL-2.0-only": _editions("GPL-2.0"),
    "GPL-3.0-only": _editions("GPL-3.0"),
    "ISC": _titled(_ISC, "ISC License", "The ISC License", "ISC License (ISC)"),
    "LGPL-2.1-only": _editions("LGPL-2.1"),
    "LGPL-3.0-only": _editions("LGPL-3.0"),
    "MIT": _titled(_MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", *_editions("MPL-2.0")],
}
LICENSES: Mapping[str, tuple[str, ...]] = {
    name: (*[f"{verb} {each}." for verb in VERBS for each in names], f"SPDX-License-Identifier: {name}", *_TEXTS.get(name, ())) for name, names in NAMES.items()}


def canonical_line(line: Column) -> Column:
    """The canonical form of one line: words in one spelling, a space between them; nothing of a copyright line."""
    low = F.lower(line)
    words = F.concat(F.lit("  "), F.regexp_replace(low, NOT_WORD, "  "), F.lit("  "))  # each word has a space of its own on both sides
    for old, new in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.when(F.rlike(low, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(F.trim(F.regexp_replace(words, " +", " ")))


def canonical_blocks(text: Column) -> Column:
    """The canonical lines of each block of a text; blocks are parted by blank lines."""
    return F.transform(F.split(text, BLANK_LINES, -1), lambda block: F.transform(F.split(block, "\n", -1), canonical_line))


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one text."""
    return F.concat_ws(" ", F.filter(lines, lambda line: line != ""))


def known_digests(spark: SparkSession, licenses: Mapping[str, tuple[str, ...]] = LICENSES) -> DataFrame:
    """``(digest, license)``: one row for each distinct canonical text of the list, whatever the documents."""
    rows = spark.createDataFrame([(name, text) for name, texts in licenses.items() for text in texts], "license string, text string")
    return rows.select(F.sha2(canonical_text(F.flatten(canonical_blocks(F.col("text")))), 256).alias("digest"), "license").groupBy(
        "digest").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, text: str = "text", licenses: Mapping[str, tuple[str, ...]] = LICENSES) -> DataFrame:
    """``df`` with ``license`` (of the entire text, else NULL), ``licenses`` (of any unit, distinct, sorted) and ``license_units`` (units that match).

    Units are the entire text, each block between blank lines, and each line; where two of them have the same canonical text,
    as in a document of one line, it counts as one unit. A unit without a word matches nothing, nor do NULL and empty
    texts. Every row is scanned whole and by itself, so repeated rows give repeated results; columns of the three names are
    replaced. The known digests are as few as the given list, so they are broadcast and the documents are not shuffled.
    """
    kept = [c for c in df.columns if c not in ("license", "licenses", "license_units")]
    known = known_digests(df.sparkSession, licenses)
    blocks, whole, found = private_names(df.columns, "_blocks", "_whole", "_found")
    rows = df.select(*kept, canonical_blocks(F.coalesce(text, F.lit(""))).alias(blocks))
    rows = rows.withColumn(whole, F.sha2(canonical_text(F.flatten(blocks)), 256))
    rows = rows.join(F.broadcast(known.withColumnRenamed("digest", whole)), whole, "left")
    # the digests of all units, distinct; the known ones are looked up in constant maps, one for each first byte as a map is searched in turn
    parts = F.concat(F.array(canonical_text(F.flatten(blocks))), F.transform(blocks, canonical_text), F.flatten(blocks))
    digests = F.transform(F.array_distinct(F.filter(parts, lambda u: u != "")), lambda u: F.sha2(u, 256))
    maps: list[dict[str, str]] = [{} for _ in range(256)]
    for r in known.collect():  # as many as the list
        maps[int(r["digest"][:2], 16)][r["digest"]] = r["license"]
    names = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")  # one literal, folded once, in place of one for each digest
    rows = rows.withColumn(found, F.filter(F.transform(digests, lambda d: F.element_at(
        F.element_at(names, F.conv(F.substring(d, 1, 2), 16, 10).cast("int") + 1), d)), lambda n: n.isNotNull()))
    return rows.select(*kept, "license", F.array_sort(F.array_distinct(found)).alias("licenses"), F.size(found).cast("bigint").alias("license_units"))


def license_sql(licenses: Mapping[str, tuple[str, ...]] = LICENSES) -> str:
    """The scan of ``documents`` as SQL: ``(doc_id, license, licenses, license_units)``, the list joined by commas."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    line = f"('  ' || regexp_replace(lower(l), {quoted(NOT_WORD)}, '  ', 'g') || '  ')"
    for old, new in SPELLINGS.items():
        line = f"replace({line}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    line = f"CASE WHEN regexp_matches(lower(l), {quoted(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace({line}, ' +', ' ', 'g')) END"
    blocks = f"list_transform(string_split_regex(coalesce(text, ''), {quoted(BLANK_LINES)}), lambda b: list_transform(string_split(b, chr(10)), lambda l: {line}))"

    def joined(lines: str) -> str:
        return f"array_to_string(list_filter({lines}, lambda x: x <> ''), ' ')"

    texts = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, each in licenses.items() for text in each)
    return f"""WITH listed AS (SELECT name, {blocks} AS blocks FROM (VALUES {texts}) t(name, text)),
known AS (SELECT sha256({joined('flatten(blocks)')}) AS digest, min(name) AS name FROM listed GROUP BY 1),
canon AS (SELECT doc_id, row_number() OVER () AS r, {blocks} AS blocks FROM documents),
units AS (SELECT DISTINCT r, unnest(list_concat([{joined('flatten(blocks)')}], list_transform(blocks, lambda k: {joined('k')}), flatten(blocks))) AS u FROM canon),
hits AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS license_units
  FROM units JOIN known ON sha256(u) = digest WHERE u <> '' GROUP BY r)
SELECT doc_id, k.name AS license, coalesce(licenses, '') AS licenses, coalesce(license_units, 0)::BIGINT AS license_units
FROM canon c LEFT JOIN known k ON sha256({joined('flatten(blocks)')}) = k.digest LEFT JOIN hits h USING (r)"""
