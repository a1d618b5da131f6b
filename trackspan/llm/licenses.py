"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Built-in expressions only. A text is looked at as a whole, by paragraphs, by lines and by runs of adjacent paragraphs, so a
notice or a licence of several paragraphs is found between prose or code as well as in a file of its own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

THRESHOLD = 0.8

# Texts and usual notices of public licences.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

# Texts the SQL does not know.
MORE_TEMPLATES = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
ALL_TEMPLATES = TEMPLATES | MORE_TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OWNER_LINE = r"(^|\n)[ \t]*(?:[Cc]opyright|COPYRIGHT|©)[^\n]*"
BLANK_LINES = r"\n[ \t\r\n]*\n"
WORDLESS_LINES = r"\n[^A-Za-z0-9]*\n"


def template_grams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", re.sub(OWNER_LINE, "\n", text).translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams of a text that can reach the threshold with a template of ``size`` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.array_compact(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _runs(paragraphs: Column, start: Column, every: list[str], most: Column) -> Column:
    """``known, n`` of the runs of paragraphs from ``start`` on: their bigrams of any template, and the number of all.

    A run ends before it has more than ``most`` bigrams. One whose last paragraph adds no known bigram scores no better
    than the run without it and is not listed, so a run is listed for each known bigram at most.
    """
    texts = lambda: F.array().cast("array<string>")
    runs = F.array().cast("array<struct<known:array<string>,n:int>>")
    begin = F.struct(texts().alias("last"), texts().alias("grams"), texts().alias("known"), runs.alias("runs"), F.lit(True).alias("open"))

    def put(acc: Column, words: Column) -> Column:
        own = _bigrams(F.concat(acc["last"], words))
        grams = F.array_union(acc["grams"], own)
        known = F.array_union(acc["known"], F.filter(own, lambda p: p.isin(every)))
        is_open = F.size(grams) <= most
        adds = is_open & (F.size(known) > F.size(acc["known"]))
        listed = F.when(adds, F.concat(acc["runs"], F.array(F.struct(known.alias("known"), F.size(grams).alias("n"))))).otherwise(acc["runs"])
        return F.when(acc["open"], F.struct(F.slice(words, -1, 1).alias("last"), grams.alias("grams"), known.alias("known"),
                                            listed.alias("runs"), is_open.alias("open"))).otherwise(acc)

    return F.aggregate(F.slice(paragraphs, start, F.size(paragraphs)), begin, put, lambda acc: acc["runs"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, n_units`` per document and template it matches: the best coefficient among its whole text,
    paragraphs, lines and runs of adjacent paragraphs, and how many different ones of the first three match; 1 where only
    runs do. Paragraphs of a run are parted by lines without letters a-z and digits, such as empty lines of a comment.

    Letters other than ASCII a-z and digits part words, lines that name a copyright owner are left out, and bigrams count
    once. Null and empty texts, and those of one word, match nothing; rows of one id (null included) count together; an
    empty table gives an empty result; other columns are not read. A template without bigrams is refused.

    A unit is first cut to the bigrams that any template has (one hash lookup each). Fewer than the smallest template
    asks for end it there, which is nearly always; then its number of bigrams picks the templates of fitting size. Runs are made only of texts that
    hold enough bigrams of one template as a whole, up to the largest size that any such template allows.
    """
    grams = {name: template_grams(text) for name, text in templates.items()}
    if not all(grams.values()):
        raise ValueError("a template needs two words at least: " + ", ".join(n for n, g in grams.items() if not g))
    if not grams:
        raise ValueError("no templates")
    bounds = {name: size_bounds(len(g), threshold) for name, g in grams.items()}
    fewest = min(low for low, _ in bounds.values())
    every = sorted({g for own in grams.values() for g in own})

    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), OWNER_LINE, "\n")
    units = F.array_distinct(F.concat(F.split(body, "\n"), F.split(body, BLANK_LINES), F.array(body)))
    # Every explode() also keeps what it makes from being computed again for each use.
    rows = docs.select("doc_id", F.explode(F.transform(units, _words)).alias("words")).where(F.size("words") > fewest)
    pairs = _bigrams(F.col("words"))
    rows = rows.select("doc_id", F.explode(F.array(pairs)).alias("pairs"))
    rows = rows.select("doc_id", "pairs", F.explode(F.array(F.array_distinct(F.filter("pairs", lambda p: p.isin(every))))).alias("known"))
    rows = rows.where(F.size("known") >= fewest)
    rows = rows.select("doc_id", "known", F.explode(F.array(F.size(F.array_distinct("pairs")))).alias("n"))
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("grams"), F.lit(len(own)).alias("size"),
                                F.lit(bounds[name][0]).alias("low"), F.lit(bounds[name][1]).alias("high")) for name, own in grams.items()])
    fitting = F.filter(listed, lambda t: (F.col("n") >= t["low"]) & (F.col("n") <= t["high"]) & (F.size("known") >= t["low"]))
    rows = rows.select("doc_id", "known", "n", F.lit(1).alias("unit"))

    # Runs: of texts of several paragraphs only, from the paragraphs that hold or begin a known bigram.
    parted = docs.select("doc_id", F.explode(F.array(body)).alias("body")).where(F.col("body").rlike(WORDLESS_LINES))
    parted = parted.select("doc_id", F.explode(F.array(F.filter(F.transform(F.split("body", WORDLESS_LINES), _words), lambda w: F.size(w) > 0))).alias("paragraphs"))
    parted = parted.where(F.size("paragraphs") > 1)
    whole = F.array_distinct(F.filter(_bigrams(F.flatten("paragraphs")), lambda p: p.isin(every)))
    parted = parted.select("doc_id", "paragraphs", F.explode(F.array(whole)).alias("known")).where(F.size("known") >= fewest)
    reached = F.filter(listed, lambda t: F.size(F.array_intersect("known", t["grams"])) >= t["low"])
    most = F.array_max(F.transform(reached, lambda t: t["high"]))
    parted = parted.select("doc_id", "paragraphs", F.explode(F.array(most)).alias("most")).where(F.col("most").isNotNull())
    parted = parted.select("doc_id", "paragraphs", "most", F.explode(F.sequence(F.lit(1), F.size("paragraphs"))).alias("start"))
    first = F.flatten(F.slice("paragraphs", F.col("start"), 2))
    first = F.slice(first, 1, F.size(F.element_at("paragraphs", F.col("start"))) + 1)
    parted = parted.where(F.exists(_bigrams(first), lambda p: p.isin(every)))
    runs = parted.select("doc_id", F.explode(_runs(F.col("paragraphs"), F.col("start"), every, F.col("most"))).alias("run"))
    runs = runs.select("doc_id", "run.known", "run.n", F.lit(0).alias("unit")).where(F.size("known") >= fewest)

    rows = rows.union(runs).select("doc_id", "known", "n", "unit", F.explode(fitting).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("known", "t.grams")) / (F.col("n") + F.col("t.size"))
    rows = rows.select("doc_id", F.col("t.license").alias("license"), dice.alias("dice"), "unit").where(F.col("dice") >= threshold)
    units = F.greatest(F.sum("unit"), F.lit(1)).cast("long")
    return rows.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), units.alias("n_units"))


def best_licenses(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice``: per document the licence of the best coefficient, of equal ones the first by name."""
    found = scan_licenses(docs, templates, threshold).groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("low"), "license")).alias("x"))
    return found.select("doc_id", "x.license", (-F.col("x.low")).alias("dice"))


def without_licenses(docs: DataFrame, licenses: list[str], templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id matches none of the named templates; null ids stay."""
    key = fresh("licensed_id", docs)
    found = scan_licenses(docs, {n: templates[n] for n in licenses}, threshold).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, docs["doc_id"] == found[key], "left_anti")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, without pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, template_grams(t)))}])" for n, t in templates.items())
    return f"""
WITH templates(license, grams) AS (VALUES {values}),
bodies AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{OWNER_LINE}', E'\\n', 'g') AS body FROM documents),
units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(body, E'\\n'), regexp_split_to_array(body, '{BLANK_LINES}'), [body]))) AS unit FROM bodies),
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM units),
paired AS (SELECT doc_id, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams FROM cut WHERE len(words) > 1),
scored AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(paired.grams, templates.grams)) / (len(paired.grams) + len(templates.grams)) AS dice
           FROM paired JOIN templates ON list_has_any(paired.grams, templates.grams))
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM scored WHERE dice >= {threshold!r} GROUP BY doc_id, license"""
