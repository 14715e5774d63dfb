"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Templates are short notices and full licence texts. The units of a text are its lines and, where blank
lines part it, its paragraphs of several lines, which are held against notices, and the text as a whole,
which is held against full licence texts. A unit is lower-cased, everything but letters and digits becomes a space, and its distinct word bigrams are held
against each template's: 2 |A and B| / (|A| + |B|). As the coefficient cannot reach the threshold unless
the sizes are near, a template is tried only on units of a size within its bounds.

Besides, the words of the whole text, across lines and paragraphs, are searched for notices that stand
inside longer units or run over several lines: windows from one bigram of a template to another, of a size
within its bounds, by the same coefficient. Of windows that overlap the one that shares most bigrams
counts. A unit that matches holds a window of its own licence, so of each licence only the windows beyond
its matching units are added. Only texts that hold words that no match can do without are searched at all.
All of it is array functions within a row: no shuffle, no Python.

Defined cases: a null text is the empty text; units of fewer than two words match nothing; equal best
coefficients go to the template named first; repeated rows are each scanned; null ids are kept; an empty
table gives an empty result; whole texts are read, however long; other columns are not read, so their
names do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Names and wording of common licence notices.
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
#: Names and wording of short licences in full.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
FULL_TEXTS = [
    (
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause-full", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause-full", "".join(_BSD)),
    (
        "ISC-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib-full",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]


@dataclass(frozen=True)
class Template:
    """A notice's or, if ``full``, a licence's name and its distinct bigrams, in order."""

    name: str
    bigrams: tuple[str, ...]
    full: bool = False

    def needed(self, threshold: float) -> list[list[str]]:
        """Sets of words; any window that reaches the threshold holds one of each: too few bigrams do without."""
        spare = len(self.bigrams) - self.bounds(threshold)[0]
        out, now = [], []
        for w in sorted({w for g in self.bigrams for w in g.split()}, key=lambda w: (-len(w), w)):
            now.append(w)
            if sum(not set(now).isdisjoint(g.split()) for g in self.bigrams) > spare:
                out.append(now)
                now = []
        return out

    def bounds(self, threshold: float) -> tuple[int, int]:
        """Least and most bigrams of a unit that can reach the threshold: |A and B| is at most the smaller."""
        n = len(self.bigrams)
        return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def compiled(templates: list[tuple[str, str]] | None = None, full: list[tuple[str, str]] | None = None) -> list[Template]:
    """Notices, then full texts; the library's own where neither is given."""
    if templates is None and full is None:
        templates, full = TEMPLATES, FULL_TEXTS
    out = []
    for whole, known in ((False, templates or []), (True, full or [])):
        for name, text in known:
            words = re.sub(r"[\W_]+", " ", text.lower()).split()
            out.append(Template(name, tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))), whole))
    return out


def listed(words) -> Column:
    """An array of words or bigrams, which hold letters, digits and spaces only."""
    return F.expr("cast(array(" + ", ".join(f"'{w}'" for w in words) + ") AS array<string>)")


def units(text: Column) -> Column:
    """Lines, then the paragraphs that span several lines."""
    lines = F.split(text, "\n", -1)
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.concat(lines, F.when(F.rlike(text, F.lit(r"\n[ \t\r]*\n")), blocks).otherwise(F.array().cast("array<string>")))


def bigrams(unit: Column) -> Column:
    return F.array_distinct(all_bigrams(unit))


def words_of(unit: Column) -> Column:
    """The words in order; there may be an empty one at either end."""
    return F.split(F.lower(unit), r"[^\p{L}\p{N}]+", -1)


def pairs_of(words: Column) -> Column:
    """The bigrams of an array of words in order, with repeats."""
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.element_at(w, i + 2)))
    # a transform over one element names the words once
    return F.flatten(F.transform(F.array(F.filter(words, lambda w: w != "")), pairs))


def all_bigrams(unit: Column) -> Column:
    """The bigrams in order, with repeats."""
    return pairs_of(words_of(unit))


def known_as(templates: list[Template], threshold: float) -> Column:
    """The templates as an array of (name, rank, full, least, most, grams); earlier ones have higher ranks."""
    rows = []
    for k, t in enumerate(templates):
        lo, hi = t.bounds(threshold)
        grams = ", ".join(f"'{g}'" for g in t.bigrams)
        name = t.name.replace("\\", "\\\\").replace("'", "\\'")
        rows.append(f"named_struct('name', '{name}', 'rank', {-k}, 'full', {str(t.full).lower()}, 'least', {lo}, 'most', {hi}, 'grams', cast(array({grams}) AS array<string>))")
    return F.expr(f"cast(array({', '.join(rows)}) AS array<struct<name:string,rank:int,full:boolean,least:int,most:int,grams:array<string>>>)")


def matches(units: Column, templates: Column, threshold: float) -> Column:
    """Array of (license, dice): for each unit that reaches the threshold, its best template."""

    def score(grams: Column) -> Column:
        fitting = F.filter(templates, lambda t: F.size(grams).between(t["least"], t["most"]))
        dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))
        return F.array_max(F.transform(fitting, lambda t: F.struct(dice(t).alias("dice"), t["rank"].alias("rank"), t["name"].alias("license"))))

    # a bigram takes three characters, and each further one two
    least = F.array_min(F.transform(templates, lambda t: t["least"]))
    near = F.filter(units, lambda u: F.char_length(u) >= 2 * least + 1)
    best = F.transform(near, lambda u: score(bigrams(u)))
    return F.transform(F.filter(best, lambda m: m["dice"] >= threshold), lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice")))


def may_hold(held: Column, templates: list[Template], threshold: float) -> Column:
    """Whether a text of these words may hold a match: for some template, a word of each set that its matches need."""
    some = lambda words: F.arrays_overlap(held, listed(words))
    return reduce(or_, [reduce(and_, map(some, t.needed(threshold)), F.lit(True)) for t in templates], F.lit(False))


#: Type of the windows found in a text.
WINDOWS = "array<struct<shared:int,dice:double,rank:int,start:int,end:int,license:string>>"


def windows(grams: Column, hits: Column, t: Column, threshold: float) -> Column:
    """Array of (shared, dice, rank, start, end, license): the best window from each bigram of the template on."""
    lo, hi = t["least"], t["most"]

    def best(near: Column) -> Column:
        """``near``: the template's bigrams from a first one on."""
        start = F.element_at(near, 1)["at"]

        def held(last: Column, k: Column) -> Column:
            shared = F.size(F.array_distinct(F.transform(F.slice(near, 1, k + 1), lambda h: h["gram"])))
            size = F.size(F.array_distinct(F.slice(grams, start + 1, last["at"] - start + 1)))
            dice = F.lit(2.0) * shared / (size + F.size(t["grams"]))
            return F.when(k + 1 >= lo, F.struct(dice.alias("dice"), shared.alias("shared"), last["at"].alias("end")))

        b = F.array_max(F.transform(near, held))
        return F.transform(F.array(b), lambda b: F.struct(b["shared"].alias("shared"), b["dice"].alias("dice"), t["rank"].alias("rank"), (-start).alias("start"), b["end"].alias("end"), t["name"].alias("license")))

    def search(own: Column) -> Column:
        reach = F.transform(own, lambda h, i: F.filter(F.slice(own, i + 1, hi), lambda o: o["at"] < h["at"] + hi))
        full = F.filter(reach, lambda near: F.size(F.array_distinct(F.transform(near, lambda h: h["gram"]))) >= lo)
        return F.filter(F.flatten(F.transform(full, best)), lambda w: w["dice"] >= threshold)

    own = F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"]))
    return F.flatten(F.transform(F.array(own), search))


def apart(found: Column) -> Column:
    """Windows that do not overlap, those that share most bigrams first."""

    def take(kept: Column, w: Column) -> Column:
        # two windows may share a word: the last of one bigram and the first of the next
        clash = F.exists(kept, lambda k: (-k["start"] <= w["end"]) & (-w["start"] <= k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(w)))

    return F.aggregate(F.sort_array(found, asc=False), F.array().cast(WINDOWS), lambda kept, w: take(kept, w).cast(WINDOWS))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", full: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_matches, licenses, best_dice): the licences whose notices or full texts make up or stand in each text."""
    known = compiled(templates, full)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = "array<struct<license:string,dice:double>>"
    none, no_grams = F.array().cast(kind), F.array().cast("array<string>")
    # words that a match needs, then its bigrams anywhere in the text: what is left is searched
    left = texts.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    left = left.withColumn("told", F.array_intersect("words", listed(sorted({w for t in known for g in t.bigrams for w in g.split()}))))
    left = left.select("doc_id", "text", F.when(may_hold(F.col("told"), known, threshold), pairs_of(F.col("words"))).otherwise(no_grams).alias("grams"))
    left = left.withColumn("held", F.when(F.size("grams") > 0, F.array_intersect("grams", listed(sorted({g for t in known for g in t.bigrams})))).otherwise(no_grams))
    near = F.filter(known_as(known, threshold), lambda t: F.size(F.array_intersect("held", t["grams"])) >= t["least"])
    left = left.withColumn("near", F.when(F.size("held") > 0, near))
    left = left.withColumn("notices", F.filter("near", lambda t: ~t["full"])).withColumn("whole", F.filter("near", lambda t: t["full"]))
    numbered = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: F.array_contains("held", h["gram"]))
    searched = F.size("near") > 0  # null where no template comes near
    left = left.select(
        "doc_id",
        "notices",
        "grams",
        F.when(searched, numbered).alias("hits"),
        F.when(searched, matches(units(F.col("text")), F.col("notices"), threshold).cast(kind)).otherwise(none).alias("units"),
        F.when(searched, matches(F.array("text"), F.col("whole"), threshold).cast(kind)).otherwise(none).alias("whole"),
    )
    found = F.flatten(F.transform("notices", lambda t: windows(F.col("grams"), F.col("hits"), t, threshold)))
    left = left.select("doc_id", "units", "whole", F.when(F.size("notices") > 0, found.cast(WINDOWS)).alias("found"))
    inside = F.transform(apart(F.col("found")), lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice"))).cast(kind)
    left = left.select("doc_id", "units", "whole", F.when(F.size("found") > 0, inside).otherwise(none).alias("inside"))
    of = lambda c, name: F.size(F.filter(c, lambda m: m["license"] == name))
    added = F.filter("inside", lambda w, i: of(F.slice("inside", 1, i + 1), w["license"]) > of("units", w["license"]))
    both = left.select("doc_id", F.concat("units", "whole", added).alias("m"))
    return both.select(
        "doc_id",
        F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("m", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def duckdb_sql() -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(t.name)}, {t.full}, [{', '.join(map(quote, t.bigrams))}])" for k, t in enumerate(compiled()))
    return f"""
WITH templates(rank, license, whole, grams) AS (VALUES {rows}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, false AS whole, unnest(string_split(text, chr(10))) AS unit FROM texts
  UNION ALL
  SELECT r, true, text FROM texts
  UNION ALL
  SELECT r, false, unit FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS unit FROM texts WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')) WHERE contains(trim(unit), chr(10))
), numbered AS (SELECT row_number() OVER () AS u, r, whole, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT u, r, whole, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM numbered WHERE len(w) >= 2),
scored AS (
  SELECT u, any_value(r) AS r, max(d) AS dice, arg_max(license, (d, -rank)) AS license
  FROM (SELECT u, r, rank, license, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS d FROM grams JOIN templates t USING (whole))
  WHERE d >= {THRESHOLD} GROUP BY u
)
SELECT t.doc_id, count(s.r) AS n_matches, coalesce(string_agg(DISTINCT s.license, ',' ORDER BY s.license), '') AS licenses, coalesce(max(s.dice), 0.0)::DOUBLE AS best_dice
FROM texts t LEFT JOIN scored s ON t.r = s.r GROUP BY t.r, t.doc_id
"""
