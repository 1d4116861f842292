"""Licence scan: lines and passages of documents against licence templates by the Dice coefficient over word bigrams.

Text is normalised (lower case, everything but letters and digits of ASCII to spaces). A line of p distinct bigrams can
reach a coefficient t with a template of q only if ``q * t / (2 - t) <= p <= q * (2 - t) / t``; lines outside all such
bounds are dropped before their bigrams are made, and pairs outside are dropped in the join. The templates' bigrams (a
fixed list) are broadcast after a check of their number; what is shuffled are the bigrams that some template has.

Notices that are wrapped, or that stand inside a line, are found as passages: paragraphs of several lines, and word
windows of each template's own size, against notices and against texts of several sentences. With q bigrams, a template
needs ``q * t / (2 - t)`` of them in a passage, so one of its rarest must be there; only what surrounds those is compared,
and no passage is lost. Passages of a text that overlap are one notice, judged by the one with most shared bigrams. A
passage inside a line that matches as a whole is that line; one over several lines takes the place of their matches.

Defined results: null or empty text has no licence; equal lines count each; ties between templates go to the name that
sorts first; rows that repeat a ``doc_id`` are judged each by its own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, row_key

LEAST = 0.8

# Notices by which texts state a licence, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software").'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
MOST_BIGRAMS = 100_000

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program{2}"
_V3, _SITE = "either version 3 of the License, or (at your option) any later version", ". If not, see <https://www.gnu.org/licenses/>."
_GNU_TEXT = "Copyright (C) {0} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
# Texts of several sentences, matched as passages only. Long licences are known by their headers and by how their full texts begin.
PASSAGES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", _GNU.format("", "either version 2 of the License, or (at your option) any later version", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", _GNU.format("", _V3, _SITE)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU_TEXT.format("2007")),
    ("LGPL-3.0", _GNU.format("Lesser ", _V3, _SITE)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU_TEXT.format("2007")),
    ("AGPL-3.0", _GNU.format("Affero ", _V3, _SITE)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _GNU_TEXT.format("2007")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
WORD = re.compile("[a-z0-9]+")


def normalised(text: Column) -> Column:
    """Lower-case ASCII words joined by single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words; a single word is its own bigram."""
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) <= 1, F.filter(w, lambda x: x != "")).otherwise(F.array_distinct(pairs))


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license, q, gram``: one row for each distinct bigram of each template."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    words = rows.select("template", "license", F.split(normalised(F.col("text")), " ", -1).alias("w"))
    g = words.select("template", "license", bigrams(F.col("w")).alias("g"))
    return g.select("template", "license", F.size("g").alias("q"), F.explode("g").alias("gram"))


def matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, line, license, dice``: every line with its best template of at least ``least``."""
    grams = template_bigrams(docs.sparkSession, templates)
    bounds = grams.agg(F.min("q"), F.max("q")).first()
    low, high = (bounds[0] or 1) * least / (2 - least), (bounds[1] or 0) * (2 - least) / least
    lines = docs.select(F.col(key), row_key(F.col(text)).alias("row"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line", "s"))
    # generators of one row keep the filters above them: pushed below, they would make each array once more
    one = lambda **c: F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()])))
    norm = F.split(normalised(F.col("s")), " ", -1)
    words = lines.filter(F.length("s") >= low).select(key, "row", "line", one(w=norm)).filter(F.size("w") >= low)  # there are no more bigrams than words
    sized = words.select(key, "row", "line", bigrams(F.col("w")).alias("g")).select(key, "row", "line", one(g=F.col("g"), p=F.size("g"))).filter((F.col("p") >= low) & (F.col("p") <= high))
    pairs = sized.select(key, "row", "line", "p", F.explode("g").alias("gram")).join(broadcast_if(grams, MOST_BIGRAMS), "gram")
    pairs = pairs.filter((F.col("p") * (2 - least) >= F.col("q") * least) & (F.col("p") * least <= F.col("q") * (2 - least)))
    scored = pairs.groupBy(key, "row", "line", "template", "license", "p", "q").agg(F.count("*").alias("both"))
    scored = scored.withColumn("dice", 2 * F.col("both") / (F.col("p") + F.col("q"))).filter(F.col("dice") >= least)
    best = scored.groupBy(key, "row", "line").agg(F.min_by(F.struct("license", "dice"), F.struct(-F.col("dice"), F.col("license"))).alias("b"))
    return best.select(key, "row", "line", "b.license", "b.dice")


class Passages:
    """Finds the templates' passages in a text."""

    def __init__(self, templates=TEMPLATES + PASSAGES, least: float = LEAST):
        self.least, self.templates, self.rare = least, [], {}
        texts = [(name, WORD.findall(text.lower())) for name, text in templates]
        shared = Counter(g for _, w in texts for g in set(pairwise(w)))
        for name, w in texts:
            grams = set(pairwise(w))
            if not grams:
                continue
            need = max(math.ceil(len(grams) * least / (2 - least) - 1e-9), 1)
            # any passage with enough bigrams has one beyond the need - 1 most common; long ones that few templates have are taken for rare
            for g in sorted(grams, key=lambda g: (shared[g], -len(g[0]) - len(g[1]), g))[: len(grams) - need + 1]:
                self.rare.setdefault(g, []).append(len(self.templates))
            self.templates.append((name, grams, len(w), need))

    def windows(self, grams: list, t: int, anchors: list[int]) -> Iterator[tuple[int, float, int, int]]:
        """``both, dice, first, end`` (words) of the windows around ``anchors`` that reach the coefficient."""
        _, own, n, need = self.templates[t]
        size = min(n - 1, len(grams))
        runs: list[list[int]] = []
        for a in anchors:
            lo, hi = max(a - size + 1, 0), min(a, len(grams) - size)
            if runs and lo <= runs[-1][1] + 1:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        for lo, hi in runs:
            held = list(accumulate((g in own for g in grams[lo : hi + size]), initial=0))
            seen: Counter = Counter()
            both, at = 0, None  # ``seen`` is of the window that begins at ``at``
            for k in range(lo, hi + 1):
                if held[k - lo + size] - held[k - lo] < need:
                    continue
                if at is None or k - at >= size:
                    seen, at = Counter(grams[k : k + size]), k
                    both = sum(g in own for g in seen)
                while at < k:
                    old, new = grams[at], grams[at + size]
                    at += 1
                    seen[new] += 1
                    both += seen[new] == 1 and new in own
                    seen[old] -= 1
                    if not seen[old]:
                        del seen[old]
                        both -= old in own
                if (dice := 2 * both / (len(seen) + len(own))) >= self.least:
                    yield both, dice, k, k + size + 1

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """First and last line (0-based), licence and coefficient of every passage; none overlap."""
        words: list[str] = []
        line_of: list[int] = []
        starts = [0]  # of paragraphs
        for k, line in enumerate((text or "").lower().split("\n")):
            w = WORD.findall(line)
            if not w and starts[-1] < len(words):
                starts.append(len(words))
            words += w
            line_of += [k] * len(w)
        grams = list(pairwise(words))
        anchors: dict[int, list[int]] = {}
        for k, ts in enumerate(map(self.rare.get, grams)):
            for t in ts or ():
                anchors.setdefault(t, []).append(k)
        found = []
        for t, places in anchors.items():
            name, own, _, _ = self.templates[t]
            found += [(-both, -dice, name, a, b) for both, dice, a, b in self.windows(grams, t, places)]
        for a, b in pairwise([*starts, len(words)]):
            if a < b and line_of[a] < line_of[b - 1] and anchors:
                g = set(grams[a : b - 1])
                for t in {t for x in g for t in self.rare.get(x, ())}:
                    name, own, _, _ = self.templates[t]
                    both = len(g & own)
                    if (dice := 2 * both / (len(g) + len(own))) >= self.least:
                        found.append((-both, -dice, name, a, b))
        taken, out = bytearray(len(words)), []
        for _, dice, name, a, b in sorted(found):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((line_of[a], line_of[b - 1], name, -dice))
        return out


def passages(docs: DataFrame, templates=TEMPLATES + PASSAGES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, first, last, license, dice``: every passage of a text that is a notice, with its lines; repeated rows give repeated passages."""
    finder = Passages(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, x in enumerate(batch.column(2)):
                new = finder.find(x.as_py())
                at += [k] * len(new)
                rows += new
            first, last, names, dice = zip(*rows, strict=True) if rows else ((),) * 4
            kept = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(names, pa.string()), pa.array(dice, pa.float64())], names=[key, "row", "first", "last", "license", "dice"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), row_key(F.col(text)).alias("row"), F.col(text)).mapInArrow(run, f"`{key}` {kind}, row bigint, first int, last int, license string, dice double")


def notices(docs: DataFrame, templates=TEMPLATES, longer=PASSAGES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, license, dice`` of every notice: matching lines, and the passages that are no such line."""
    lines = matches(docs, templates, least, key, text).select(key, "row", "line", F.struct("license", "dice").alias("whole"), F.lit(None).cast("struct<first:int,last:int,license:string,dice:double>").alias("p"))
    parts = passages(docs, tuple(templates) + tuple(longer), least, key, text).distinct().withColumn("p", F.struct("first", "last", "license", "dice"))
    parts = parts.select(key, "row", F.explode(F.sequence("first", "last")).alias("line"), F.lit(None).cast("struct<license:string,dice:double>").alias("whole"), "p")
    by_line = lines.unionByName(parts).groupBy(key, "row", "line").agg(F.max("whole").alias("whole"), F.collect_list("p").alias("ps"))
    several = lambda p: p["first"] < p["last"]
    begun = F.filter("ps", lambda p: (p["first"] == F.col("line")) & (several(p) | F.col("whole").isNull()))
    whole = F.when(F.col("whole").isNotNull() & ~F.exists("ps", several), F.array("whole")).otherwise(F.array().cast("array<struct<license:string,dice:double>>"))
    each = F.concat(whole, F.transform(begun, lambda p: F.struct(p["license"].alias("license"), p["dice"].alias("dice"))))
    return by_line.select(key, "row", F.inline(each))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: ``key, n_matches, licenses`` (distinct names, sorted), ``best_license, best_dice``."""
    found = notices(docs, templates, PASSAGES, least, key, text).groupBy(F.col(key).alias("_k"), F.col("row").alias("_r")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.min_by(F.struct("license", "dice"), F.struct(-F.col("dice"), F.col("license"))).alias("b")
    )
    base = docs.select(F.col(key), row_key(F.col(text)).alias("row"))
    out = base.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_r")), "left")
    return out.select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("names", F.lit("")).alias("licenses"), F.coalesce("b.license", F.lit("")).alias("best_license"), F.round(F.coalesce("b.dice", F.lit(0.0)), 6).alias("best_dice")
    )


def oracle(templates=TEMPLATES, least: float = LEAST) -> str:
    """The scan of lines in DuckDB SQL, without size bounds: every line against every template that shares a bigram."""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates))
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    grams = (
        "CASE WHEN norm = '' THEN CAST([] AS VARCHAR[]) WHEN len(string_split(norm, ' ')) = 1 THEN [norm] "
        "ELSE list_distinct(list_transform(range(1, len(string_split(norm, ' '))), lambda i: string_split(norm, ' ')[i] || ' ' || string_split(norm, ' ')[i + 1])) END"
    )
    return f"""
WITH t(template, license, text) AS (VALUES {values}),
tn AS (SELECT template, license, {norm("text")} AS norm FROM t),
tg AS (SELECT template, license, {grams} AS g FROM tn),
tt AS (SELECT template, license, len(g) AS q, unnest(g) AS gram FROM tg),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
ln AS (SELECT doc_id, line, {norm("s")} AS norm FROM l),
lg AS (SELECT doc_id, line, {grams} AS g FROM ln),
lt AS (SELECT doc_id, line, len(g) AS p, unnest(g) AS gram FROM lg),
m AS (SELECT doc_id, line, template, license, 2.0 * count(*) / (p + q) AS dice FROM lt JOIN tt USING (gram) GROUP BY doc_id, line, template, license, p, q),
b AS (SELECT doc_id, line, license, dice, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS r FROM m WHERE dice >= {least}),
d AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, first(license ORDER BY dice DESC, license) AS bl, max(dice) AS bd FROM b WHERE r = 1 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses, coalesce(bl, '') AS best_license, round(coalesce(bd, 0.0), 6) AS best_dice
FROM documents LEFT JOIN d USING (doc_id)"""
