"""Licence texts and notices in documents, by Dice coefficient over word bigrams, in DataFrame functions only.

Units are a document's lines, its paragraphs (between blank lines, if of more than one line), the whole text (if of more than
one paragraph), and stretches: the longest runs of words within a line whose neighbouring pairs all occur in templates, which
finds a notice inside a longer line.  A unit with ``a`` distinct bigrams can reach a coefficient of ``LEAST`` with a template of
``b`` only if ``LEAST / (2 - LEAST) <= a / b <= (2 - LEAST) / LEAST``, and only if ``LEAST / (2 - LEAST)`` of its own bigrams occur
in templates at all; units that fail never expand, and pairs outside the bounds never count.

Each word is hashed once; lines, paragraphs and texts share the hashes.  The templates are constants of this package (full
texts in ``licences``), so their bigrams are a bounded set in the query and a bounded broadcast.

Skew: counts are keyed by unit; a template that a third of all documents hold is one key for each of them.

Defined results: a null or empty text has no unit; units of fewer than two words match nothing; of equal coefficients the first
licence and variant in text order wins; equal rows are reported each; other columns are not read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.decontamination import gapped_words

LEAST = 0.8
STRETCH = 3  # pairs of a stretch at least
_TEXTS = Path(__file__).parent / "licences"

# Public licence texts and notices, as (licence, variant, text).
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE"
    " LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH"
    " DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,"
    " either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but"
    " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
TEMPLATES = [
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
     " Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
     " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
     " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice-licensed", "Licensed under the MIT License."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
     " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
     " distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
     " for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "text", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", "text", _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
     " above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH"
     " REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
     " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR"
     " OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0", "header", _GNU.format(name="General Public License", version=3)),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "header", _GNU.format(name="General Public License", version=2)),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "header", _GNU.format(name="Lesser General Public License", version=3)),
    ("AGPL-3.0", "header", _GNU.format(name="Affero General Public License", version=3)),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
     " this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public"
     " domain worldwide. This work is distributed without any warranty."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
     " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any"
     " means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the"
     " software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
     " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright"
     " law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to"
     " <https://unlicense.org>"),
    *((path.stem, "full text", path.read_text("utf-8")) for path in sorted(_TEXTS.glob("*.txt"))),
    *((f"CC-{kind}-4.0", "notice", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
]


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(gapped_words(text), lambda w: w != ""), lambda w: F.xxhash64(w))


def pairs(hashes: str | Column) -> Column:
    """Hashes of neighbouring words' pairs."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(licence, variant, grams, b)`` of the templates."""
    rows = spark.createDataFrame(TEMPLATES if templates is None else templates, "licence string, variant string, text string")
    rows = rows.withColumn("grams", F.array_distinct(pairs(word_hashes(F.col("text"))))).withColumn("b", F.size("grams"))
    return rows.where("b > 0").select("licence", "variant", "grams", "b")


def units(docs: DataFrame, known: str) -> DataFrame:
    """``(_row, doc_id, kind, line, word, hashes)``: the unit's word hashes, and the numbers of the line and of the word in it, from
    0, at which it begins.  ``known`` is the list of the templates' pairs, as SQL."""
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.split("text", "\n").alias("_lines"))
    lines = lines.withColumn("_hashes", F.transform("_lines", word_hashes))
    lines = lines.withColumn("_blank", F.expr("filter(sequence(-1, size(_lines)), i -> i < 0 OR i >= size(_lines) OR trim(_lines[i]) = '')"))
    unit = "named_struct('kind', '{}', 'line', cast({} AS bigint), 'word', cast({} AS bigint), 'hashes', {})"
    own = F.expr("transform(_hashes, (h, i) -> " + unit.format("line", "i", 0, "h") + ")")
    block = "CASE WHEN _blank[k + 1] - _blank[k] > 2 THEN flatten(slice(_hashes, _blank[k] + 2, _blank[k + 1] - _blank[k] - 1)) END"
    paragraph = F.expr(f"filter(transform(sequence(0, size(_blank) - 2), k -> {unit.format('paragraph', '_blank[k] + 1', 0, block)}), u -> u.hashes IS NOT NULL)")
    whole = F.expr(f"CASE WHEN size(_blank) > 2 THEN array({unit.format('text', 0, 0, 'flatten(_hashes)')}) ELSE array() END")
    every = lines.select("_row", "doc_id", F.explode(F.concat(own, paragraph, whole)).alias("_u")).where("size(_u.hashes) > 1")
    every = every.withColumn("_pairs", F.when(F.col("_u.kind") == "line", pairs("_u.hashes")))
    # stretches lie between the pairs of a line that no template has
    every = every.withColumn("_gaps", F.expr(f"filter(transform(_pairs, (g, i) -> CASE WHEN g IN ({known}) THEN -1 ELSE i END), i -> i >= 0)"))
    ends = "concat(array(-1), _gaps, array(size(_pairs)))"
    size = "(_ends[k + 1] - _ends[k] - 1)"
    part = unit.format("stretch", "_u.line", "_ends[k] + 1", f"slice(_u.hashes, _ends[k] + 2, {size} + 1)")
    long = f"filter(sequence(0, size(_ends) - 2), k -> {size} >= {STRETCH} AND {size} < size(_pairs))"
    some = "_gaps IS NOT NULL AND size(_pairs) - size(_gaps) >= " + str(STRETCH)
    every = every.withColumn("_ends", F.expr(f"CASE WHEN {some} THEN {ends} END"))
    stretches = F.expr(f"CASE WHEN _ends IS NULL THEN array() ELSE transform({long}, k -> {part}) END")
    return every.select("_row", "doc_id", F.explode(F.concat(F.array("_u"), stretches)).alias("_u")).select("_row", "doc_id", "_u.*")


def matches(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``(doc_id, kind, line, word, licence, variant, dice)``: every unit's best template, if it reaches ``least``."""
    known = template_table(docs.sparkSession, templates)
    constants = known.collect()  # of this package: a bounded table
    if not constants:
        raise ValueError("no template has two words")
    low, high = least / (2 - least), (2 - least) / least
    smallest, largest = min(r.b for r in constants) * low, max(r.b for r in constants) * high
    every = ", ".join(f"{g}L" for g in sorted({g for r in constants for g in r.grams}))
    cut = units(docs, every).where(F.size("hashes") > smallest)
    cut = cut.withColumn("_grams", F.array_distinct(pairs("hashes"))).withColumn("a", F.size("_grams")).where(F.col("a").between(smallest, largest))
    cut = cut.withColumn("_known", F.expr(f"filter(_grams, g -> g IN ({every}))")).where(F.size("_known") >= F.lit(low) * F.col("a") - 1e-6)
    unit = ["_row", "doc_id", "kind", "line", "word"]
    rows = cut.select(*unit, "a", F.explode("_known").alias("gram"))
    grams = known.select("licence", "variant", "b", F.explode("grams").alias("gram"))
    both = rows.join(F.broadcast(grams), "gram").where((F.col("a") >= low * F.col("b")) & (F.col("a") <= high * F.col("b")))
    shared = both.groupBy(*unit, "licence", "variant", "a", "b").agg(F.count("*").alias("shared"))
    good = shared.withColumn("dice", F.expr("2.0D * shared / (a + b)")).where(F.col("dice") >= least)
    best = good.groupBy(*unit).agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence", "variant")).alias("m"))
    return best.select("doc_id", "kind", "line", "word", "m.licence", "m.variant", (-F.col("m.d")).alias("dice"))
