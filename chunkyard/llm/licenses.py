"""Licence scans, with DataFrame functions only.

Words are lower-cased (A-Z) runs of letters and digits; shingles are five words. Overlapping windows of WINDOW shingles, half a
window apart, get a MinHash signature: coordinate k is the smallest value of the shingles' 64-bit hashes after exclusive-or
with a fixed mask. Every coordinate is a band of one row. Templates are windowed at every offset, so a copied passage meets a
template window without a shift; with a similarity j the bands all miss with probability (1 - j)**6, 0.4 % at j = 0.6 for
one window, and a passage lies in several. Templates shorter than a window are a stated exception: a signature of a few shingles would
drown in a window, so they have windows of one shingle, whose band is the shingle itself, and nothing that contains a shingle of
theirs is missed. Band hits retrieve templates, and a template
counts when at least 75 % of its different shingles, compared as text, are in the document. The two BSD notices share more than that,
so of these a document gets those whose shingles it holds, the longer one only with its own clause (see KEPT_APART).

Everything happens in the row of a document: no shuffle, no task that gathers a group. Null and empty texts, and those with
fewer than five words, match nothing; null ids pass through; repeated rows match each; a very long text is read whole. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices, whole.
_AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. " + _AS_IS_MIT
    ),
    "BSD-2-Clause-text": _BSD_CONDITIONS + " " + _AS_IS_BSD,
    "BSD-3-Clause-text": (
        _BSD_CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _AS_IS_BSD
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
}
#: A template, and one that holds all its text: the longer counts only with at least half of the shingles that it alone has, and then in place of the shorter.
KEPT_APART = {"BSD-2-Clause-text": "BSD-3-Clause-text"}
WORDS, WINDOW, STEP = 5, 32, 16
MASKS = (0x1F83D9ABFB41BD6B, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B, 0x510E527FADE682D1, 0x7BE0CD19137E2179, 0x0A54FF53A5F1D36F)
PERCENT = 75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_shingles(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def _minima(hashes: Column, mask: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask))))


def _window_bands(blocks: Column, mask: int) -> Column:
    """Band values of one coordinate: each pair of neighbouring blocks is a window."""
    least = F.transform(blocks, lambda b: _minima(b, mask))
    after = F.concat(F.slice(least, 2, F.greatest(F.size(least) - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    pairs = F.zip_with(least, after, lambda a, b: F.least(a, b))
    return F.transform(pairs, lambda v: F.xxhash64(v, F.lit(mask)))


def _template_bands(spark, templates: dict[str, str]) -> dict[str, list[int]]:
    """Bands of each template, by the functions that documents go through; a few hundred values."""
    rows = []
    for name, text in templates.items():
        s = template_shingles(text)
        if len(s) < WINDOW:
            rows += [(name, [x], 1) for x in s]
        else:
            rows += [(name, s[i : i + WINDOW], 0) for i in range(len(s) - WINDOW + 1)]
    df = spark.createDataFrame(rows, "name string, shingles array<string>, single int")
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    values = [F.xxhash64(_minima(hashes, m), F.lit(m)) for m in MASKS]
    bands = df.select("name", F.explode(F.when(F.col("single") == 1, hashes).otherwise(F.array(*values))).alias("band"))
    out: dict[str, list[int]] = {}
    for r in bands.distinct().collect():
        out.setdefault(r["name"], []).append(r["band"])
    return {k: sorted(v) for k, v in sorted(out.items())}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, n_matched, n_template (different shingles), first_word (where its first matched shingle begins, from 0)."""
    templates = TEMPLATES if templates is None else templates
    bands = _template_bands(docs.sparkSession, templates)
    longs = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)" for x in xs) + ")")
    every = longs(sorted({x for v in bands.values() for x in v})) if bands else F.expr("cast(array() as array<bigint>)")
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.select("doc_id", words.alias("words"))
    n = F.size("words") - (WORDS - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hashed = split.select("doc_id", "words", F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("words", i, WORDS), " "))).alias("hashes"))
    starts = F.when(F.size("hashes") > 0, F.sequence(F.lit(1), F.size("hashes"), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    blocked = hashed.select("doc_id", "words", "hashes", F.transform(starts, lambda i: F.slice("hashes", i, STEP)).alias("blocks"))
    banded = blocked.select("doc_id", "words", F.array_intersect(F.flatten(F.array(F.col("hashes"), *(_window_bands(F.col("blocks"), m) for m in MASKS))), every).alias("hits"))
    shown = F.when(F.size("hits") > 0, F.transform(F.sequence(F.lit(1), F.size("words") - (WORDS - 1)), lambda i: F.array_join(F.slice("words", i, WORDS), " "))).otherwise(F.array().cast("array<string>"))
    held = banded.select("doc_id", "hits", shown.alias("shown"))

    sets = {name: sorted(set(template_shingles(text))) for name, text in templates.items()}
    held_of = lambda own: F.array_intersect(F.array(*map(F.lit, own)), F.col("shown"))

    def has_clause(short: str, long: str) -> Column:
        """Whether the longer of two such templates is meant."""
        own = sorted(set(sets[long]) - set(sets[short]))
        return F.size(held_of(own)) * 2 >= len(own)

    def verdict(name: str) -> Column:
        own = sets[name]
        common = held_of(own)
        meant = F.arrays_overlap(F.col("hits"), longs(bands[name]))
        for short, long in KEPT_APART.items():
            if name in (short, long) and {short, long} <= set(sets):
                meant = meant & (has_clause(short, long) if name == long else ~has_clause(short, long))
        return F.when(
            meant,
            F.struct(
                F.lit(name).alias("license"),
                F.size(common).cast("bigint").alias("n_matched"),
                F.lit(len(own)).cast("bigint").alias("n_template"),
                F.array_min(F.transform(common, lambda s: F.array_position("shown", s) - 1)).alias("first_word"),
            ),
        )

    all_of = F.array(*(verdict(x) for x in bands)) if bands else F.expr("cast(array() as array<struct<license:string,n_matched:bigint,n_template:bigint,first_word:bigint>>)")
    found = F.when(F.size("hits") > 0, F.filter(all_of, lambda v: v.isNotNull() & (v["n_matched"] * 100 >= v["n_template"] * percent))).otherwise(F.expr("cast(null as array<struct<license:string,n_matched:bigint,n_template:bigint,first_word:bigint>>)"))
    return held.select("doc_id", F.inline(found))
