"""Licence scan: units of a text against licence templates by the Dice coefficient of their word-bigram sets.

Units are the whole text, its paragraphs (split at blank lines) and its lines. Dice of at least t needs sizes within
a factor of (2 - t) / t, so only templates in these bounds are candidates. It also needs more than a third (at t = 0.8) of a
template's bigrams, so of every template a few bigrams are a sufficient prefix: a text that holds no word of any prefix is
left after one look at its words. Work is one pass over the rows in Arrow batches of bounded bytes, without a shuffle.

Defined cases: null or empty text, or units of fewer than two words, match nothing (license null, dice 0.0); of equal
scores the first template by name wins; repeated rows are scanned row by row; null doc_id is kept; very long texts are scanned
whole, one at a time; no rows give no rows; extra columns take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .textops import pieces

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[ \t\r]*\n"
#: Licence notices that projects put into their files, and short licences in full, as published. Fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "MIT": (
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


class Matcher:
    """Best template of each unit; the templates are a small fixed set."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.word, self.fold = re.compile(WORD), str.maketrans(UPPER, LOWER)
        self.paragraph = re.compile(PARAGRAPH)
        self.threshold, self.ratio = threshold, (2 - threshold) / threshold + 1e-9  # sizes just at the bound stay candidates
        self.templates = sorted((name, self.bigrams(self.words(t))) for name, texts in templates.items() for t in texts)
        sizes = [len(b) for _, b in self.templates]
        self.least, self.most = min(sizes) / self.ratio, max(sizes) * self.ratio
        self.any = frozenset().union(*(b for _, b in self.templates))
        # Dice >= t with sizes a and b needs at least t * (a + b) / 2 shared bigrams, and a >= b / ratio. A unit without any
        # bigram of a prefix can share only the rest, which is too few. Long words are rare words.
        self.prefix_words = set()
        for _, b in self.templates:
            needed = math.ceil(threshold * (len(b) + len(b) / self.ratio) / 2 - 1e-9)
            rare = sorted(b, key=lambda g: (-max(len(g[0]), len(g[1])), g))[: len(b) - needed + 1]
            self.prefix_words.update(max(g, key=lambda w: (len(w), w)) for g in rare)

    def words(self, text: str) -> list[str]:
        return self.word.findall(text.translate(self.fold))

    @staticmethod
    def bigrams(words: list[str]) -> frozenset:
        return frozenset(zip(words, words[1:], strict=False))

    def best(self, words: list[str]) -> tuple[float, str] | None:
        if len(words) - 1 < self.least:
            return None
        own = self.bigrams(words)
        if not self.least <= len(own) <= self.most or own.isdisjoint(self.any):
            return None
        found = None
        for name, other in self.templates:
            if len(own) <= len(other) * self.ratio and len(other) <= len(own) * self.ratio:
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, name)
        return found

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """(licence, its Dice coefficient, units that match any template)."""
        units = []
        if text and not self.prefix_words.isdisjoint(self.words(text)):
            lines = [self.words(x) for x in text.split("\n")]
            hits = [self.best(x) for x in lines]
            parts = self.paragraph.split(text)
            hits += [self.best(self.words(x)) for x in parts if "\n" in x] if len(parts) > 1 else []
            if len(lines) > 1:
                hits.append(self.best([w for x in lines for w in x]))
            units = [x for x in hits if x]
        if not units:
            return None, 0.0, 0
        top = max(d for d, _ in units)
        return min(n for d, n in units if d == top), round(top, 6), len(units)


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, license, dice, n_units."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in pieces(batches, 1):
            rows = [matcher.scan(t) for t in batch.column(1).to_pylist()]
            names, dice, units = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(dice, pa.float64()), pa.array(units, pa.int64())], [id_col, "license", "dice", "n_units"])

    slim = docs.select(id_col, text)
    return slim.mapInArrow(scan, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, license string, dice double, n_units bigint")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in TEMPLATES.items() for text in texts)
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '{WORD}')"
    grams = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, text FROM documents
), units AS (
  SELECT row_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit FROM d
  UNION ALL SELECT row_id, 'part', unit FROM (SELECT row_id, unnest(string_split_regex(text, '{PARAGRAPH}')) AS unit, len(string_split_regex(text, '{PARAGRAPH}')) AS n FROM d) WHERE n > 1 AND contains(unit, chr(10))
  UNION ALL SELECT row_id, 'all', text FROM d WHERE contains(text, chr(10))
), u AS (
  SELECT row_number() OVER () AS uid, row_id, {grams} AS b FROM (SELECT row_id, {words("unit")} AS ws FROM units) WHERE len(ws) > 1
), t AS (
  SELECT name, {grams} AS b FROM (SELECT name, {words("txt")} AS ws FROM (VALUES {rows}) v(name, txt))
), tg AS (
  SELECT name, len(b) AS n, md5(b::VARCHAR) AS tid, unnest(b) AS x FROM t
), g AS (
  SELECT uid, row_id, len(b) AS n, unnest(b) AS x FROM u
), s AS (
  SELECT uid, row_id, name, 2 * count(*) / (any_value(g.n) + any_value(tg.n)) AS dice FROM g JOIN tg USING (x) GROUP BY uid, row_id, name, tid HAVING dice >= {THRESHOLD}
), best AS (
  SELECT row_id, arg_min(name, (-dice, name)) AS license, round(max(dice), 6) AS dice, count(DISTINCT uid) AS n_units FROM s GROUP BY row_id
)
SELECT doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(n_units, 0) AS n_units FROM d LEFT JOIN best USING (row_id)
"""


ORACLE = _oracle()
