"""License scans: parts and windows of texts compared with licence templates by the Dice coefficient of their sets of word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Licence notices and short licence texts, (name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

WORD = r"[\p{L}\p{N}]+"
_WORD = regex.compile(WORD)
_BLANK = re.compile(r"\n[ \t\r]*\n")

FOUND = "array<struct<licence:string,score:double,start:int,end:int>>"


def bigrams(text: str) -> set[tuple[str, str]]:
    """The distinct pairs of neighbouring words of the normalised text: lower case, letters and digits only."""
    return set(pairwise(_WORD.findall(text.lower())))


@cache
def prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, frozenset, int]], frozenset]:
    """The templates' bigram sets and numbers of bigrams, repeats counted, by size; and all bigrams of any."""
    sets = [(name, frozenset(pairs), len(pairs)) for name, text in templates if (pairs := list(pairwise(_WORD.findall(text.lower()))))]
    sets.sort(key=lambda x: (len(x[1]), x[0]))
    return sets, frozenset().union(*(t for _, t, _ in sets))


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts that are compared: each line, each paragraph of several lines, and the whole text."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    at = 0
    for end, after in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        if "\n" in text[at:end]:
            spans.append((at, end))
        at = after
    if "\n" in text:
        spans.append((0, len(text)))
    return iter(dict.fromkeys(spans))


def windows(grams: list[tuple[str, str]], template: frozenset, size: int, threshold: float) -> Iterator[tuple[float, int]]:
    """(score, first bigram) of the windows of ``size`` bigrams that reach ``threshold``, each starting with one of the template's.

    Hits are counted by running sums first; a window's distinct bigrams are then kept up from one start to the next, so
    the whole is linear in the text.
    """
    hits = np.fromiter(map(template.__contains__, grams), bool, len(grams))
    total = np.r_[0, np.cumsum(hits)]
    starts = np.flatnonzero(hits)
    held: dict[tuple[str, str], int] = {}
    lo = hi = shared = 0
    for s in starts[total[np.minimum(starts + size, len(grams))] - total[starts] >= threshold / (2 - threshold) * len(template) - 1e-9].tolist():
        if s >= hi:
            held.clear()
            lo = hi = s
            shared = 0
        for g in grams[lo:s]:
            held[g] -= 1
            if not held[g]:
                del held[g]
                shared -= g in template
        for g in grams[hi : s + size]:
            shared += g not in held and g in template
            held[g] = held.get(g, 0) + 1
        lo, hi = s, min(s + size, len(grams))
        if (score := 2 * shared / (len(held) + len(template))) >= threshold:
            yield score, s


def word_spans(text: str) -> list[tuple[int, int]]:
    """Places in ``text`` of the words of its lower-cased form, which may be longer."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    ends = np.cumsum([len(c.lower()) for c in text])
    return [(int(np.searchsorted(ends, s, "right")), int(np.searchsorted(ends, e - 1, "right")) + 1) for s, e in spans]


def scan(text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(licence, score, start, end) of each part and licence at ``threshold`` or more, by start, end and name.

    Beside the parts of ``units``, windows of a template's own length are compared wherever they begin with one of its
    bigrams, so that a notice in running prose or over several paragraphs is found.  Of windows that overlap each
    other or a part of the same licence only the best stay.
    """
    sets, vocabulary = prepared(templates)
    grams = list(pairwise(_WORD.findall(text.lower())))
    # a Dice coefficient of t needs sizes a, b with t / (2 - t) <= a / b <= (2 - t) / t, and so many shared ones
    ratio = threshold / (2 - threshold)
    seen = vocabulary.intersection(grams)
    live = [x for x in sets if len(seen) >= ratio * len(x[1]) - 1e-9 and len(seen & x[1]) >= ratio * len(x[1]) - 1e-9]
    if not live:
        return []
    least, most = len(live[0][1]) * ratio, len(live[-1][1]) / ratio
    found: dict[tuple[int, int, str], float] = {}
    for start, end in units(text):
        own = bigrams(text[start:end])
        a = len(own)
        if not least <= a <= most or len(common := seen & own) * 2 < threshold * (a + len(live[0][1])):
            continue
        for name, t, _ in live:
            if ratio * len(t) <= a <= len(t) / ratio and (score := 2 * len(common & t) / (a + len(t))) >= threshold:
                key = (start, end, name)
                found[key] = max(found.get(key, 0.0), score)

    hit = [(-score, s, min(s + size, len(grams)), name) for name, t, size in live for score, s in windows(grams, t, size, threshold)]
    if hit:
        spans = word_spans(text)
        begins = [s for s, _ in spans]
        taken = {name: np.zeros(len(spans), bool) for *_, name in hit}
        ranked = [(-score, 0, start, end, name) for (start, end, name), score in found.items() if name in taken]
        for score, kind, start, end, name in sorted(ranked + [(score, 1, spans[s][0], spans[e][1], name) for score, s, e, name in hit]):
            words = slice(bisect_left(begins, start), bisect_left(begins, end))
            if kind and taken[name][words].any():
                continue
            taken[name][words] = True
            key = (start, end, name)
            found[key] = max(found.get(key, 0.0), -score)
    return [(name, score, start, end) for (start, end, name), score in sorted(found.items())]


def matches(text: Column | str, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """The matches of a text column as an array of structs, empty for none; a null text counts as empty."""

    @F.arrow_udf(FOUND)
    def run(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[dict(zip(("licence", "score", "start", "end"), m, strict=True)) for m in scan(t.as_py() or "", templates, threshold)] for t in x], kind)

    return run(text)


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its best licence (highest score, then the first name), that score, and all licences found.

    licence and score are null and licences is empty where nothing matches.  Null ids and repeated rows keep their
    rows; an empty table gives an empty result; other columns are ignored.
    """
    d = docs.select("doc_id", matches("text").alias("m"))
    best = F.element_at(F.array_sort(F.transform("m", lambda x: F.struct((-x["score"]).alias("s"), x["licence"].alias("l")))), 1)
    return d.select(
        "doc_id",
        F.when(F.size("m") > 0, best["l"]).alias("licence"),
        F.when(F.size("m") > 0, -best["s"]).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["licence"]))), ",").alias("licences"),
    )


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same in SQL: parts and windows, their bigram lists, and each against each template.
ORACLE_SQL = f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({n}, {sql_text(a)}, {sql_text(b)})" for n, (a, b) in enumerate(TEMPLATES))}) AS t(n, licence, body)),
docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT row, unnest(list_distinct(list_concat(
    list_transform(string_split(text, chr(10)), lambda x: 'l' || x),
    CASE WHEN contains(text, chr(10)) THEN list_concat(
      list_transform(list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: contains(x, chr(10)) AND x <> text), lambda x: 'p' || x), ['w' || text]) ELSE [] END))) AS part
  FROM docs),
words AS (SELECT row, regexp_extract_all(lower(part[2:]), '{WORD}') AS w FROM parts),
grams AS (SELECT row, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
tw AS (SELECT n, licence, regexp_extract_all(lower(body), '{WORD}') AS w FROM templates),
tg AS (SELECT n, licence, len(w) - 1 AS size, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM tw),
scored AS (SELECT row, licence, 2 * len(list_intersect(g, t)) / (len(g) + len(t)) AS score FROM grams JOIN tg ON len(g) BETWEEN len(t) * {THRESHOLD} / (2 - {THRESHOLD}) - 1 AND len(t) * (2 - {THRESHOLD}) / {THRESHOLD} + 1),
whole AS (SELECT row, regexp_extract_all(lower(text), '{WORD}') AS w FROM docs),
run AS (SELECT row, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM whole WHERE len(w) >= 2),
places AS (SELECT row, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS p FROM run),
meets AS (SELECT row, n, size, p FROM places JOIN (SELECT n, size, unnest(t) AS gram FROM tg) USING (gram)),
starts AS (SELECT row, n, size, p, count(*) OVER (PARTITION BY row, n ORDER BY p RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS hits FROM meets),
likely AS (SELECT row, p, licence, t, tg.size FROM starts JOIN tg USING (n) WHERE hits >= len(t) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9),
slid AS (SELECT row, licence, t, list_distinct(g[p:p + size - 1]) AS g FROM likely JOIN run USING (row)),
passed AS (SELECT row, licence, score FROM scored UNION ALL SELECT row, licence, 2 * len(list_intersect(g, t)) / (len(g) + len(t)) FROM slid),
hits AS (SELECT row, licence, max(score) AS score FROM passed WHERE score >= {THRESHOLD} GROUP BY ALL),
best AS (SELECT row, arg_min(licence, {{'s': -score, 'l': licence}}) AS licence, max(score) AS score, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hits GROUP BY row)
SELECT d.doc_id, b.licence, b.score, coalesce(b.licences, '') AS licences FROM docs d LEFT JOIN best b USING (row)
"""
