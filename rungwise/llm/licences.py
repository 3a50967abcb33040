"""Licence scan by Dice coefficient over word bigrams.

Texts are normalised to lower-case words of letters and digits. Each line,
each paragraph (parted by blank lines) and the whole text is a segment, and so is
any run of words, wherever it starts and ends, for texts of several paragraphs
inside a longer document and notices inside a line;
segments and templates are sets of word bigrams (a single word counts as one
bigram with nothing). A template is compared only if the sizes allow the
threshold: ``2 min(a, b) / (a + b) >= threshold``; sizes are known before any
bigram is made, and so are the words that no template has.

Defined results: null or empty texts match nothing (licence null, dice 0, no
segments); ties go to the earlier template, then whole text before paragraph
before line before run of words, then the earlier segment; segments are counted
as matching lines, paragraphs and whole texts, and the best runs of words that
overlap neither these nor each other; a run inside a match of a template with
more bigrams is a part of that match and no run of its own; repeated rows come out alike; a null id
is carried; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, pick

THRESHOLD = 0.8
WORDS = re.compile(r"[^\W_]+")
PARAGRAPHS = re.compile(r"\n[ \t]*\n")

#: Public licence notices and texts (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0-or-later-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)


def with_texts(texts: dict[str, str], templates=TEMPLATES) -> tuple[tuple[str, str], ...]:
    """The templates above and further ones, such as full texts of licences that a caller has read from files."""
    return (*templates, *sorted(texts.items()))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:])) if len(words) > 1 else {(w, "") for w in words}


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = [(name, bigrams(words_of(text)), k) for k, (name, text) in enumerate(templates)]
        self.by_size = sorted(self.sets, key=lambda x: len(x[1]))
        self.sizes = [len(x[1]) for x in self.by_size]
        self.words = {w for _, s, _ in self.sets for pair in s for w in pair if w}
        self.ratio = threshold / (2 - threshold)
        self.places: dict[tuple[str, str], list[int]] = {}  # templates of each bigram
        for _, s, k in self.sets:
            for pair in s:
                self.places.setdefault(pair, []).append(k)
        self.single = any(not second for _, second in self.places)

    def candidates(self, size: float):
        """Templates whose size alone does not rule out the threshold against ``size`` bigrams."""
        lo = bisect.bisect_left(self.sizes, self.ratio * size - 1e-9)
        hi = bisect.bisect_right(self.sizes, size / self.ratio + 1e-9)
        return self.by_size[lo:hi]

    def best(self, words: list[str]):
        """(dice, template's place, name) of the best template at or above the threshold, or nothing."""
        # distinct bigrams are at most as many as pairs; those with a foreign word never match
        own = sum(w in self.words for w in words)
        if own < 1 or not self.sizes or own < self.ratio * self.sizes[0]:
            return None
        have = bigrams(words)
        found = None
        for name, s, k in self.candidates(len(have)):
            if own < self.ratio * len(s):  # too few words of any template
                continue
            dice = 2 * len(have & s) / (len(have) + len(s))
            if dice >= self.threshold and (found is None or (-dice, k) < (-found[0], found[1])):
                found = (dice, k, name)
        return found

    def runs(self, words: list[str]):
        """(-dice, template's place, first word, word after the last) of the best run of words from each start, by template.

        A best run starts and ends on bigrams of its template, and does not meet its first one again: without
        that bigram it would be no worse. So the runs from one bigram's occurrences never overlap, and a text
        takes time in proportion to its length.
        """
        found = []
        if self.single:
            found += [(-1.0, k, i, i + 1) for i, w in enumerate(words) for k in self.places.get((w, ""), ())]
        pairs = list(zip(words, words[1:]))
        at: dict[int, list[int]] = {}
        for i, ks in enumerate(map(self.places.get, pairs)):
            if ks:
                for k in ks:
                    at.setdefault(k, []).append(i)
        for k, starts in at.items():
            s = self.sets[k][1]
            if len({pairs[i] for i in starts}) < self.ratio * len(s) - 1e-9:  # too few of its bigrams anywhere
                continue
            most = len(s) / self.ratio + 1e-9
            again: dict[tuple[str, str], int] = {}
            for i in reversed(starts):
                stop = again.get(pairs[i], len(pairs))
                again[pairs[i]] = i
                seen, hits, best, end = set(), 0, 0.0, i
                for j in range(i, stop):
                    pair = pairs[j]
                    if pair in seen:
                        continue
                    seen.add(pair)
                    if len(seen) > most:
                        break
                    if pair in s:
                        hits += 1
                        dice = 2 * hits / (len(seen) + len(s))
                        if dice > best:
                            best, end = dice, j
                if best >= self.threshold:
                    found.append((-best, k, i, end + 2))
        return sorted(found)

    def outermost(self, runs, spans):
        """The runs that lie inside no other match of a larger template; ``spans`` are (first, end, template's place) of segments."""
        size = [len(s) for _, s, _ in self.sets]
        kept = []
        for n in sorted({size[r[1]] for r in runs}, reverse=True):
            larger = sorted([x[:2] for x in spans if size[x[2]] > n] + [r[2:] for r in kept if size[r[1]] > n])
            ends = list(itertools.accumulate((end for _, end in larger), max))
            for r in (r for r in runs if size[r[1]] == n):
                before = bisect.bisect_right(larger, r[2], key=lambda x: x[0])
                if not before or ends[before - 1] < r[3]:
                    kept.append(r)
        return sorted(kept)

    def scan(self, text: str | None):
        """(licence, dice, unit, matching segments) of a text."""
        lines = [words_of(part) for part in (text or "").split("\n")]
        words = [w for part in lines for w in part]
        paragraphs = (words_of(part) for part in PARAGRAPHS.split(text or ""))
        found, spans, taken = [], [], bytearray(len(words))
        for order, (unit, parts) in enumerate((("text", [words]), ("paragraph", paragraphs), ("line", lines))):
            first = 0
            for nth, part in enumerate(parts):
                got = self.best(part)
                if got:
                    found.append((-got[0], got[1], order, nth, got[2], unit))
                    spans.append((first, first + len(part), got[1]))
                    taken[first : first + len(part)] = b"\1" * len(part)
                first += len(part)
        count = len(found)
        for dice, k, first, end in self.outermost(self.runs(words), spans):
            found.append((dice, k, 3, first, self.sets[k][0], "words"))
            if not any(taken[first:end]):
                count += 1
                taken[first:end] = b"\1" * (end - first)
        if not found:
            return None, 0.0, None, 0
        first = min(found)
        return first[4], round(-first[0], 9), first[5], count


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, unit, n_segments of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, threshold)
        for whole in batches:
            for batch in by_bytes(whole, 1, 1 << 20):
                cols = list(zip(*[scanner.scan(t) for t in batch.column(1).to_pylist()]))
                kinds = (pa.string(), pa.float64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "licence", "dice", "unit", "n_segments"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licence string, dice double, unit string, n_segments long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BIGRAMS = "list_distinct(CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE {w} END)"

ORACLE = f"""
WITH t AS (SELECT k, name, {_BIGRAMS.format(w="w")} AS g FROM (
  SELECT k, name, regexp_extract_all(lower(body), '[\\pL\\pN]+') AS w FROM (VALUES {", ".join(f"({k}, {_sql(n)}, {_sql(b)})" for k, (n, b) in enumerate(TEMPLATES))}) v(k, name, body))),
parts AS (
  SELECT doc_id, 0 AS ord, 'text' AS unit, [coalesce(text, '')] AS p FROM documents
  UNION ALL SELECT doc_id, 1, 'paragraph', string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n') FROM documents
  UNION ALL SELECT doc_id, 2, 'line', string_split(coalesce(text, ''), chr(10)) FROM documents),
segments AS (SELECT doc_id, ord, unit, nth, regexp_extract_all(lower(p[nth]), '[\\pL\\pN]+') AS w FROM parts, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS nth)),
s AS (SELECT doc_id, ord, unit, nth, {_BIGRAMS.format(w="w")} AS g FROM segments WHERE len(w) > 0),
d AS (SELECT doc_id, ord, unit, nth, k, name, 2 * len(list_intersect(s.g, t.g)) / CAST(len(s.g) + len(t.g) AS DOUBLE) AS dice
      FROM s JOIN t ON 2 * least(len(s.g), len(t.g)) >= {THRESHOLD} * (len(s.g) + len(t.g))),
m AS (SELECT * FROM d WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, ord, nth ORDER BY dice DESC, k) = 1),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k, ord, nth) = 1)
SELECT o.doc_id, b.name AS licence, coalesce(round(b.dice, 9), 0.0) AS dice, b.unit, CAST(coalesce(b.n, 0) AS BIGINT) AS n_segments
FROM documents o LEFT JOIN b ON b.doc_id = o.doc_id
"""
