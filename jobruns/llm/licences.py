"""Finding licence texts and notices in documents by the Dice coefficient over word bigrams.

Every line of a text, every paragraph of several lines, and the text itself where it has several paragraphs are
compared to the templates. With a and b bigrams the coefficient is at most 2 min(a, b) / (a + b), so a unit is
compared only to templates whose size lies within that bound; for most units there are none and their
bigrams are never formed.

A licence may also stand inside a sentence, or its paragraphs in a longer text. So windows of words are compared too, wherever they
begin: a window with w bigrams that shares s with a template of m has s <= w, so to reach t it needs s >= m t / (2 - t)
and w <= m (2 - t) / t. Templates that share fewer bigrams with the whole text are ruled out at once, and so are windows
without as many of the template's bigrams. Whole texts are scanned in one pass without a shuffle.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import pairwise
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table

LEAST = 0.8

# Public licence texts and the usual notices, by SPDX identifier.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_TERMS = """The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""
_MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
_BSD_SOURCE = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer."""
_BSD_BINARY = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        _MIT_GRANT,
        _MIT_AS_IS,
        f"{_MIT_GRANT} {_MIT_TERMS} {_MIT_AS_IS}",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
    ],
    "BSD-2-Clause": [f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}"],
    "BSD-3-Clause": [
        f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_AS_IS}",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "Licensed under the ISC License.",
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software."""
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
}

_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"[^\n]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


def lowered(text: str) -> str:
    """The text in lower case, each letter in its place; the few that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def bigrams(tokens: list[str]) -> Counter[tuple[str, str]]:
    return Counter(pairwise(tokens))


def dice(a: Counter, b: Counter) -> float:
    """Twice the bigrams in common over all bigrams, repeats counted."""
    both = a.total() + b.total()
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / both if both else 0.0


class Scanner:
    """Templates in order of size; ``compared`` counts the coefficients of units worked out."""

    def __init__(self, templates: Mapping[str, list[str]] = TEMPLATES, least: float = LEAST) -> None:
        made = [(name, bigrams(words(t))) for name, texts in templates.items() for t in texts]
        self.made = sorted(((c.total(), name, c) for name, c in made), key=lambda x: x[:2])
        self.sizes, self.least, self.compared = [n for n, _, _ in self.made], least, 0
        self.ratio = least / (2 - least)
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, own) in enumerate(self.made):
            for pair in own:
                self.holders.setdefault(pair, []).append(i)

    def candidates(self, size: int) -> tuple[int, int]:
        """The range of templates that a unit of ``size`` bigrams can reach ``least`` with."""
        return bisect_left(self.sizes, size * self.ratio - 1e-9), bisect_right(self.sizes, size / self.ratio + 1e-9)

    def _units(self, text: str) -> Iterator[tuple[str, int, int, list[list[str]]]]:
        """(kind, start, end, words of the lines) of lines, paragraphs and the text."""
        block: list[tuple[int, int, list[str]]] = []
        paragraphs: list[list[tuple[int, int, list[str]]]] = []
        last = 0
        for m in _LINE.finditer(text):
            tokens = words(m[0])
            if block and (m.start() > last + 1 or not tokens):
                paragraphs.append(block)
                block = []
            last = m.end()
            if tokens:
                yield "line", m.start(), m.end(), [tokens]
                block.append((m.start(), m.end(), tokens))
        if block:
            paragraphs.append(block)
        for lines in [p for p in paragraphs if len(p) > 1]:
            yield "paragraph", lines[0][0], lines[-1][1], [t for _, _, t in lines]
        if len(paragraphs) > 1:
            yield "text", paragraphs[0][0][0], paragraphs[-1][-1][1], [t for p in paragraphs for _, _, t in p]

    def _best_end(self, pairs: list[tuple[str, str]], own: Counter, size: int, places: list[int]) -> tuple[float, int, int]:
        """Of the windows from the first of ``places`` to one of them: the highest coefficient, its last place, bigrams shared."""
        left, shared, best = dict(own), 0, (0.0, 0, 0)
        for last in places:
            if left[pairs[last]]:
                left[pairs[last]] -= 1
                shared += 1
                reached = 2 * shared / (size + last - places[0] + 1)
                if reached > best[0]:
                    best = reached, last, shared
        return best

    def _windows(self, pairs: list[tuple[str, str]], template: int) -> Iterator[tuple[int, float, int, int]]:
        """(bigrams shared, coefficient, first and last bigram) of windows like the template, the best first, none within another.

        The best window begins and ends with bigrams of the template. Beginnings wait in order of a bound that counts
        each of these as shared, and are worked out when no other has a higher bound.
        """
        size, _, own = self.made[template]
        need, widest = ceil(size * self.ratio - 1e-9), floor(size / self.ratio + 1e-9)
        at = np.array([i for i, pair in enumerate(pairs) if pair in own], np.int64)
        until = np.searchsorted(at, at + widest)
        waiting: list[tuple[float, int, int, int, int]] = []
        for i in np.flatnonzero(until - np.arange(len(at)) >= need).tolist():
            places = at[i : until[i]]
            bound = (2 * np.minimum(np.arange(1, len(places) + 1), size) / (size + 1 + places - places[0])).max()
            if bound >= self.least:
                waiting.append((-float(bound), int(places[0]), i, -1, 0))
        heapq.heapify(waiting)
        taken: list[tuple[int, int]] = []
        while waiting:
            less, first, i, last, shared = heapq.heappop(waiting)
            if any(s <= max(first, last) and first <= e for s, e in taken):
                continue
            if last < 0:
                reached, last, shared = self._best_end(pairs, own, size, at[i : until[i]].tolist())
                if reached >= self.least:
                    heapq.heappush(waiting, (-reached, first, i, last, shared))
                continue
            taken.append((first, last))
            yield shared, -less, first, last

    def _inside(self, text: str, units: list[dict]) -> list[dict]:
        """Windows like a template that are in no unit of its licence, nor in one like another licence as much or more; where they
        overlap, the one that shares most bigrams."""
        low = lowered(text)
        pairs = list(pairwise(_WORD.findall(low)))
        met = Counter(pair for pair in pairs if pair in self.holders)
        shared: Counter[int] = Counter()
        for pair, n in met.items():
            for i in self.holders[pair]:
                shared[i] += min(n, self.made[i][2][pair])
        like = [i for i, n in shared.items() if n >= self.made[i][0] * self.ratio - 1e-9]
        if not like:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        windows = []
        for i in like:
            for n, reached, first, last in self._windows(pairs, i):
                windows.append((-n, -reached, spans[first][0], spans[last + 1][1], self.made[i][1]))
        taken: list[tuple[int, int]] = []
        found = []
        for _, less, first, last, name in sorted(windows):
            over = [u for u in units if u["first"] < last and first < u["last"]]
            told = any(u["licence"] == name or u["dice"] >= -less for u in over)
            if not told and not any(s < last and first < e for s, e in taken):
                taken.append((first, last))
                found.append({"licence": name, "dice": -less, "unit": "window", "first": first, "last": last})
        return sorted(found, key=lambda f: f["first"])

    def scan(self, text: str) -> list[dict]:
        """The best licence of each unit that reaches ``least``, then of windows that these do not tell of, both in order of place: kind,
        span in characters, coefficient."""
        found = []
        for kind, start, end, lines in self._units(text):
            lo, hi = self.candidates(sum(map(len, lines)) - 1)
            if lo == hi:
                continue
            own = bigrams([t for tokens in lines for t in tokens])
            self.compared += hi - lo
            best = max(((dice(c, own), name) for _, name, c in self.made[lo:hi]), key=lambda x: (x[0], x[1]))
            if best[0] >= self.least:
                found.append({"licence": best[1], "dice": best[0], "unit": kind, "first": start, "last": end})
        return found + self._inside(text, found)


MATCH = "array<struct<licence: string, dice: double, unit: string, first: int, last: int>>"
_MATCH = pa.list_(
    pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, matches) for every row; ``matches`` is empty where no licence is found.

    A match is a line, paragraph or text whose coefficient with a template is at least ``least``, or a window of words beside these; of
    equal coefficients of a unit the last name counts. Null and empty texts have no matches; repeated rows come back repeated.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least=least)
        for part in parts:
            found = [scanner.scan(t.as_py()) for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(found, _MATCH)], names=["doc_id", "matches"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), filled(text).alias("text"))
    return slim.mapInArrow(batches, f"doc_id long, matches {MATCH}")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its licences, and the match with the highest coefficient (the first in the text of equals)."""
    m = F.col("matches")
    order = F.array_sort(F.transform(m, lambda x: F.struct(-x["dice"], x["first"], x["last"], x["licence"])))
    best = F.get(order, F.lit(0))
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["licence"]))), ",").alias("licences"),
        best["licence"].alias("best_licence"),
        F.round(-best["col1"], 9).alias("best_dice"),
        best["first"].alias("best_first"),
        best["last"].alias("best_last"),
    )
