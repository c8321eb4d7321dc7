"""License scan by patience alignment against templates.

Text and template are words.  A region of the text that holds enough of a template's words is aligned with it: words
unique to both are anchors, the longest increasing subsequence of their places keeps those in one order, and the gaps
between anchors are aligned in the same way, after equal words at their ends; a gap without anchors gets its longest
common subsequence.  Coverage is the share of the template's words that found a partner.

A document that lacks too many of a template's words to reach the least coverage is passed over for it, by the set of its
words; that test drops no match.  Regions are taken from left to right and don't overlap within a template; where templates overlap, the one with
more words matched stays.

Cases: null and empty texts have no license; a notice that repeats is found every time; texts are whole, however long.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices and license bodies, as their publishers print them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-opening": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "Unlicense-opening": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_UNLICENSE_REST = 'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org'


def _gnu(thing: str, name: str, version: str) -> str:
    """The notice that files under a GNU license carry."""
    mark, stop = (":", ",") if version == "3" else (";", ";")
    return f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


TEMPLATES |= {
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-2-Clause": f"{TEMPLATES['BSD-2-Clause-opening']} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{TEMPLATES['BSD-2-Clause-opening']} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "Unlicense": f"{TEMPLATES['Unlicense-opening']} {_UNLICENSE_REST}",
    "0BSD": TEMPLATES["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies.", "."),
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_LOWER = {c: c + 32 for c in range(65, 91)}
_RUNS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words, A-Z lower-cased, and the code points each spans."""
    found = [(m[0], m.span()) for m in _WORD.finditer(text.translate(_LOWER))]
    return [w for w, _ in found], [s for _, s in found]


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops, pile, before = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = pile[k - 1] if k else -1
        if k == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[k], pile[k] = p, i
    out, at = [], pile[-1] if pile else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both, by recursive patience alignment."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        there = {b[k]: k for k in range(j, n) if right[b[k]] == 1}
        anchors = [(k, there[a[k]]) for k in range(i, m) if left[a[k]] == 1 and a[k] in there]
        anchors = [anchors[k] for k in increasing([q for _, q in anchors])]
        if not anchors:
            out += [(i + p, j + q) for p, q in common(a[i:m], b[j:n])]
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)]):
            work.append((p + 1, r, q + 1, s))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = 0.8):
        self.least = least
        self.templates, self.parts = [], []
        for name, text in sorted(templates.items()):
            words = words_of(text)[0]
            self.templates.append((name, words, Counter(words)))
            self.parts.append([(frozenset(p.encode() for p in re.split("[.-]", w)), n) for w, n in Counter(words).items()])
        self.vocabulary = frozenset(p for parts in self.parts for own, _ in parts for p in own)

    def matches(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(template, start, end, words matched, coverage), from left to right."""
        if not text:
            return []
        own = self.vocabulary.intersection(text.encode("utf-8", "surrogatepass").translate(_RUNS).split())
        able = [t for t, parts in zip(self.templates, self.parts) if sum(n for w, n in parts if w <= own) >= self.least * len(t[1])]
        if not able:
            return []
        words, spans = words_of(text)
        found = []
        for name, template, count in able:
            places = [k for k, w in enumerate(words) if w in count]
            width, at, reach = len(template) * 3 // 2 + 5, 0, 0
            held: Counter = Counter()
            for k, p in enumerate(places):  # the window is places[at..k]
                held[words[p]] += 1
                while p - places[at] >= width:
                    held[words[places[at]]] -= 1
                    at += 1
                if p < reach or sum(min(n, held[w]) for w, n in count.items()) < self.least * len(template):
                    continue
                start = max(places[at], reach)
                pairs = align(words[start : start + width], template)
                while len(pairs) >= self.least * len(template):  # go on from the first partner until nothing is gained
                    begin = start + pairs[0][0]
                    further = align(words[begin : start + pairs[-1][0] + 1 + width], template)
                    if len(further) <= len(pairs):
                        break
                    start, pairs = begin, further
                if len(pairs) >= self.least * len(template):
                    first, last = start + pairs[0][0], start + pairs[-1][0]
                    found.append((name, spans[first][0], spans[last][1], len(pairs), len(pairs) / len(template)))
                    reach = last + 1
                    while at <= k and places[at] < reach:
                        held[words[places[at]]] -= 1
                        at += 1
        kept: list[tuple] = []  # in order of their places; they don't overlap
        for m in sorted(found, key=lambda m: (-m[3], -m[4], m[1], m[0])):
            k = bisect_left(kept, m[2], key=lambda o: o[1])
            if k == 0 or kept[k - 1][2] <= m[1]:
                kept.insert(k, m)
        return kept


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, matches) for each row."""
    kinds = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [[dict(zip(("license", "start", "end", "words", "coverage"), m)) for m in scanner.matches(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kinds)], ["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, matches array<struct<license: string, start: long, end: long, words: long, coverage: double>>")
