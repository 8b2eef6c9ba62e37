"""Licence scan by Dice coefficient over word bigrams (operator 6).

A unit is a line, a paragraph (lines without a blank one between) of several lines, or the whole text if it has several
paragraphs. Units and templates are lower-cased words of letters and digits. Their Dice coefficient is twice the common
distinct bigrams over the sum of both numbers. It can only reach the threshold t if the smaller has at least t / (2 - t)
of the larger's bigrams, and if the unit has that share of the template's: these bounds prune templates and units.

A notice that is none of these, as it has several paragraphs in a longer text or prose on its own lines, is a window: a
run of words of the whole text, over line ends, of at most (2 - t) / t of a template's length. The most alike window
begins and ends with a bigram of the template, so only those are compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .hashing import LETTERS, steps, words

THRESHOLD = 0.8
# Public licence notices.
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-grant": "Released under the MIT License.",
    "MIT-grant-2": "This project is licensed under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-grant": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-grant": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-grant": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "LGPL-2.1": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "WTFPL": 'Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.',
    "BSD-grant": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-grant": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-grant": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-grant": "Licensed under CC BY-NC 4.0.",
    "CC0-grant": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "proprietary": "All rights reserved.",
}


def bigrams(unit: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(unit, unit[1:], strict=False))


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.least = threshold / (2 - threshold)
        self.threshold = threshold
        self.sets = {k: bigrams(words([t], LETTERS).bytes_of(0)) for k, t in sorted(templates.items())}
        self.sets = {k: s for k, s in self.sets.items() if s}
        hashes = [words([t], LETTERS).ngrams(2)[0] for t in templates.values()]
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.least_hits = min((int(np.ceil(self.least * len(s) - 1e-9)) for s in self.sets.values()), default=1)
        self.member, self.longest = {}, {}
        for name in self.sets:
            own = words([templates[name]], LETTERS).ngrams(2)[0]
            self.member[name] = np.isin(self.hashes, own)
            self.longest[name] = int(len(own) / self.least + 1e-9)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which bigrams any template has."""
        out = self.seen[(h >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), max(0, len(self.hashes) - 1))
        out[maybe] = self.hashes[at] == h[maybe] if len(self.hashes) else False
        return out

    def need(self, name: str) -> int:
        """The common bigrams that a unit like the template has at least."""
        return max(1, int(np.ceil(self.least * len(self.sets[name]) - 1e-9)))

    def places(self, h: np.ndarray, known: np.ndarray, first: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
        """Of each text, by template, where a window like it may begin: enough of its bigrams follow in a window's length."""
        at = np.flatnonzero(known)
        of, text = np.searchsorted(self.hashes, h[at]), np.searchsorted(first, at, side="right") - 1
        out: dict[int, dict[str, np.ndarray]] = {}
        for name in self.sets:
            here = self.member[name][of] if len(at) else np.zeros(0, bool)
            p, d, last = at[here], text[here], self.need(name) - 1
            if len(p) <= last:
                continue
            n = len(p) - last
            ok = (p[last:] - p[:n] < self.longest[name]) & (d[last:] == d[:n])
            begins, own = p[:n][ok], d[:n][ok]
            for t in np.unique(own).tolist():
                out.setdefault(t, {})[name] = begins[own == t] - first[t]
        return out

    def windows(self, h: np.ndarray, begins: dict[str, np.ndarray]) -> list[tuple[int, int, str]]:
        """First word, one past the last, and template of the windows of a text with these bigrams.

        Of windows of one template that overlap the most alike is taken, and the words around it are compared anew. Where
        windows of several templates share over half of the words of one, the one with the most common bigrams stays.
        """
        order = np.argsort(h, kind="stable")
        same, before = h[order][1:] == h[order][:-1], np.full(len(h), -1)
        before[order[1:][same]] = order[:-1][same]
        found = []
        for name, starts in begins.items():
            n, reach = len(self.sets[name]), self.longest[name]
            hit = np.isin(h, self.hashes[self.member[name]])
            taken = np.zeros(len(h) + 1, bool)

            def alike(s: int, end: int, n=n, hit=hit, name=name) -> tuple[float, int, int, int] | None:
                """Minus the coefficient, first and last bigram, and common bigrams of the most alike window from ``s`` to before ``end``."""
                fresh = before[s:end] < s
                common = np.cumsum(fresh & hit[s:end])
                dice = 2 * common / (np.cumsum(fresh) + n)
                e = int(np.argmax(dice)) if len(dice) else -1
                return (-float(dice[e]), s, s + e, int(common[e])) if e >= 0 and dice[e] >= self.threshold - 1e-9 else None

            queue = [w for s in starts.tolist() if (w := alike(s, min(len(h), s + reach)))]
            heapq.heapify(queue)
            while queue:
                dice, s, e, common = heapq.heappop(queue)
                clash = np.flatnonzero(taken[s : e + 2])
                if not len(clash):
                    taken[s : e + 2] = True
                    found.append((-common, dice, name, s, e + 2))
                elif clash[0] and (w := alike(s, s + int(clash[0]) - 1)):
                    heapq.heappush(queue, w)
        covered, out = np.zeros(len(h) + 1, bool), []
        for _, _, name, x, y in sorted(found):
            if 2 * covered[x:y].sum() <= y - x:
                covered[x:y] = True
                out.append((x, y, name))
        return sorted(out)

    def dice(self, unit: list[bytes], name: str) -> float:
        a, b = bigrams(unit), self.sets[name]
        return 2 * len(a & b) / (len(a) + len(b))

    def best(self, unit: list[bytes]) -> tuple[str, float] | None:
        """The template of highest Dice coefficient, by name among equals, if that reaches the threshold."""
        a, found = bigrams(unit), None
        for name, b in self.sets.items():
            if min(len(a), len(b)) < self.least * max(len(a), len(b)) - 1e-9:
                continue
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = (name, dice)
        return found


def _units(line: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Kind, first word and one past the last of each unit of a text with words on these lines."""
    n = len(line)
    for kind, cut in (("line", np.flatnonzero(np.diff(line) > 0) + 1), ("paragraph", np.flatnonzero(np.diff(line) > 1) + 1), ("text", np.zeros(0, int))):
        edges = [0, *cut.tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if kind == "line" or (kind == "paragraph" and line[a] != line[b - 1]) or (kind == "text" and (np.diff(line) > 1).any()):
                yield kind, a, b


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, unit, first_line, license, dice``: a row for each unit of each row's whole text that is like a template.

    A window is left out if a line, paragraph or the text is on most of the same words with the same license. ``first_line`` counts from 0. Null and empty texts have no units; repeated rows give their rows again. Units of one
    word have no bigrams and are like nothing. ``templates`` (name to text) is a small table by its nature, sent to all tasks.
    """
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(chosen, threshold)
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo, hi in steps(texts):
                w = words(texts[lo:hi], LETTERS)
                h, first = w.ngrams(2)
                known = t.known(h)
                hits, places = np.r_[0, np.cumsum(known)], t.places(h, known, first)
                ends = np.flatnonzero(np.frombuffer(w.text, np.uint8) == 10)
                for d in np.flatnonzero(hits[first[1:]] - hits[first[:-1]] >= t.least_hits).tolist():
                    line = np.searchsorted(ends, w.begin[w.starts[d] : w.starts[d + 1]]) - np.searchsorted(ends, w.offset[d])
                    own, mine, got = hits[first[d] : first[d + 1] + 1], w.bytes_of(d), []
                    for kind, x, y in _units(line):
                        if y - x >= 2 and own[y - 1] - own[x] >= t.least_hits and (best := t.best(mine[x:y])):
                            rows.append((ids[lo + d], kind, int(line[x]), *best))
                            got.append((x, y, best[0]))
                    for x, y, name in t.windows(h[first[d] : first[d + 1]], places[d]) if d in places else ():
                        if any(name == k and 5 * (min(y, b) - max(x, a)) > 3 * (max(y, b) - min(x, a)) for a, b, k in got):
                            continue
                        if (dice := t.dice(mine[x:y], name)) >= threshold:
                            rows.append((ids[lo + d], "window", int(line[x]), name, dice))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.float64())], ["doc_id", "unit", "first_line", "license", "dice"])

    return base.documents(docs).mapInArrow(run, "doc_id long, unit string, first_line long, license string, dice double")
