"""License scans by patience alignment.

Word trigrams that a text shares with a template give windows of the text. In a window, words that are unique both in
the window and in the template are anchors; the longest increasing subsequence of them is kept, and the gaps between
are aligned in the same way until no anchors are left. Coverage is the share of the template's words that are matched.
What the windows leave is searched for stretches whose longest common subsequence with the template has COVERAGE and
DENSITY, so that clauses put in between and notices that repeat lose nothing. The search is exact for templates of any
length: it holds runs of starts against the template together, and parts a run only where one of its starts may do.

Of each template, a few of its rarest words make up over 1 - COVERAGE of it: a text without any of these can't match,
and only templates of which it has one are looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table

# License texts and notices, as published.
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0 notice (long)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0 notice (long)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0 notice (long)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1 notice (long)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "AGPL-3.0 notice (long)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "MIT notice (licensed)": "Licensed under the MIT License",
    "GPL-3.0 notice": "licensed under the GNU General Public License, version 3",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice (long)": "licensed under a Creative Commons Attribution 4.0 International License",
}
# Identifiers of licenses in tags.
TAGS = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)


def tags() -> dict[str, str]:
    return {f"{name} tag": f"SPDX-License-Identifier: {name}" for name in TAGS}


def whole_texts() -> dict[str, str]:
    """The licenses of many pages, as published, from the files beside this module."""
    folder = files(__package__) / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}



WORD = re.compile(r"[^\W_]+")
COVERAGE, DENSITY = 0.8, 0.5
#: Templates of so few words begin a new pass wherever their words don't go on.
SHORT = 16
#: Starts of a template of n words are searched in runs of n / RUNS at first.
RUNS = 16


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second increases too: by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
        before[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        of_a, of_b = Counter(a[al:ah]), Counter(b[bl:bh])
        place = {w: i for i, w in enumerate(b[bl:bh], bl)}
        anchors = increasing([(i, place[a[i]]) for i in range(al, ah) if of_a[a[i]] == 1 and of_b.get(a[i]) == 1])
        if not anchors:
            continue
        out += anchors
        edges = [(al - 1, bl - 1), *anchors, (ah, bh)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_rows(a: list[str], b: list[str]) -> list[int]:
    """For each word of b: numbers whose bit i is 0 where the longest common subsequence so far needs a[i]."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        at[w] |= 1 << i
    mask = v = (1 << len(a)) - 1
    out = []
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & mask
        out.append(v)
    return out


def common_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    rows = common_rows(a, b)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append((i, j))
    return out[::-1]


def passes(n: int, matched: int, span: int) -> bool:
    return matched / n >= COVERAGE and matched / span >= DENSITY


def places(ws: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(ws):
        out[w].append(i)
    return out


class Templates:
    def __init__(self, texts: dict[str, str], whole: frozenset[str] = frozenset()):
        """whole: names of templates of which each word must be there."""
        self.names = list(texts)
        self.words = [[w for w, _, _ in words(t)] for t in texts.values()]
        self.counts = [Counter(ws) for ws in self.words]
        self.kinds = [set(of) for of in self.counts]
        #: How many words a match has at least.
        self.least = [len(ws) if name in whole else math.ceil(COVERAGE * len(ws) - 1e-9) for name, ws in zip(self.names, self.words, strict=True)]
        #: The words that a match of COVERAGE can begin with, and the bits of each word's places.
        self.heads = [set(ws[: len(ws) - least + 1]) for ws, least in zip(self.words, self.least, strict=True)]
        self.bits = [{w: sum(1 << i for i in at) for w, at in places(ws).items()} for ws in self.words]
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            own = Counter(zip(ws, ws[1:], ws[2:], strict=False))
            for i in range(len(ws) - 2):
                if own[tuple(ws[i : i + 3])] == 1:  # others would seem to begin a new pass
                    self.grams[tuple(ws[i : i + 3])].append((k, i))
        #: Templates by the words of which a match has one: the rarest among the templates, and long ones, first.
        spread = Counter(w for of in self.kinds for w in of)
        self.telling: dict[str, list[int]] = defaultdict(list)
        for k, of in enumerate(self.counts):
            mass, n = 0, len(self.words[k])
            for w in sorted(of, key=lambda w: (spread[w], -len(w), w)):
                self.telling[w].append(k)
                mass += of[w]
                if n - mass < self.least[k]:
                    break
        self.signs = frozenset(self.telling)

    def windows(self, ws: list[str], only: int | None = None) -> dict[int, list[tuple[int, int]]]:
        """For each template (or one), where in the text its trigrams lie close together and in order of one pass."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in range(len(ws) - 2):
            for k, at in self.grams.get((ws[i], ws[i + 1], ws[i + 2]), ()):
                if only is None or k == only:
                    hits[k].append((i, at))
        out: dict[int, list[tuple[int, int]]] = {}
        for k, found in hits.items():
            n = len(self.words[k])
            gap, spans = max(8, n // 4), []
            low = high = found[0]
            for i, at in found[1:]:
                if i - high[0] > gap or (i > high[0] and (at < high[1] - n // 2 or (n <= SHORT and at <= high[1]))):  # far off, or a new pass
                    spans.append((low, high))
                    low = (i, at)
                high = (i, at)
            spans.append((low, high))
            out[k] = [(max(0, lo[0] - lo[1] - 2), min(len(ws), hi[0] + n - hi[1] + 2)) for lo, hi in spans]
        return out

    def fits(self, k: int, matched: int, span: int) -> bool:
        return matched >= self.least[k] and matched / span >= DENSITY

    def lacks(self, k: int, present: set[str]) -> bool:
        """Whether a text with these words can't have COVERAGE of the template."""
        n, kinds = len(self.words[k]), self.kinds[k]
        if n - len(kinds) + len(kinds & present) < self.least[k]:
            return True
        return n - sum(c for w, c in self.counts[k].items() if w not in present) < self.least[k]

    def starts(self, k: int, ws: list[str], lo: int, hi: int, run: int) -> list[tuple[int, int]]:
        """Runs (first, last) of `run` words at most, which begin with a word of the template, hold one that a match can
        begin with, and from which on there are enough of the template's words within reach of a match."""
        of, heads, least = self.counts[k], self.heads[k], self.least[k]
        reach = int(len(self.words[k]) / DENSITY) + run
        at = [i for i in range(lo, hi) if ws[i] in of]
        seen: dict[str, int] = defaultdict(int)
        enough, end, x, out = 0, 0, 0, []
        while x < len(at):
            s, y = at[x], x
            while end < len(at) and at[end] < s + reach:  # enough: words of the template from s on, as often as it has them
                w = ws[at[end]]
                seen[w] += 1
                enough += seen[w] <= of[w]
                end += 1
            while y < len(at) and at[y] < s + run:
                y += 1
            if enough >= least and any(ws[i] in heads for i in at[x:y]):
                out.append((s, at[y - 1]))
            for i in at[x:y]:
                w = ws[i]
                enough -= seen[w] <= of[w]
                seen[w] -= 1
            x = y
        return out

    def tightest(self, k: int, ws: list[str], first: int, last: int, hi: int) -> tuple[float, int, int] | None:
        """Of the stretches of ws[:hi] that begin from first to last the one with the best score, (score, begin, end): the
        fewest words for the most matched.

        What is matched from a start is matched from an earlier one too, so one pass over the text from first on rules
        the whole run out, or tells where the end of its best stretch lies.
        """
        bits, n, least = self.bits[k], len(self.words[k]), self.least[k]
        stop = min(hi, last + int(n / DENSITY) + 1)
        v = mask = (1 << n) - 1
        matched, best = 0, None
        for e in range(first, stop):
            if (b := bits.get(ws[e])) is None:
                continue
            u = v & b
            v = ((v + u) | (v - u)) & mask
            m = n - v.bit_count()
            if m > matched:
                matched = m
                if m >= least and m / max(1, e - last + 1) >= DENSITY and (best is None or DENSITY / 2 * e - m < best[0]):
                    best = (DENSITY / 2 * e - m, e, m)
        if best is None:
            return None
        _, end, m = best
        if first == last:
            return DENSITY / 2 * (end - first + 1) - m, first, end
        # The part of this alignment with the best score, if it will do; otherwise the run is parted.
        pairs = common_pairs(self.words[k], ws[first : end + 1])
        score, begin, low, at = 0.0, 0, None, (0, 0)
        for j, (_, t) in enumerate(pairs):
            here = j - DENSITY / 2 * t
            if low is None or here < low:
                low, begin = here, j
            if (gain := here + 1 - DENSITY / 2 - low) > score:
                score, at = gain, (begin, j)
        i, j = at
        span = pairs[j][1] - pairs[i][1] + 1
        if self.fits(k, j - i + 1, span):
            return DENSITY / 2 * span - (j - i + 1), first + pairs[i][1], first + pairs[j][1]
        middle = (first + last) // 2
        halves = [self.tightest(k, ws, first, middle, hi), self.tightest(k, ws, middle + 1, last, hi)]
        return min((x for x in halves if x), default=None)

    def stretches(self, k: int, ws: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """Stretches of ws[lo:hi], apart from each other, that match the template, the tightest first; what these leave
        is searched again until nothing is found."""
        found = [self.tightest(k, ws, first, last, hi) for first, last in self.starts(k, ws, lo, hi, max(1, len(self.words[k]) // RUNS))]
        out: list[tuple[int, int]] = []
        for _, s, e in sorted(x for x in found if x):
            if all(e < x or s > y for x, y in out):
                out.append((s, e))
        at = lo
        for s, e in sorted(out):
            out += self.stretches(k, ws, at, s)
            at = e + 1
        return out + (self.stretches(k, ws, at, hi) if out else [])

    def tight(self, k: int, ws: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(words matched, first, last) of windows in which the template aligns without a foreign word, or, if it is
        long, nearly so."""
        a, found, out = self.words[k], [], []
        spare = len(a) // (RUNS * RUNS)
        for lo, hi in spans:
            pairs = align(a, ws[lo:hi])
            # Without a foreign word in it an alignment stands; looser ones may reach into another copy, and are searched for.
            span = pairs[-1][1] - pairs[0][1] + 1 if pairs else 0
            if pairs and self.fits(k, len(pairs), span) and (span == len(pairs) or span - len(pairs) + len(a) - len(pairs) <= spare):
                found.append((-len(pairs), lo + pairs[0][1], lo + pairs[-1][1]))
        for m, first, last in sorted(found):
            if all(last < x or first > y for _, x, y in out):
                out.append((-m, first, last))
        return out

    def matches(self, k: int, ws: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(words matched, first, last) of the passes of a template: in windows, and in what these leave."""
        a, out = self.words[k], self.tight(k, ws, spans)
        for lo, hi in gaps(out, len(ws)):
            for s, e in self.stretches(k, ws, lo, hi):
                pairs = align(a, ws[s : e + 1])
                if not pairs or not self.fits(k, len(pairs), pairs[-1][1] - pairs[0][1] + 1):
                    pairs = common_pairs(a, ws[s : e + 1])
                out.append((len(pairs), s + pairs[0][1], s + pairs[-1][1]))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end), code points, by start; of overlapping ones the one with the most words.

        Longer templates are searched first: what a match has whose words are more than a shorter template's need not be
        searched for that one.
        """
        signs = self.signs.intersection(WORD.findall(text.lower()))
        if not signs:
            return []
        tokens = words(text)
        ws = [w for w, _, _ in tokens]
        present = set(ws)
        able = [k for k in sorted({k for w in signs & present for k in self.telling[w]}) if not self.lacks(k, present)]
        windows = self.windows(ws) if able else {}
        found: list[tuple[int, float, int, int, int]] = []
        for k in sorted(able, key=lambda k: (-len(self.words[k]), k)):
            n = len(self.words[k])
            rest = gaps([(0, first, last) for _, _, _, first, last in apart([x for x in found if -x[0] > n])], len(ws))
            for lo, hi in rest:
                part, spans = (ws, windows.get(k, [])) if hi - lo == len(ws) else (ws[lo:hi], self.windows(ws[lo:hi], k).get(k, []))
                found += [(-m, -m / n, k, lo + first, lo + last) for m, first, last in self.matches(k, part, spans)]
        return sorted(((self.names[k], -coverage, tokens[first][1], tokens[last][2]) for _, coverage, k, first, last in apart(found)), key=lambda x: x[2])


def apart(found: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
    """Of overlapping matches (-words, -coverage, template, first, last) the first in this order."""
    out: list[tuple[int, float, int, int, int]] = []
    for x in sorted(found):
        if all(x[4] < y[3] or x[3] > y[4] for y in out):
            out.append(x)
    return out


def gaps(found: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """What n words have beside the stretches found."""
    at, out = 0, []
    for _, first, last in sorted(found, key=lambda x: x[1]):
        out.append((at, first))
        at = last + 1
    return [(lo, hi) for lo, hi in [*out, (at, n)] if lo < hi]


_HELD: dict[int, Templates] = {}


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and licenses, an array of (license, coverage, start, end) in order of the text.

    templates: texts by name, by default TEMPLATES, tags() (whose words must all be there) and whole_texts(); those
    without any word never match. Null and
    empty texts have no licenses. Whole texts are scanned, of whatever length; a text that repeats a notice has it
    several times; of overlapping ones the one with the most matched words counts, then the first template. An input
    column named licenses, in any case, is replaced. Repeated rows are scanned like others; no rows: no rows.
    """
    texts = {k: t for k, t in (templates or TEMPLATES | tags() | whole_texts()).items() if WORD.search(t)}
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def run(column: pa.Array) -> list:
        key = hash(tuple(texts.items()))
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Templates(texts, frozenset() if templates else frozenset(tags()))
        scan = _HELD[key].scan
        return [[[{"license": n, "coverage": c, "start": s, "end": e} for n, c, s, e in scan(t.as_py() or "")] for t in column]]

    return arrow_map(docs, docs.columns if keep is None else keep, [text_col], [T.StructField("licenses", kind)], run)


def query(spark, sf_dir: str) -> DataFrame:
    made = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.concat_ws(",", F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])))
    return made.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))).alias("names"), F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("best_coverage"), spans.alias("spans"))
