"""License scans by patience alignment.

Words that are unique both in a stretch of text and in a template are anchors; the longest run of anchors that ascends in both is kept, and the gaps between
them are aligned in the same way, down to gaps without anchors, where equal words at either end are matched. The share of template words that are matched is the
coverage.

A notice names a license by the words it needs and by phrases that must not stand inside it: licenses that share most of their words are told apart by those,
not by the coverage.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Public license notices, by name. Words in ``NEEDED`` must be among the matched ones, phrases in ``FOREIGN`` must not stand between them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ],
    "LGPL-2.0": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "EPL-2.0": ["""This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0"""],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ],
    "BSD-3-Clause": [
        "Released under the BSD License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    ],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies."""],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0."],
}
#: The words without which a notice names another license; of these, those in the template count.
NEEDED = {
    "Apache-2.0": "apache 2.0", "MIT": "noninfringement", "GPL-3.0": "general public 3", "GPL-2.0": "general public 2", "LGPL-3.0": "lesser 3",
    "LGPL-2.1": "lesser 2.1", "LGPL-2.0": "library general 2", "AGPL-3.0": "affero 3", "MPL-2.0": "mozilla", "EPL-2.0": "eclipse 2.0",
    "BSD-2-Clause": "redistributions binary reproduce", "BSD-3-Clause": "endorse promote neither", "ISC": "", "Unlicense": "unencumbered",
    "CC-BY-4.0": "4.0 by attribution", "CC-BY-SA-4.0": "4.0 sa sharealike", "CC-BY-NC-4.0": "4.0 nc noncommercial", "CC-BY-ND-4.0": "4.0 nd noderivatives",
    "CC-BY-NC-SA-4.0": "4.0 nc noncommercial sa sharealike", "CC-BY-NC-ND-4.0": "4.0 nc noncommercial nd noderivatives", "CC0-1.0": "cc0 1.0",
}
#: Phrases that make a notice one of another license where they stand inside it.
FOREIGN = {
    "GPL-3.0": ["lesser general", "affero general", "library general"], "GPL-2.0": ["lesser general", "affero general", "library general"],
    "LGPL-3.0": ["affero general"], "AGPL-3.0": ["lesser general"], "BSD-2-Clause": ["neither the name"],
    "CC-BY-4.0": ["nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"],
    "CC-BY-SA-4.0": ["nc", "nd", "noncommercial", "noderivatives", "noderivs"], "CC-BY-NC-4.0": ["nd", "sa", "noderivatives", "noderivs", "sharealike"],
    "CC-BY-ND-4.0": ["nc", "sa", "noncommercial", "sharealike"],
}
#: Words that deny a short notice when they stand up to three words before it in its own clause, unless "only" follows.
DENIAL = frozenset(["not", "never", "nor", "neither", "cannot", "nicht"])
SHORT = 12
_CLAUSE = re.compile(r"[.,;:!?]\s")
_CONTRACTED = frozenset(["isn", "aren", "wasn", "weren", "hasn", "doesn", "don", "can", "won"])


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (sorted by the first) whose second ascends: patience sorting with back links."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), ascending in both."""
    matched: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        one, two = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + i for i, w in enumerate(template[c:d]) if two[w] == 1}
        anchors = _ascending([(a + i, place[w]) for i, w in enumerate(text[a:b]) if one[w] == 1 and w in place])
        if not anchors:
            continue
        matched += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return _pulled(sorted(matched), text, template)


def _pulled(pairs: list[tuple[int, int]], text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Words that were matched far off, where the same word also follows (or precedes) its neighbour as in the template, moved there."""
    for order in (range(len(pairs) // 2 + 1, len(pairs)), range(len(pairs) // 2 - 1, -1, -1)):
        for k in order:
            i, j = pairs[k - order.step]
            near = i + pairs[k][1] - j
            if abs(near - i) < abs(pairs[k][0] - i) and text[near] == template[pairs[k][1]]:
                pairs[k] = near, pairs[k][1]
    return pairs


@dataclass(frozen=True)
class Notice:
    name: str
    words: list[str]
    needed: frozenset[str]
    foreign: tuple[str, ...] = ()

    @staticmethod
    def all() -> list[Notice]:
        """Every template; without words of its own in ``NEEDED``, a short notice needs its license's name."""
        out = []
        for name, texts in TEMPLATES.items():
            for t in texts:
                words = words_of(t)
                own = [w for w in NEEDED[name].split() if w in words] or ([name.split("-")[0].lower()] if len(words) < SHORT else [])
                out.append(Notice(name, words, frozenset(own), tuple(f" {p} " for p in FOREIGN.get(name, ()))))
        return out

    def names(self, words: list[str], a: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the matched ``pairs``, counted from word ``a`` of the text, cover this notice and name its license, not a kin of it."""
        if len(pairs) < COVERAGE * len(self.words) or not self.needed <= {self.words[j] for _, j in pairs}:
            return False
        if not self.foreign:
            return True
        inside = f" {' '.join(words[a + pairs[0][0]:a + pairs[-1][0] + 1])} "
        return not any(p in inside for p in self.foreign)


def _stretches(at: list[tuple[int, str]], notice: Notice, width: int) -> list[tuple[int, int]]:
    """Stretches of up to ``width`` words that hold enough of the template's words, each word as often as in the template at most; overlapping ones
    are joined. ``at`` has the places of template words in the text."""
    most = Counter(notice.words)
    enough = COVERAGE * len(notice.words)
    have: Counter = Counter()
    inside: deque = deque()
    total = 0
    out: list[tuple[int, int]] = []
    for i, w in at:
        inside.append((i, w))
        have[w] += 1
        total += have[w] <= most[w]
        while i - inside[0][0] >= width:
            _, gone = inside.popleft()
            total -= have[gone] <= most[gone]
            have[gone] -= 1
        if total >= enough:
            start = inside[0][0]
            if out and start < out[-1][1]:
                out[-1] = out[-1][0], i + 1
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    def __init__(self) -> None:
        self.notices = Notice.all()
        self.vocabulary = {w for n in self.notices for w in n.words}

    def __call__(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, license, coverage) of the notices in a text, in code points; of those that overlap, the one with the most matched words."""
        places: dict[str, list[int]] = {}
        spans = [m.span() for m in _WORD.finditer(text or "")]
        words = [text[a:b].lower() for a, b in spans]
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        found = []
        for notice in self.notices:
            if not notice.needed <= places.keys():
                continue
            if sum(min(n, len(places.get(w, ()))) for w, n in Counter(notice.words).items()) < COVERAGE * len(notice.words):
                continue
            at = sorted((i, w) for w in set(notice.words) for i in places.get(w, ()))
            for a, b in _stretches(at, notice, len(notice.words) * 3 // 2 + 2):
                while a < b:
                    pairs = align(words[a:b], notice.words)
                    if not notice.names(words, a, pairs):
                        step = self._split(words, a, b, notice)
                        if step is None:
                            break
                        a, pairs = step
                    if len(notice.words) >= SHORT or not self._denied(text, spans, words, a + pairs[0][0]):
                        found.append(self._report(spans, a, pairs, notice))
                    a += pairs[-1][0] + 1
        found.sort(key=lambda f: (-f[4], -f[3], f[0], f[2]))
        kept: list[tuple] = []
        for f in found:
            if all(f[1] <= k[0] or k[1] <= f[0] for k in kept):
                kept.append(f)
        return sorted(f[:4] for f in kept)

    @staticmethod
    def _split(words: list[str], a: int, b: int, notice: Notice):
        """The first place in a stretch that holds notices one after the other, where a window as long as the template is covered."""
        n = len(notice.words)
        if b - a <= n:
            return None
        for s in range(a, b):
            if words[s] not in notice.words:
                continue
            pairs = align(words[s:min(b, s + n + n // 4 + 1)], notice.words)
            if notice.names(words, s, pairs):
                return s, pairs
        return None

    @staticmethod
    def _denied(text: str, spans: list[tuple[int, int]], words: list[str], first: int) -> bool:
        """Whether the clause denies the notice that starts at word ``first``."""
        for k in range(first - 1, max(first - 4, -1), -1):
            if _CLAUSE.search(text, spans[k][1], spans[k + 1][0] + 1):
                return False
            if (words[k] in DENIAL or words[k] == "t" and k > 0 and words[k - 1] in _CONTRACTED) and words[k + 1] != "only":
                return True
        return False

    @staticmethod
    def _report(spans: list[tuple[int, int]], a: int, pairs: list[tuple[int, int]], notice: Notice) -> tuple[int, int, str, float, int]:
        return spans[a + pairs[0][0]][0], spans[a + pairs[-1][0]][1], notice.name, len(pairs) / len(notice.words), len(pairs)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: an array of (start, end, license, coverage) in the order of the text, code points, end exclusive.

    A notice is found where ``COVERAGE`` of a template's words align, its naming words among them and no phrase of a kindred license between them; a short one that
    its clause denies ("not licensed under ...") is none. Whole texts are read; a notice is sought in stretches of up to one and a half times its length, so
    one with longer insertions is not seen. Where notices overlap the one with more matched words stays. Null and empty texts have none, repeated rows are scanned each, an empty table gives an empty result; a column ``licenses`` is
    replaced. Nothing is shuffled.
    """
    scanner: list[Scanner] = []

    @F.pandas_udf("array<struct<start: int, end: int, license: string, coverage: double>>")
    def found(texts: pd.Series) -> pd.Series:
        if not scanner:
            scanner.append(Scanner())
        return pd.Series([[dict(zip(("start", "end", "license", "coverage"), f)) for f in scanner[0](t)] for t in texts])

    return docs.withColumn("licenses", found(F.col(text)))
