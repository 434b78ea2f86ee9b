"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' words form one suffix automaton. A text is streamed through it, which gives at each word the length of
the longest template passage that ends there (its matching statistics). The state reached and those up its suffix links have
all places in all templates where that passage, or a shorter end of it, ends. Passages of LEAST_MATCH words or more that cannot
be extended at a place are chained with others of their template: a chain goes forward in the text and in the template, with gaps
of at most MOST_GAP words. A template's coverage is the share of its words that its best chain covers; it gives its label from
LEAST_COVER on, or from LEAST_WORDS words on, unless its span lies within that of another label that covers as many words and as large
a share, and more of either: licences share sentences.

Beside that, fixed phrases are counted; where one stands, its label is given.

Words are runs of digits, letters a-z (A-Z lower-cased) and bytes over 127. Only runs of words that all occur in templates are streamed,
since no passage has another word; that changes no result.

Defined results: a null text counts as the empty one, which has no words, no labels and score 0; an empty table gives an empty
result; ties between chains go to the earlier one, and chains that cover as much in words and share all give their labels; repeated rows get equal results;
whole texts are read; columns beside the text may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.llm.common import strings

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST_MATCH = 5
MOST_GAP = 8
LEAST_COVER = 0.6
LEAST_WORDS = 25
#: Score of a document that has a phrase, whatever its coverage.
PHRASE_SCORE = 0.5

#: Phrases and their labels, as the task states them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licence notices by label. The licences' own published wording.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
        "copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
        "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser "
        "General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero "
        "General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ],
    "cc0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain "
        "Dedication along with this software.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work "
        "worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class SuffixAutomaton:
    """Of several token sequences: each state is a set of passages that end at the same places."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.moves: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: Sequence and place after it of the prefixes that are a state's own.
        own: dict[int, list[tuple[int, int]]] = {}
        for k, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens, 1):
                last = self._extend(last, token)
                own.setdefault(last, []).append((k, place))
        #: By state, all places where its passages end: its own and those of the states that link to it.
        self.places: list[list[tuple[int, int]]] = [sorted(own.get(state, [])) for state in range(len(self.moves))]
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.places = [sorted(x) for x in self.places]

    def endings(self, state: int, length: int, least: int) -> Iterator[tuple[int, int, int]]:
        """Sequence, place after it and length of the longest end, of ``least`` or more, of a passage that ends there."""
        known: set[tuple[int, int]] = set()
        while state > 0 and length >= least:
            for place in self.places[state]:
                if place not in known:
                    known.add(place)
                    yield *place, length
            state = self.link[state]
            length = self.length[state]

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.moves) - 1

    def _clone(self, p: int, q: int, token: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        while p >= 0 and self.moves[p].get(token) == q:
            self.moves[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.moves[last].get(token)
        if q is not None:
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, q, token)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.moves[p]:
            self.moves[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][token]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, q, token)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each token the state and length of the longest passage that ends with it."""
        state = length = 0
        out = []
        for t in tokens:
            while state and t not in self.moves[state]:
                state = self.link[state]
                length = self.length[state]
            nxt = self.moves[state].get(t)
            if nxt is None:
                state = length = 0
            else:
                state, length = nxt, length + 1
            out.append((state, length))
        return out


@dataclass
class Found:
    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    score: float = 0.0
    #: Label, first and last word (exclusive) and coverage of the best chain of each template that gave its label.
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]] | None = None) -> None:
        pairs = [(label, words_of(t)) for label, texts in (templates or TEMPLATES).items() for t in texts]
        self.labels = [label for label, _ in pairs]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in pairs]
        self.sizes = [len(s) for s in self.sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        #: A passage as long as the shortest template counts, whatever LEAST_MATCH is.
        self.least = min([LEAST_MATCH, *self.sizes])
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in PHRASES.items():
            words = phrase.encode().split()
            self.phrases.setdefault(words[0], []).append((words, label))

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Passages that cannot be extended where they stand: template, end in the template, end in the text (exclusive), length."""
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in words], dtype=np.int32, count=len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        cuts = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        out = []
        for a, b in cuts[cuts[:, 1] - cuts[:, 0] >= self.least].tolist():
            run = ids[a:b].tolist()
            for k, (state, length) in enumerate(self.automaton.statistics(run)):
                if length >= self.least:
                    after = run[k + 1] if k + 1 < len(run) else -1
                    for t, end, n in self.automaton.endings(state, length, self.least):
                        tokens = self.sequences[t]
                        if end == len(tokens) or tokens[end] != after:
                            out.append((t, end, a + k + 1, n))
        return out

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """For each template its best chain: template, first and last word of the text (exclusive), words covered."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, end, at, n in found:
            by.setdefault(t, []).append((at, end, n))
        out = []
        for t, items in sorted(by.items()):
            items.sort()
            best = (0, 0, 0)
            held: list[tuple[int, int, int, int]] = []  # end in text, end in template, start in text, covered
            for at, end, n in items:
                start, covered = at - n, n
                held = [h for h in held if at - n - h[0] <= MOST_GAP]
                for h_at, h_end, h_start, h_covered in held:
                    gained = n - max(0, h_at - (at - n), h_end - (end - n))
                    if gained > 0 and end > h_end and end - n - h_end <= MOST_GAP and h_covered + gained > covered:
                        start, covered = h_start, h_covered + gained
                held.append((at, end, start, covered))
                if covered > best[0]:
                    best = (covered, start, at)
            out.append((t, best[1], best[2], best[0]))
        return out

    def scan(self, text: str | None) -> Found:
        words = words_of(text)
        out = Found(n_words=len(words))
        places, labels = [], set()
        for head, phrases in self.phrases.items():
            at = -1
            while True:
                try:
                    at = words.index(head, at + 1)
                except ValueError:
                    break
                for phrase, label in phrases:
                    if words[at : at + len(phrase)] == phrase:
                        places.append(at)
                        labels.add(label)
        out.base_labels = sorted(labels)
        if places:
            out.n_base, out.first_word, out.last_word, out.score = len(places), min(places), max(places), PHRASE_SCORE
        chains = [(self.labels[t], a, b, covered / self.sizes[t], covered) for t, a, b, covered in self.chains(self.matches(words)) if covered >= min(LEAST_WORDS, LEAST_COVER * self.sizes[t])]
        for label, a, b, cover, n in chains:
            if not any(x != label and c <= a and b <= d and share >= cover and more >= n and (share, more) != (cover, n) for x, c, d, share, more in chains):
                labels.add(label)
                out.score = max(out.score, min(1.0, cover))
                out.spans.append((label, a, b, cover))
        out.labels = sorted(labels)
        return out


@lru_cache(maxsize=1)
def default_scanner() -> LicenceScanner:
    return LicenceScanner()


def scanned(text: Column, templates: dict[str, list[str]] | None = None) -> Column:
    """A struct for a text column: words, phrases found, labels, score and the templates' spans."""
    kinds = [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
    ]

    @F.arrow_udf("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
    def run(column: pa.Array) -> pa.Array:
        scanner = LicenceScanner(templates) if templates else default_scanner()
        rows = []
        for t in strings(column):
            f = scanner.scan(t)
            spans = ",".join(f"{label}:{a}:{b}:{cover:.3f}" for label, a, b, cover in f.spans)
            rows.append((f.n_words, f.n_base, f.first_word, f.last_word, ",".join(f.base_labels), ",".join(f.labels), round(f.score, 9), spans))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    return run(text)
