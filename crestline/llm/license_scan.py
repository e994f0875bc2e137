"""Licence scan with a generalised suffix automaton of licence tokens.

The templates below are turned into one suffix automaton over word tokens.  Each text
streams through it once, which yields matching statistics: at every word, the longest
suffix read so far that occurs in some template.  Maximal matches of at least
``MIN_MATCH`` words are chained in template order into spans; a template whose covered
share reaches ``MIN_COVER`` gives its label.  The short base phrases are read off the same
automaton.  One pass, no shuffle; the automaton depends on the templates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_MATCH = 4
MIN_COVER = 0.6
MAX_GAP = 12

#: Base phrases and their labels.  Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence notices and their labels.  Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Bytes to word bytes: A-Z lower-cased, other ASCII but digits and letters to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of digits, letters a-z and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class LicenceAutomaton:
    """Generalised suffix automaton of token sequences, with their places.

    ``step`` follows one token; ``places[state]`` lists ``(template, end)`` pairs at which
    the state's strings end.
    """

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        texts = [words_of(t) for _, t in templates] + [words_of(p) for p, _ in phrases]
        self.sizes = [len(t) for t in texts]
        self.first_phrase = len(templates)
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [[]]
        for n, text in enumerate(texts):
            last = 0
            for end, token in enumerate(map(self.vocabulary.__getitem__, text)):
                last = self._extend(last, token, ends)
                ends[last].append((n, end))
        self.places = [sorted(set(e)) for e in ends]
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            parent = self.link[state]
            if parent > 0:
                self.places[parent] = sorted({*self.places[parent], *self.places[state]})
        # A phrase belongs to the one state among whose strings it is.
        self.phrase_at: list[list[tuple[int, str]]] = [[]]
        for state in range(1, len(self.length)):
            at, shorter = set(self.places[state]), self.length[self.link[state]]
            own = [n for n in range(len(templates), len(texts)) if shorter < self.sizes[n] <= self.length[state] and (n, self.sizes[n] - 1) in at]
            self.phrase_at.append([(self.sizes[n], self.labels[n]) for n in own])
        # A state deeper than a phrase still ends with it: inherit down the suffix links.
        for state in sorted(range(1, len(self.length)), key=lambda s: self.length[s]):
            up = self.phrase_at[self.link[state]] if self.link[state] > 0 else []
            self.phrase_at[state] = sorted({*self.phrase_at[state], *up})

    def _extend(self, last: int, token: int, ends: list) -> int:
        def state(length: int, link: int, edges: dict[int, int]) -> int:
            self.length.append(length)
            self.link.append(link)
            self.next.append(edges)
            ends.append([])
            return len(self.length) - 1

        def split(p: int, q: int) -> int:
            clone = state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = clone
            while p != -1 and self.next[p].get(token) == q:
                self.next[p][token] = clone
                p = self.link[p]
            return clone

        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[last] + 1 == self.length[q] else split(last, q)
        new, p = state(self.length[last] + 1, 0, {}), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else split(p, q)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Base phrases as ``(start, label)`` and maximal matches as ``(start, end, state)``."""
        bases, long = [], []
        nxt, link, length, phrase_at = self.next, self.link, self.length, self.phrase_at
        state = run = 0
        for i, token in enumerate(map(self.vocabulary.get, words)):
            if token is None:
                if run >= MIN_MATCH:
                    long.append((i - run, i, state))
                state = run = 0
                continue
            if token not in nxt[state]:
                if run >= MIN_MATCH:
                    long.append((i - run, i, state))
                while state and token not in nxt[state]:
                    state = link[state]
                    run = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                run += 1
                if phrase_at[state]:
                    bases += [(i + 1 - size, label) for size, label in phrase_at[state] if size <= run]
        if run >= MIN_MATCH:
            long.append((len(words) - run, len(words), state))
        return bases, long

    def spans(self, long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches as ``(label, first word, last word + 1, share of the template)``."""
        chains: dict[int, list[int]] = {}
        done: list[tuple[int, list[int]]] = []
        for start, end, state in long:
            size, found = end - start, {}
            for n, last in self.places[state]:
                if n < self.first_phrase:
                    found.setdefault(n, []).append(last + 1 - size)
            for n, begins in found.items():
                chain = chains.get(n)  # [first word, end word, end in the template, covered]
                after = [b for b in begins if chain and b + size > chain[2]]
                if chain and start - chain[1] <= MAX_GAP and after:
                    fresh = min(size, after[0] + size - chain[2], end - chain[1])
                    chain[1:] = [end, after[0] + size, chain[3] + max(0, fresh)]
                else:
                    if chain:
                        done.append((n, chain))
                    chains[n] = [start, end, begins[0] + size, size]
        done += chains.items()
        covered = [(self.labels[n], c[0], c[1], c[3] / self.sizes[n]) for n, c in done]
        return sorted({c for c in covered if c[3] >= MIN_COVER}, key=lambda c: (c[1], c[2], c[0]))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        bases, long = self.matches(words)
        spans = self.spans(long) if long else []
        starts, base = [s for s, _ in bases], {label for _, label in bases}
        return {
            "n_words": len(words),
            "n_base": len(bases),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": max([1.0 if bases else 0.0, *(min(1.0, s[3]) for s in spans)]),
            "spans": [{"label": s[0], "first_word": s[1], "end_word": s[2], "share": min(1.0, s[3])} for s in spans],
        }


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Scan the whole text of each row of ``docs`` (``doc_id``, ``text``).

    A null text counts as empty: no words, no labels, score 0, null positions.  Repeated
    rows are scanned one by one; a null ``doc_id`` is kept; other columns are ignored.
    ``spans`` holds the covered template spans, by first word.
    """
    span = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("share", T.DoubleType())]
    )
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
        + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LicenceAutomaton(templates, phrases)
        for batch in batches:
            out = pd.DataFrame([automaton.scan(t) for t in batch["text"]], columns=schema.names[1:])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(scan, schema)
