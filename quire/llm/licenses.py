"""Licence scan: a positional index of rare licence words.

Templates are licence texts and notices with mandatory key phrases. A word's IDF is that of the template collection, and
the index maps each template's RARE words of highest IDF to their postings (template, position).

1. Rarest first: of a template with r rare words, VOTES * r must be found, so one of the rarest (1 - VOTES) * r + 1 is
   among them. Texts without any such word, nor the rarest word of a base phrase, are done.
2. Intersection: a rare word at place p of a text and position q of a template votes for the start p - q. Starts are
   intersected: VOTES of the rare words must vote for starts that lie within the template's slack (an eighth of its length
   for long texts, none for notices of up to 16 words) of the first of them.
3. Verification: each key phrase must stand there word by word, and COVERAGE of the template's words, weighted by IDF,
   must stand at their places. Matches inside that of a longer template go, the others give their label; score is the
   best coverage, and 0.5 at least for a text with a base phrase.

Only the fixed templates are broadcast (with the function itself). Words: A-Z lower-cased, then runs of
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A null or empty text has no words, no labels, null first and last word and
score 0. Repeated rows are each answered; an empty table gives an empty result; a text of any length is taken whole, in
one task; other columns are left aside.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Texts, byte_table, slices, word_hash

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice or licence text, key phrases that must all stand in it.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache", "Licensed under the Apache License", ["apache license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("bsd", "Released under the BSD License", ["bsd license"]),
    ("gpl-3.0", "GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl-2.0", "GNU General Public License, version 2", ["general public license version 2"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA", ["cc by sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND", ["cc by nd"]),
    ("cc0", "Dedicated to the public domain under CC0", ["cc0"]),
    ("cc0", "Available under CC0", ["under cc0"]),
    ("mit", "MIT License Copyright (c)", ["mit license copyright c"]),
    ("gpl-3.0", "General Public License v3", ["general public license v3"]),
    ("gpl-2.0", "General Public License v2", ["general public license v2"]),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1", ["lesser general public license version 2 1"]),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3", ["lesser general public license version 3"]),
    ("agpl-3.0", "GNU Affero General Public License, version 3", ["affero general public license version 3"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""", ["permission is hereby granted free of charge", "the software is provided as is"]),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE
IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ["redistribution and use in source and binary forms", "retain the above copyright notice"]),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the
name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED.""", ["redistribution and use in source and binary forms", "endorse or promote products derived from this software"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS.""", ["with or without fee is hereby granted"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of
this software must not be misrepresented; you must not claim that you wrote the original software.""", ["alter it and redistribute it freely"]),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""", ["apache license version 2 0", "governing permissions and limitations"]),
    ("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ["gnu general public license as published", "either version 3 of the license"]),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ["gnu general public license as published", "either version 2 of the license"]),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ["mozilla public license v 2 0"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""", ["free and unencumbered software"]),
]
#: Identifiers of which a tag `SPDX-License-Identifier: ...` makes a notice of its own; the label is in lower case.
TAGS = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "Unlicense"]
TEMPLATES += [(tag.lower(), f"SPDX-License-Identifier: {tag}", [re.sub("[^a-z0-9]+", " ", f"spdx license identifier {tag}".lower())]) for tag in TAGS]
#: Words of a template that are indexed, the share of them that must agree on a start, and the share of its IDF that must stand there.
RARE, VOTES, COVERAGE = 12, 0.6, 0.6

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_WORD_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_IS_WORD = byte_table(_WORD_BYTES)


def _words(text: str) -> list[str]:
    t = Texts(pa.array([text]), _IS_WORD, lower=True)
    return [t.word(i).decode() for i in range(len(t.starts))]


class Template:
    def __init__(self, label: str, text: str, keys: list[str]):
        self.label, self.words, self.keys = label, _words(text), [k.split() for k in keys]
        self.slack = len(self.words) // 8 if len(self.words) > 16 else 0
        #: Positions where each key phrase stands in the template.
        self.key_at = [[q for q in range(len(self.words) - len(k) + 1) if self.words[q : q + len(k)] == k] for k in self.keys]


class Index:
    """Postings by word; `first` are the words of which a text must hold one."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [Template(*t) for t in templates]
        self.base = [(phrase.split(), label) for phrase, label in base.items()]
        df = Counter(w for t in self.templates for w in set(t.words))
        self.idf = {w: math.log((1 + len(self.templates)) / n) for w, n in df.items()}
        by_idf = lambda words: sorted(set(words), key=lambda w: (-self.idf.get(w, math.inf), -len(w), w))
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.bars: list[int] = []
        first = {by_idf(words)[0] for words, _ in self.base}
        for k, t in enumerate(self.templates):
            rare = by_idf(t.words)[:RARE]
            self.bars.append(math.ceil(VOTES * len(rare)))
            first.update(rare[: len(rare) - self.bars[-1] + 1])
            for q, w in enumerate(t.words):
                if w in rare:
                    self.postings[w].append((k, q))
        vocabulary = sorted(set(df) | {w for words, _ in self.base for w in words})
        self.hashes = np.array([word_hash(w.encode()) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(self.hashes)
        self.hashes, self.words = self.hashes[order], [vocabulary[i] for i in order]
        self.first = np.array([w in first for w in self.words])

    def licence_words(self, texts: Texts) -> tuple[np.ndarray, list[str]]:
        """Places, and words, that may belong to a template; their bytes are compared, not only hashes."""
        h = texts.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == h)
        rows = np.searchsorted(texts.ptr, places, "right") - 1
        places = places[np.isin(rows, rows[self.first[at[places]]])]  # only texts with one of the first words can match
        found = [self.words[i] for i in at[places]]
        true = [i for i, (p, w) in enumerate(zip(places, found, strict=True)) if texts.word(p) == w.encode()]
        return places[true], [found[i] for i in true]

    def _phrases(self, at: dict[int, str], places: dict[str, list[int]]) -> tuple[list[int], set[str]]:
        """Starts of all base phrases, and their labels."""
        starts, labels = [], set()
        for words, label in self.base:
            for p in places.get(words[0], []):
                if all(at.get(p + i) == w for i, w in enumerate(words)):
                    starts.append(p)
                    labels.add(label)
        return starts, labels

    def _starts(self, places: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
        """(template, first start) wherever enough rare words agree."""
        votes: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for w in sorted((w for w in places if w in self.postings), key=lambda w: (-self.idf[w], w)):
            for k, q in self.postings[w]:
                votes[k] += [(p - q, w) for p in places[w]]
        for k, found in votes.items():
            if len({w for _, w in found}) < self.bars[k]:
                continue
            found.sort()
            held: Counter = Counter()
            end = 0
            for i, (s, w) in enumerate(found):
                while end < len(found) and found[end][0] <= s + self.templates[k].slack:
                    held[found[end][1]] += 1
                    end += 1
                if len(held) >= self.bars[k] and (i == 0 or found[i - 1][0] != s):
                    yield k, s
                held[w] -= 1
                if not held[w]:
                    del held[w]

    def _coverage(self, t: Template, at: dict[int, str], places: dict[str, list[int]], s: int) -> float:
        """Share of the template's IDF that stands at its place, for starts from s to s + slack; 0 without a key phrase."""
        for key, positions in zip(t.keys, t.key_at, strict=True):
            if not any(all(at.get(start + q + i) == w for i, w in enumerate(key)) for q in positions for start in range(s, s + t.slack + 1)):
                return 0.0
        got = 0.0
        for q, w in enumerate(t.words):
            here = places.get(w, [])
            i = bisect.bisect_left(here, s + q)
            if i < len(here) and here[i] <= s + q + t.slack:
                got += self.idf[w]
        return min(1.0, got / sum(self.idf[w] for w in t.words))

    def scan(self, at: dict[int, str]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """at: the licence words of one text by place, in order. Base counts, their smallest and largest start, labels, score."""
        places: dict[str, list[int]] = defaultdict(list)
        for p, w in at.items():
            places[w].append(p)
        starts, base = self._phrases(at, places)
        matches = []
        for k, s in self._starts(places):
            t = self.templates[k]
            covered = self._coverage(t, at, places, s)
            if covered >= COVERAGE:
                matches.append((s, s + t.slack + len(t.words), len(t.words), t.label, covered))
        labels, score = set(base), 0.5 if base else 0.0
        # a longer template's match spans more, so what lies inside one shows in a sweep over spans, the longer first
        reach, span, before = -1, (-1, -1), -1
        for lo, hi, _, label, covered in sorted(matches, key=lambda m: (m[0], -m[1])):
            if (lo, hi) != span:
                span, before = (lo, hi), reach
                reach = max(reach, hi)
            if hi > before:
                labels.add(label)
                score = max(score, covered)
        return len(starts), min(starts, default=None), max(starts, default=None), base, labels, score


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row; no shuffle."""
    index = Index(templates, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            texts = Texts(batch.column("text"), _IS_WORD, lower=True)
            places, words = index.licence_words(texts)
            found: dict[int, dict[int, str]] = defaultdict(dict)
            for r, p, w in zip(np.searchsorted(texts.ptr, places, "right") - 1, places, words, strict=True):
                found[int(r)][int(p - texts.ptr[r])] = w
            none = (0, None, None, set(), set(), 0.0)
            out = [index.scan(found[r]) if r in found else none for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(texts.counts, pa.int64()),
                    *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)),
                    *(pa.array([",".join(sorted(x[i])) for x in out], pa.string()) for i in (3, 4)),
                    pa.array([float(x[5]) for x in out], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)
