"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Texts and templates are sequences of lower-case words. Hashes of three words in a row are winnowed; those of templates
are an inverted index. Where a text's fingerprints meet the index on neighbouring diagonals, the template is aligned with
the text inside a band around them, and the alignment gives the share of the template that is there and the span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 12, 0.8
#: Diagonals whose seeds share an alignment.
_STEP = 6
_WORD = re.compile(r"[^\W_]+")

# Texts of public licenses and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License",
    "BSD-notice": "Released under the BSD License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-4.0-short-notice": "Licensed under CC BY 4.0",
}


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the least hash in every `window` grams in a row, the last of those that tie."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        hashes = (hashes ^ codes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    places = np.unique(np.arange(n - width + 1) + width - 1 - views[:, ::-1].argmin(axis=1))
    return places, hashes[places]


class Templates:
    """Templates as word codes, with the inverted index of their fingerprints: hash to (template, place)."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.codes, self.kinds = sorted(texts), {}, {}
        self.index: dict[int, list[tuple[str, int]]] = {}
        self.vocabulary: dict[str, int] = {}
        for name in self.names:
            words = [w.lower() for w in _WORD.findall(texts[name])]
            self.vocabulary |= {w: xxhash.xxh3_64_intdigest(w) for w in words}
            self.codes[name] = np.array([self.vocabulary[w] for w in words], dtype=np.uint64)
            self.kinds[name] = np.unique(self.codes[name], return_counts=True)
            for at, h in zip(*winnow(self.codes[name]), strict=True):
                self.index.setdefault(int(h), []).append((name, int(at)))
        self.hashes = np.array(sorted(self.index), dtype=np.uint64)

    def scan(self, text: str | None, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first character, last character + 1) of every match in a text.

        Seeds are taken from the text's start to its end. Those beside one diagonal that no match holds yet share an alignment
        in a band of fixed width, so that the work grows with the text's length and not with how often it repeats.
        """
        words, spans = _words(text or "")
        known = self.vocabulary.get
        codes = np.fromiter((known(w, 0) for w in words), dtype=np.uint64, count=len(words))
        # Fingerprints of words that no template has are no use: only stretches of known words are winnowed.
        have = np.flatnonzero(codes)
        if len(have) < GRAM:
            return []
        hits: dict[str, list[tuple[int, int]]] = {}
        for part in np.split(have, np.flatnonzero(np.diff(have) > 1) + 1):
            if len(part) >= GRAM:
                places, hashes = winnow(codes[part[0] : part[-1] + 1], GRAM, 1)
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                for k in np.flatnonzero(self.hashes[at] == hashes):
                    for name, place in self.index[int(hashes[k])]:
                        hits.setdefault(name, []).append((int(places[k] + part[0]), place))
        found = []
        for name in sorted(hits):
            template, done, width = self.codes[name], 0, band + _STEP
            kinds, counts = self.kinds[name]
            mine = np.r_[0, np.cumsum(np.isin(codes, kinds))]
            failed: set[int] = set()
            for at, place in sorted(hits[name]):
                # Seeds whose diagonals lie in one step share an alignment, whose band is as much wider.
                if at < done or (near := (at - place) // _STEP) in failed:
                    continue
                low, high = max(done, near * _STEP - width), min(len(codes), near * _STEP + _STEP + len(template) + width)
                enough = coverage * len(template)
                if mine[high] - mine[low] >= enough and _most(codes[low:high], kinds, counts) >= enough:
                    score, first, stop, matched = align(template, codes[low:high], near * _STEP - width - low, near * _STEP + _STEP + width - low)
                    if matched >= enough and matched:
                        found.append((low + first, low + stop, matched / len(template), matched, name))
                        done = low + stop
                        continue
                failed.add(near)
        return [(name, share, matched, spans(first)[0], spans(stop - 1)[1]) for first, stop, share, matched, name in _best(found)]


def _most(codes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> int:
    """How many of a template's words (each kind, how often) some words can match at most."""
    at = np.searchsorted(kinds, codes)
    at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == codes)]
    return int(np.minimum(np.bincount(at, minlength=len(kinds)), counts).sum())


def _words(text: str) -> tuple[list[str], Callable[[int], tuple[int, int]]]:
    """Lower-case words, and a function from a word's number to its first character and last + 1 in the text."""
    lower = text.lower()
    if len(lower) == len(text):  # every character has stayed in its place
        places: list[tuple[int, int]] = []

        def span(k: int) -> tuple[int, int]:
            if not places:
                places.extend(m.span() for m in _WORD.finditer(lower))
            return places[k]

        return _WORD.findall(lower), span
    matches = list(_WORD.finditer(text))
    return [m.group().lower() for m in matches], lambda k: matches[k].span()


def _best(found: list[tuple[int, int, float, int, str]]) -> list[tuple[int, int, float, int, str]]:
    """Of matches that overlap the one that covers its template most, then the one of most words, then the first by name."""
    kept: list[tuple[int, int, float, int, str]] = []
    for group in _overlapping(found):
        for m in sorted(group, key=lambda m: (-m[2], -m[3], m[4], m[0])):
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept[-len(group) :]):
                kept.append(m)
    return sorted(kept, key=lambda m: (m[4], m[0]))


def _overlapping(found: list[tuple[int, int, float, int, str]]) -> Iterator[list]:
    group, stop = [], -1
    for m in sorted(found):
        if m[0] >= stop and group:
            yield group
            group = []
        group.append(m)
        stop = max(stop, m[1])
    if group:
        yield group


_SCORE, _HIT, _PLACE = 1 << 42, 1 << 21, (1 << 21) - 1


def align(template: np.ndarray, codes: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """Best local alignment with diagonals (place in text less place in template) from low to high.

    (score, first word, last word + 1, words that match): two for a match, less one for a word changed, added or left out.
    Of equal scores that of more matches counts, then that which begins first. A cell is one number: score, matches, and
    first word, counted down. A row's cells are worked out at once, words added as a running maximum.
    """
    width = high - low + 1
    lane = np.arange(width)
    step = lane * _SCORE
    cells, best = np.zeros(width + 1, dtype=np.int64), (0, 0)
    for i, code in enumerate(template):
        at = i + low + lane
        inside = (at >= 0) & (at < len(codes))
        same = np.zeros(width, dtype=bool)
        same[inside] = codes[at[inside]] == code
        on, start = cells[:-1], np.where(inside, _PLACE - at, 0)
        row = np.where(same, np.where(on >= _SCORE, on, start) + 2 * _SCORE + _HIT, on - _SCORE)
        row = np.maximum(row, cells[1:] - _SCORE)  # the word of the template left out
        row = np.maximum.accumulate(row + step) - step
        row[~inside | (row < _SCORE)] = 0
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(at[k]) + 1)
        cells[:-1] = row
    value, stop = best
    return (value // _SCORE, _PLACE - (value & _PLACE), stop, value % _SCORE // _HIT) if value else (0, 0, 0, 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license_id, coverage, n_words, start_char, end_char): a row for every place where a template matches.

    coverage is the share of the template's words that the alignment matches, `coverage` or more. Of matches that overlap
    the best stays, so that a notice inside a whole text and a notice like a sibling's are not reported beside it. Places are
    those of the text as it is. Null and empty texts match nothing. Repeated rows give their matches each; null ids stay
    null; other columns are not read. No rows give no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts)
        for rows in batches:
            found = [(k, *m) for k, t in enumerate(rows.column("text").to_pylist()) for m in index.scan(t, coverage)]
            if found:
                at, *columns = zip(*found, strict=True)
                columns = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at)), *columns], ["doc_id", "license_id", "coverage", "n_words", "start_char", "end_char"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, license_id string, coverage double, n_words long, start_char long, end_char long")
