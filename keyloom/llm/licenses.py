"""Operator 10: license notices in documents.

Templates are short notices, headers and permission texts (MIT and BSD whole, ISC and
Unlicense without their warranty paragraphs); SPDX lines are read for any identifier.  Words are
lower-cased runs of letters and digits (dots inside numbers stay).  Each template's
runs of ``GRAM`` words are hashed and winnowed (the least of every ``WINNOW``
neighbours), which makes an inverted index of a few thousand entries.  All word
runs of a document are looked up in it; hits of one template on nearby diagonals
are a candidate.  A candidate whose stretch of the document lacks the words that tell
its template from others, or shares too few words with it for any alignment to cover
enough (a bound that rules out no match), goes.  A banded alignment of the template
with the document around the others reports the words that match, the share of the
template that they cover, and where the match begins and ends.  Any match of GRAM +
WINNOW - 1 words in a row is a candidate.

The work is one pass over the documents; the index is built from the templates in
each task.  Of overlapping matches the one with most words stays (then the greater coverage).

Defined results: null and empty texts have no match; a text with several notices
has a row for each; repeated rows repeat their matches; very long texts are read
whole; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .textbatch import TextBatch, mixed, ranges, utf8

GRAM, WINNOW, BAND = 3, 3, 8
#: A match is reported if it covers this share of its template's words.
MIN_COVERAGE = 0.6
#: Words that a hit may lie off a candidate's diagonal.
DRIFT = 6

#: License notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is licensed under a Creative Commons CC0 1.0 Universal License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = TEMPLATES["BSD-2-Clause"][0]
TEMPLATES["BSD-2-Clause"].append(_BSD + _BSD_END)
TEMPLATES["BSD-3-Clause"] = [_BSD + _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_END]
TEMPLATES["MIT"].append(TEMPLATES["MIT"][2] + " " + _AS_IS.format("OR COPYRIGHT HOLDERS "))
#: Words that tell a notice from its siblings: where a template has them, its match must have them too.
REQUIRED = {"MIT": ["mit"], "Apache-2.0": ["apache license version 2.0"], "GPL-2.0": ["gnu general public license", "version 2"], "GPL-3.0": ["gnu general public license", "version 3"], "LGPL-2.1": ["lesser general public license", "version 2.1"], "LGPL-3.0": ["lesser general public license", "version 3"], "AGPL-3.0": ["affero general public license", "version 3"], "CC-BY-4.0": ["cc by 4.0", "attribution 4.0"], "CC-BY-SA-4.0": ["by sa 4.0", "attribution sharealike 4.0"], "CC-BY-NC-4.0": ["by nc 4.0", "attribution noncommercial 4.0"], "CC0-1.0": ["cc0 1.0"], "BSD-3-Clause": ["endorse or promote"]}
#: Identifiers of an SPDX line; each is a row with template -1.
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?\)*"
_SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SCHEMA = "doc_id long, license string, template int, coverage double, matched int, first_char long, end_char long"


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def spdx(text: str) -> list[tuple]:
    """A row as of :func:`matches` for each license identifier of an SPDX line."""
    out = []
    for m in _SPDX.finditer(text):
        for name in re.sub(r"\bWITH\s+\S+", "", m[1]).replace("(", "").replace(")", "").split():
            if name not in ("AND", "OR", "NONE", "NOASSERTION"):
                out.append((name, -1, 1.0, 3 + len(words_of(name)), m.start(), m.end()))
    return out


def distinguished(name: str, template: list[str], words: list[str]) -> bool:
    own, found = f" {' '.join(template)} ", f" {' '.join(words)} "
    return all(f" {x} " in found for x in REQUIRED.get(name, ()) if f" {x} " in own)


def possible(name: str, template: list[str], words: list[str], shift: int) -> bool:
    """Whether the words that an alignment at this shift can reach may give a match that is reported."""
    near = words[max(0, shift - BAND) : max(0, shift + len(template) + BAND)]
    if not distinguished(name, template, near):
        return False
    return (Counter(template) & Counter(near)).total() >= MIN_COVERAGE * len(template)


def grams(words: TextBatch) -> np.ndarray:
    h = words.word_hashes
    out = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = mixed(out ^ h[k : k + len(out)], 51)
    return out


@cache
def index() -> tuple[list[tuple[str, int, list[str]]], np.ndarray, np.ndarray, np.ndarray]:
    """The templates, and sorted hashes with the template and place of each winnowed fingerprint."""
    templates = [(name, i, words_of(t)) for name, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    entries = set()
    for k, (_, _, words) in enumerate(templates):
        h = grams(TextBatch([" ".join(words).encode()]))
        for at in range(max(1, len(h) - WINNOW + 1)):
            entries.add((int(h[at : at + WINNOW].min()), k, at + int(h[at : at + WINNOW].argmin())))
    rows = sorted(entries)
    return templates, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def align(template: list[str], words: list[str], shift: int) -> tuple[int, int, int]:
    """Best local alignment of the template with words, template word i within BAND of word i + shift.

    A match counts 1, a mismatch or a gap -1; returns (matched words, first word, end word).
    """
    width = 2 * BAND + 1
    best, before = (0, 0, 0, 0), [(0, 0, None)] * width  # score, matched, first word
    for i, t in enumerate(template):
        row: list[tuple] = []
        for d in range(width):
            j = i + shift + d - BAND
            options = [(0, 0, None)]
            if 0 <= j < len(words):
                score, matched, first = before[d]
                same = words[j] == t
                options.append((score + 1, matched + 1, j if first is None else first) if same else (score - 1, matched, first))
            if d + 1 < width:
                score, matched, first = before[d + 1]
                options.append((score - 1, matched, first))
            if d:
                score, matched, first = row[d - 1]
                options.append((score - 1, matched, first))
            row.append(max(options, key=lambda x: (x[0], x[1])))
            score, matched, first = row[d]
            if (score, matched) > best[:2]:
                best = (score, matched, first, j + 1)
        before = row
    return best[1:]


def matches(hits: list[tuple[int, int]], spans: list[tuple[int, int]], words: list[str]) -> list[tuple]:
    """Rows (license, template, coverage, matched, first and end character) from hits (index entry, word)."""
    templates, _, of, place = index()
    groups: dict[int, list[int]] = {}
    for entry, word in hits:
        groups.setdefault(int(of[entry]), []).append(word - int(place[entry]))
    found = []
    for k, shifts in groups.items():
        name, number, template = templates[k]
        last = None
        for shift in sorted(shifts):
            if last is not None and shift - last <= DRIFT:
                continue
            last = shift
            if not possible(name, template, words, shift + DRIFT // 2):
                continue
            matched, first, end = align(template, words, shift + DRIFT // 2)
            if matched >= MIN_COVERAGE * len(template) and distinguished(name, template, words[first:end]):
                found.append((matched, name, number, matched / len(template), first, end))
    kept: list[tuple] = []
    for m in sorted(found, key=lambda x: (-x[0], -x[3], x[1], x[2])):
        if not any(m[4] < o[5] and o[4] < m[5] for o in kept):
            kept.append(m)
    return sorted((n, k, c, m, spans[a][0], spans[b - 1][1]) for m, n, k, c, a, b in kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice found: license, its template, coverage, matched words, first and end character."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, keys, _, _ = index()
        for record in found:
            out = []
            for a, b in ranges(record.column(1)):
                ids = record.column(0).slice(a, b - a).to_pylist()
                texts = [t.decode("utf-8", "replace") for t in utf8(record.column(1).slice(a, b - a))]
                # the same words, one blank between: bytes that are no letter or digit end a word
                batch = TextBatch([" ".join(words_of(t)).encode() for t in texts])
                h = grams(batch)
                left, right = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                some = np.flatnonzero(left < right)
                doc = batch.word_doc[some]
                some, doc = (x[doc == batch.word_doc[np.minimum(some + GRAM - 1, len(batch.word_doc) - 1)]] for x in (some, doc)) if len(some) else (some, doc)
                out += [(i, *row) for i, t in zip(ids, texts, strict=True) if "SPDX" in t for row in spdx(t)]
                for i in np.unique(doc).tolist():
                    hits = [(e, int(w - batch.first_word[i])) for w in some[doc == i].tolist() for e in range(int(left[w]), int(right[w]))]
                    spans = [m.span() for m in _WORD.finditer(texts[i])]
                    out += [(ids[i], *row) for row in matches(hits, spans, batch.texts[i].decode().split(" "))]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _SCHEMA)
