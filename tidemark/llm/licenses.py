"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; hashes of `GRAM` words are winnowed over `WINDOW` neighbours and kept in a sorted
inverted index (fingerprint -> template, position). Its size is bounded by the templates, so it travels with the
task. A text's own winnowed fingerprints are looked up at once; hits on one diagonal form a candidate region, which
is aligned to the template inside a band. Of overlapping matches the longest stays. Whole license texts (those of more
than LONG words) share many everyday grams with other prose, so a region of theirs needs a SEEDS share of their
fingerprints before it is aligned.

The templates are notices, short licenses, and the whole texts in `wordings`, which the driver reads and tasks get.

Defined results: null or empty texts match nothing; a text may hold a license several times, each is reported;
repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import LOWER, batches, hash64, mix, stored, texts, tidy, utf8, word_array, word_hashes, word_spans

GRAM, WINDOW = 3, 2
COVERAGE = 0.7
LONG, SEEDS = 200, 0.02
MATCHES = "doc_id long, license string, coverage double, n_matched long, start_byte long, end_byte long, start_word long, n_words long"

# Wordings of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
}


def whole_texts() -> dict[str, str]:
    """The license texts of `wordings`, by name."""
    folder = resources.files("tidemark.llm") / "wordings"
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text() for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def _hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the offsets of the rows in words."""
    data, offs = utf8(col)
    data = LOWER[data]
    starts, ends = word_spans(data, offs, "alnum")
    codes, distinct = word_hashes(word_array(data, starts, ends))
    return hash64(distinct)[codes], starts, ends, np.searchsorted(starts, offs)


def fingerprints(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions of the winnowed grams; a row of fewer words than a gram has none."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = grams(words)
    row = np.searchsorted(offs, np.arange(len(words)), side="right") - 1
    whole = row[:n] == row[GRAM - 1 :]
    value = np.where(whole, g, ~np.uint64(0))
    best = np.arange(n)
    keep = np.zeros(n, bool)
    m = n - WINDOW + 1
    if m > 0:
        pick = best[:m].copy()
        for k in range(1, WINDOW):
            pick = np.where(value[pick] >= value[k : k + m], best[k : k + m], pick)
        keep[pick] = True
    lone = whole & ~np.append(False, whole[:-1]) & ~np.append(whole[1:], False)  # rows with one gram
    return np.flatnonzero((keep | lone) & whole)


def grams(words: np.ndarray) -> np.ndarray:
    out = words[: len(words) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = mix(out) + words[k : len(words) - GRAM + 1 + k]
    return mix(out)


class Index:
    """Words of the templates, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words, _, _, offs = _hashes(pa.array(list(templates.values()), pa.utf8()))
        self.words = [words[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        at = fingerprints(words, offs) if len(words) else np.zeros(0, np.int64)
        key = grams(words)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.template = key[order], (np.searchsorted(offs, at, side="right") - 1)[order]
        self.at = at[order] - offs[self.template]
        self.count = np.bincount(self.template, minlength=len(templates))

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of key, which of the postings) that agree."""
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(key)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words matched, and the text's span of the best local alignment with |j - i - shift| <= band (+2, -1, gap -1)."""
    m, width = len(template), 2 * band + 1
    lane = np.arange(width)
    score = np.zeros(width)
    best, end = 0.0, (0, 0)
    steps = np.zeros((m, width), np.int8)  # 0 stop, 1 both, 2 template only, 3 text only
    for i in range(m):
        j = i + shift - band + lane
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i]
        both = score + np.where(same, 2, -1)
        up = np.append(score[1:], -np.inf) - 1
        now = np.maximum(np.maximum(both, up), 0)
        step = np.where(now <= 0, 0, np.where(both >= up, 1, 2))
        across = np.maximum.accumulate(now + lane) - lane
        step = np.where(across > now, 3, step)
        now = np.where(inside, across, 0)
        steps[i] = np.where(inside, step, 0)
        score = now
        k = int(np.argmax(now))
        if now[k] > best:
            best, end = now[k], (i, k)
    if best <= 0:
        return 0, 0, 0
    i, k = end
    matched, last, first = 0, i + shift - band + k, i + shift - band + k
    while i >= 0 and steps[i, k]:
        j = i + shift - band + k
        if steps[i, k] == 1:
            if text[j] == template[i]:
                matched += 1
                first = j
            i -= 1
        elif steps[i, k] == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
        if k < 0 or k >= width:
            break
    return matched, first, last + 1


@tidy
def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per license found: the share of its words matched, and where."""
    templates = TEMPLATES | whole_texts() if templates is None else templates

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches(it):
            words, starts, ends, offs = _hashes(b.column("text"))
            _, byte_offs = utf8(b.column("text"))
            out: list[tuple] = []
            at = fingerprints(words, offs)
            if len(at) and len(index.key):
                which, post = index.hits(grams(words)[at])
                pos, tmpl = at[which], index.template[post]
                doc = np.searchsorted(offs, pos, side="right") - 1
                shift = pos - index.at[post]
                order = np.lexsort((pos, shift, tmpl, doc))
                regions: dict[tuple[int, int], list[list[int]]] = {}  # first shift, and how many hits
                for d, t, s in zip(doc[order].tolist(), tmpl[order].tolist(), shift[order].tolist(), strict=True):
                    own = regions.setdefault((d, t), [])
                    if not own or s - own[-1][0] > max(3, len(index.words[t]) // 8):
                        own.append([s, 0])
                    own[-1][1] += 1
                found: dict[int, list[tuple]] = {}
                for (d, t), shifts in regions.items():
                    lo, hi, w = int(offs[d]), int(offs[d + 1]), index.words[t]
                    for s, hits in shifts:
                        if hi - lo < coverage * len(w) or len(w) > LONG and hits < SEEDS * index.count[t]:
                            continue
                        band = max(4, len(w) // 4)
                        a, z = max(lo, s - band), min(hi, s + len(w) + 2 * band)
                        matched, first, last = align(w, words[a:z], s - a + band // 2, band)
                        if matched >= coverage * len(w):
                            found.setdefault(d, []).append((matched, matched / len(w), -t, a + first, a + last))
                for d, all_found in found.items():
                    taken: list[tuple] = []
                    for x in sorted(set(all_found), reverse=True):
                        if all(x[4] <= y[3] or x[3] >= y[4] for y in taken):
                            taken.append(x)
                    out += [(d, index.names[-t], c, m, int(starts[f] - byte_offs[d]), int(ends[e - 1] - byte_offs[d]), f - int(offs[d]), e - f) for m, c, t, f, e in sorted(taken, key=lambda x: x[3])]
            names = [c.split()[0] for c in MATCHES.split(", ")]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            doc_ids = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
            kinds = (pa.utf8(), pa.float64(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=names)

    return stored(texts(docs).mapInArrow(run, MATCHES), "licenses", keep=True)
