"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Every template and every text is cut into word shingles (lower-cased words without signs at their ends). Windows of
2 * half shingles start every half shingles; half is a power of two, from 1, and a template belongs to the least half
that is at least its number of shingles, so each of its occurrences lies whole inside a window of that size. An
occurrence to be found holds at least a part CONTAINMENT of the template, so it makes up a known least share of the
window's set (SHARE of a half: more than a fifth, and half of the window for templates of one or two shingles). A band
of one MinHash value misses it with probability 1 - SHARE at most; a half gets as many bands as bring all of them to
miss with probability MISS, or `bands` at most (64 bands at a fifth: 6 in 10 million). Window minima come from minima
of the halves, so a size costs half of the one below it.

A retrieved template is verified on the window's full set of shingles: the share of the template's shingles that it
holds must be CONTAINMENT or more. Overlapping and adjoining windows that verify one template make one match, trimmed
to its first and last common shingle. Templates are a list that workers hold (a few MB for thousands of licenses), so
texts aren't shuffled; `templates` takes any other list.

Defined cases: a null or blank text has no matches; templates shorter than a shingle are one shingle; a text shorter
than a shingle is one shingle; very long texts are scanned whole, in one piece; rows with null ids, repeated ids and
repeated rows are scanned each; where several templates fit one place, each is a match; an empty table gives an empty
result; other columns may have any names, they are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ODD, WordHashes, mix, shingle_hashes, worker_task

WIDTH = 5
BANDS = 64
CONTAINMENT = 0.8
MISS = 1e-7  # how likely all bands of a half may miss an occurrence, where `bands` are enough for it
CHUNK = 200_000  # shingles that are worked on at a time
SIGNS = b".,;:!?()[]{}<>\"'`*#%&$|/\\-_=+~^@"

# Notices by which texts state their license, as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def scan_words(text: str | None) -> list[bytes]:
    """Lower-cased words without signs at their ends; words of signs alone are dropped."""
    return [w for w in (x.strip(SIGNS) for x in text.encode("utf-8", "surrogatepass").lower().split()) if w] if text else []


def factors(bands: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD[2]) | np.uint64(1)
    return a, mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD[3])


class Templates:
    """Shingle sets of the templates, and for each half the bands of those that belong to it."""

    def __init__(self, templates: dict[str, list[str]], bands: int = BANDS, width: int = WIDTH, containment: float = CONTAINMENT):
        hashes, share = WordHashes(), {}
        self.bands, self.width = bands, width
        self.a, self.b = factors(bands)
        self.names, self.sets = [], []
        self.halves: dict[int, list[dict[int, list[int]]]] = defaultdict(lambda: [defaultdict(list) for _ in range(bands)])
        for name, texts in templates.items():
            for k, text in enumerate(texts):
                shingles = np.unique(shingle_hashes(scan_words(text), hashes, width))
                if len(shingles):
                    half = 1 << int(np.ceil(np.log2(len(shingles))))
                    for j in range(bands):
                        self.halves[half][j][int((shingles * self.a[j] + self.b[j]).min())].append(len(self.sets))
                    share[half] = min(share.get(half, 1.0), np.ceil(containment * len(shingles) - 1e-9) / (2 * half))
                    self.names.append((name, k))
                    self.sets.append(shingles)
        self.bands_of = {half: min(bands, int(np.ceil(np.log(MISS) / np.log1p(-x)))) for half, x in share.items()}
        self.keys = {half: [np.array(sorted(band), np.uint64) for band in found] for half, found in self.halves.items()}

    def retrieved(self, shingles: np.ndarray, owner: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(template, begin, end, owner) of windows that share a band with the template. Windows don't cross owners."""
        found: set[tuple[int, int, int, int]] = set()
        if not len(shingles):
            return found
        levels, below = [], None
        for half in sorted(self.halves):
            starts, owners = block_starts(owner, half)
            next_same = np.append(owners[1:] == owners[:-1], False)
            ends = np.append(starts[1:], len(shingles))
            last = np.where(next_same, np.append(ends[1:], ends[-1]), ends)
            # a block of this size is blocks of the size below
            levels.append((half, starts, owners, next_same, last, starts if below is None else np.searchsorted(below, starts)))
            below = starts
        for j in range(max(self.bands_of.values(), default=0)):
            least = shingles * self.a[j] + self.b[j]
            for half, starts, owners, next_same, last, at in levels:
                least = np.minimum.reduceat(least, at) if len(at) < len(least) else least
                if j >= self.bands_of[half]:
                    continue
                window = np.where(next_same, np.minimum(least, np.append(least[1:], least[-1])), least)
                keys = self.keys[half][j]
                place = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
                for w in np.flatnonzero(keys[place] == window):
                    for t in self.halves[half][j][int(window[w])]:
                        found.add((t, int(starts[w]), int(last[w]), int(owners[w])))
        return found


def block_starts(owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of blocks of `size` positions in each owner's run, and their owners."""
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, owner.dtype)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    starts = np.flatnonzero(inside % size == 0)
    return starts, owner[starts]


def matches(shingles: np.ndarray, owner: np.ndarray, templates: Templates, containment: float) -> list[tuple[int, int, int, int, float]]:
    """(owner, template, first shingle, last shingle, containment) with positions in the whole array."""
    verified = defaultdict(list)
    for t, begin, end, who in templates.retrieved(shingles, owner):
        common = np.flatnonzero(np.isin(shingles[begin:end], templates.sets[t]))
        held = len(np.unique(shingles[begin:end][common]))
        if held >= containment * len(templates.sets[t]):
            verified[who, t].append((begin + int(common[0]), begin + int(common[-1]), held / len(templates.sets[t])))
    out = []
    for (who, t), spans in verified.items():
        spans.sort()
        first, last, best = spans[0]
        for a, b, held in spans[1:]:
            if a <= last:
                last, best = max(last, b), max(best, held)
            else:
                out.append((who, t, first, last, best))
                first, last, best = a, b, held
        out.append((who, t, first, last, best))
    return out


@worker_task
def _scanned(batches: Iterator[pa.RecordBatch], listed: dict[str, list[str]], bands: int, containment: float) -> Iterator[pa.RecordBatch]:
    templates, hashes = Templates(listed, bands, containment=containment), WordHashes()

    def flush(ids: pa.Array, rows: list[np.ndarray], start: int) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in rows])
        first = np.cumsum(sizes) - sizes
        found = sorted(matches(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), templates, containment))
        columns = [ids.take(pa.array([start + f[0] for f in found], pa.int64())), pa.array([templates.names[f[1]][0] for f in found], pa.string()), pa.array([templates.names[f[1]][1] for f in found], pa.int32()), pa.array([f[2] - int(first[f[0]]) for f in found], pa.int64()), pa.array([f[3] - int(first[f[0]]) + templates.width for f in found], pa.int64()), pa.array([f[4] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "license", "template", "first_word", "end_word", "containment"])

    for batch in batches:
        rows, start, n = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            rows.append(shingle_hashes(scan_words(text.as_py()), hashes, templates.width))
            n += len(rows[-1])
            if n >= CHUNK:
                yield flush(batch.column(0), rows, start)
                rows, start, n = [], i + 1, 0
        if rows:
            yield flush(batch.column(0), rows, start)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per match: id, license, template (its number), first_word, end_word (of the text's scanned words), containment."""
    listed = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(lambda it: _scanned(it, listed, bands, containment), f"id {kind}, license string, template int, first_word bigint, end_word bigint, containment double")
    return found.withColumnRenamed("id", id_col)
