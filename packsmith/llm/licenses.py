"""License scans: MinHash bands over overlapping windows, verified by exact shingle containment.

A template is the set of its shingles of five words. A document is cut into blocks of B shingles, and every three neighbouring blocks
are a window; B is chosen for each template so that B is at least 1.25 times its length, so every occurrence with up to one and a half
times the template's length of insertions lies wholly inside a window, wherever it begins. A window gets the minimum of each of BANDS
hash permutations over its shingles, taken from the minima of its blocks; a band is one minimum, and a window that shares a band with a
template is a candidate. A candidate counts if it contains at least CONTAINED of the template's distinct shingles, whose words are
compared, not their hashes.

Such a window has at most 3B <= 5.625 n + 6 shingles for a template of n, of which 0.8 n are the template's: their Jaccard
similarity is 0.8 / 6.3 or more for n of 15 and above, and all bands miss it with a probability below (1 - 0.8 / 6.3) ** 96 = 2e-6.
See miss_probability.

Documents are scanned where they are, without a shuffle; the templates are a fixed list.

Edge cases: null and short texts have no shingles and no license; ties between windows go to the earlier one; repeated rows are scanned row
by row; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.llm.arrays import ALNUM, BASE, LOWER, U64, bounded, equal_spans, mixed, per_row, runs, span_hashes, text_bytes

SHINGLE, CONTAINED, BANDS = 5, 0.8, 96
#: Neighbouring blocks in a window.
BLOCKS = 3
PIECE_BYTES = 2 << 20
SEED = 11
RESULT_SCHEMA = "doc_id bigint, n_licenses bigint, licenses string, best double, spans string"

# Notices by which common licenses are known.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "boost-line": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "boost-terms": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-terms": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-terms": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


class Shingled:
    """The words of rows, and hashes of all runs of five of them: runs by row, and where each run's first word is."""

    def __init__(self, column: pa.Array) -> None:
        self.data, offsets = text_bytes(column)
        self.starts, ends = runs(self.data, offsets, ALNUM)
        self.data, self.sizes = LOWER[self.data], ends - self.starts
        words, n_words = span_hashes(self.data, self.starts, ends), per_row(self.starts, offsets)
        self.n = np.maximum(n_words - SHINGLE + 1, 0)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.first = (np.cumsum(n_words) - n_words)[row] + np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        out = np.zeros(len(row), U64)
        for k in range(SHINGLE):
            out = out * BASE + words[self.first + k]
        self.hashes = mixed(out)

    def same(self, own: np.ndarray, other: Shingled, others: np.ndarray) -> np.ndarray:
        """Whether runs of this have the same words as runs of the other."""
        out = np.ones(len(own), bool)
        for k in range(SHINGLE):
            left, right = self.first[own] + k, other.first[others] + k
            out &= self.sizes[left] == other.sizes[right]
            left, right = left[out], right[out]
            out[out] = equal_spans(self.data, self.starts[left], other.data, other.starts[right], self.sizes[left])
        return out


def block_size(n: int) -> int:
    """The block for templates of n shingles: the least of 2, 3, 4, 6, 8, 12, ... that is at least 1.25 n."""
    size = 2
    while size < 1.25 * n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def miss_probability(n: int, bands: int = BANDS) -> float:
    """How likely all bands miss a window that contains the least allowed share of a template of n shingles."""
    inside = int(np.ceil(CONTAINED * n))
    return (1 - inside / (BLOCKS * block_size(n) + n - inside)) ** bands


class Scanner:
    """The templates by block size, with their minima."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, bands: int = BANDS) -> None:
        rng = np.random.default_rng(SEED)
        self.factors = (rng.integers(0, 1 << 31, bands, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.names = sorted(templates)
        self.sets, self.words, self.places, by_block = [], [], [], {}
        for k, name in enumerate(self.names):
            words = Shingled(pa.array([templates[name]]))
            own, place = np.unique(words.hashes, return_index=True)
            if not len(own):
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            everywhere = place[np.searchsorted(own, words.hashes)]
            if not words.same(np.arange(len(everywhere)), words, everywhere).all():
                raise ValueError(f"{name} has different runs of words with one hash")
            self.sets.append(own)
            self.words.append(words)
            self.places.append(place)
            by_block.setdefault(block_size(len(own)), []).append(k)
        self.blocks = []
        for size, own in sorted(by_block.items()):
            minima = np.array([[self._minimum(self.sets[k], f) for k in own] for f in self.factors], np.uint32)
            self.blocks.append((size, np.array(own), np.argsort(minima, axis=1), np.sort(minima, axis=1)))

    @staticmethod
    def _minimum(own: np.ndarray, factor: np.uint32) -> np.uint32:
        return ((own >> U64(32)).astype(np.uint32) * factor).min()

    def chains(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
        """For block sizes 2, 4, 8, ... and 3, 6, 12, ...: the shingles of rows filled up to whole blocks of the largest size with
        their own last one, which changes no minimum; the sizes; and where each row begins in that order."""
        for base in (2, 3):
            most = max((size for size, *_ in self.blocks if size // (size & -size) == (1, 3)[base == 3]), default=0)
            if most:
                filled = -(-n // most) * most
                begin = np.cumsum(filled) - filled
                row = np.repeat(np.arange(len(n)), filled)
                place = np.minimum(np.arange(len(row)) - begin[row], n[row] - 1)
                yield (np.cumsum(n) - n)[row] + place, [base << k for k in range((most // base).bit_length())], begin

    def candidates(self, hashes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, first shingle of the row, window's start, window's end) that share a band."""
        if not len(hashes):
            return
        high, ends, used = (hashes >> U64(32)).astype(np.uint32), np.cumsum(n), {size: rest for size, *rest in self.blocks}
        for order, sizes, begin in self.chains(n):
            filled, found = high[order], {size: [] for size in sizes}
            for band, factor in enumerate(self.factors):
                least = filled * factor
                for size in sizes:
                    parts = [least[k :: sizes[0]] for k in range(sizes[0])] if size == sizes[0] else [least[0::2], least[1::2]]
                    least = np.minimum(parts[0], parts[1])
                    for more in parts[2:]:
                        least = np.minimum(least, more)
                    if size in used:
                        window = least
                        for ahead in range(1, BLOCKS):
                            window = np.r_[np.minimum(window[:-ahead], least[ahead:]), window[-ahead:]] if len(least) > ahead else window
                        found[size] += self._equal(window, *(x[band] for x in used[size][1:]))
            for size in sizes:
                for pair in np.unique(np.concatenate(found[size])).tolist() if found[size] else ():
                    window, template = divmod(pair, len(self.names))
                    row = int(np.searchsorted(begin, window * size, side="right")) - 1
                    base = int(ends[row] - n[row])
                    start = base + window * size - int(begin[row])
                    if start < ends[row]:
                        yield row, int(used[size][0][template]), base, start, min(start + BLOCKS * size, int(ends[row]))

    def _equal(self, least: np.ndarray, order: np.ndarray, minima: np.ndarray) -> Iterator[np.ndarray]:
        """Windows whose minimum is that of a template, as window * number of templates + the template's place."""
        if len(minima) <= 8:
            for k, own in zip(order.tolist(), minima, strict=True):
                if len(hit := np.flatnonzero(least == own)):
                    yield hit * len(self.names) + k
            return
        place = np.searchsorted(minima, least)
        place[place == len(minima)] = 0
        hit = np.flatnonzero(minima[place] == least)
        while len(hit):  # equal minima of several templates stand side by side
            yield hit * len(self.names) + order[place[hit]]
            place[hit] += 1
            hit = hit[place[hit] < len(minima)]
            hit = hit[minima[place[hit]] == least[hit]]

    def scan(self, column: pa.Array) -> list[dict[int, tuple[float, int, int]]]:
        """For each row its templates: the largest containment, and the words from the first to the last shared shingle there."""
        words = Shingled(column)
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(words.n))]
        for row, template, base, start, end in self.candidates(words.hashes, words.n):
            own, hashes = self.sets[template], words.hashes[start:end]
            place = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
            at = np.flatnonzero(own[place] == hashes)
            # Equal hashes propose a shared run of words; the words decide.
            at = at[words.same(at + start, self.words[template], self.places[template][place[at]])]
            contained = len(np.unique(place[at])) / len(own)
            if contained >= CONTAINED:
                found = (contained, int(at[0]) + start - base, int(at[-1]) + start - base + SHINGLE)
                held = out[row].get(template)
                if held is None or (found[0], -found[1]) > (held[0], -held[1]):
                    out[row][template] = found
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_licenses, their names by name, the largest containment, and name:first word:end by name."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.value
        for batch in bounded(batches, "text", PIECE_BYTES):
            found = scanner.scan(batch.column("text"))
            names = [[(scanner.names[k], *own[k]) for k in sorted(own)] for own in found]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x[0] for x in own) for own in names]), pa.array([max((x[1] for x in own), default=0.0) for own in names]), pa.array([",".join(f"{x[0]}:{x[2]}:{x[3]}" for x in own) for own in names])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_licenses", "licenses", "best", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, RESULT_SCHEMA)
