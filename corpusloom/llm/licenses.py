"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import Block, blocks, column, mix, slices, words

# Notices as their licenses ask for them.
TEMPLATES = (
    ("Apache-2.0 short", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT short", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("GPL-3.0 short", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


@dataclass(frozen=True)
class ScanParams:
    """``containment``: least share of a template's shingles in one window. ``recall``: least probability that a window
    with that share collides with the template in a band, from which the number of bands follows.
    ``short``: templates up to this many shingles are looked up by every single shingle."""

    words: int = 5
    containment: float = 0.75
    recall: float = 0.9995
    short: int = 4


# Letters and digits stay, A-Z are lower-cased; other ASCII is space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)


def bands(j: float, recall: float) -> int:
    """Bands of one row that collide with at least ``recall`` at similarity ``j``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - j))


def _shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every shingle in order; a text of fewer words is one shingle."""
    h, doc, _, _ = words(Block(_PLAIN[block.raw], block.bounds), False)
    count = np.bincount(doc, minlength=len(block))
    first = np.cumsum(count) - count
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(grams)]
    inside = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
    out, at = mix(grams[inside]), doc[: len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for i in short:
            g = np.uint64(count[i])
            for x in h[first[i] : first[i] + count[i]]:
                g = mix(np.array([g]))[0] ^ x
            whole.append(g)
        where = np.searchsorted(at, short)
        out, at = np.insert(out, where, mix(np.array(whole, np.uint64))), np.insert(at, where, short)
    return out, at


class Scanner:
    """Templates by window size. A template of s shingles, S/2 < s <= S, is sought in windows of 2S at every S."""

    def __init__(self, templates: list[tuple[str, str]], p: ScanParams):
        self.p = p
        self.names, self.sets = [], []
        for name, text in templates:
            own = [np.unique(_shingles(b, p.words)[0]) for b in blocks([text])][0]
            if len(own):
                self.names.append(name)
                self.sets.append(own)
        least = p.containment * 0.5 / (2 + 0.5 * (1 - p.containment))
        self.odd = mix(np.arange(1, bands(least, p.recall) + 1, dtype=np.uint64)) | np.uint64(1)
        self.by_size: dict[int, list[int]] = {}
        singles: list[tuple[np.uint64, int]] = []
        for t, s in enumerate(self.sets):
            if len(s) <= p.short:
                singles += [(x, t) for x in s]
            else:
                self.by_size.setdefault(1 << (len(s) - 1).bit_length(), []).append(t)
        singles.sort()
        self.single_keys = np.array([x for x, _ in singles], np.uint64)
        self.single_of = np.array([t for _, t in singles], np.int64)

    def scan(self, block: Block) -> list[tuple[int, int, float, int]]:
        """(text index, template index, containment, first shingle of the best window)."""
        h, doc = _shingles(block, self.p.words)
        if not len(h):
            return []
        first = np.searchsorted(doc, np.arange(len(block) + 1))
        best: dict[tuple[int, int], tuple[float, int]] = {}

        def confirm(d: int, t: int, a: int, b: int) -> None:
            share = float(np.isin(self.sets[t], h[a:b]).mean())
            if share >= self.p.containment:
                at = int(a - first[d])
                old = best.get((d, t))
                if old is None or (-share, at) < (-old[0], old[1]):
                    best[d, t] = (share, at)

        if len(self.single_keys):
            lo, hi = np.searchsorted(self.single_keys, h, "left"), np.searchsorted(self.single_keys, h, "right")
            for i in np.flatnonzero(hi > lo):
                d = doc[i]
                for t in self.single_of[lo[i] : hi[i]]:
                    s = len(self.sets[t])
                    confirm(int(d), int(t), max(first[d], i - s + 1), min(first[d + 1], i + s))
        for size, own in self.by_size.items():
            cells = (np.diff(first) + size - 1) // size
            cell_doc = np.repeat(np.arange(len(block)), cells)
            nth = np.arange(len(cell_doc)) - np.repeat(np.cumsum(cells) - cells, cells)
            starts = first[cell_doc] + nth * size
            joined = np.append(cell_doc[1:] == cell_doc[:-1], False) if len(cell_doc) else np.zeros(0, bool)
            hits = set()
            for a in self.odd:
                low = np.minimum.reduceat(h * a, starts)
                low[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                for t in own:
                    for w in np.flatnonzero(low == (self.sets[t] * a).min()):
                        hits.add((int(w), t))
            for w, t in sorted(hits):
                confirm(int(cell_doc[w]), t, starts[w], min(starts[w] + 2 * size, first[cell_doc[w] + 1]))
        return [(d, t, s, at) for (d, t), (s, at) in sorted(best.items())]


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, p: ScanParams = ScanParams()) -> DataFrame:
    """(doc_id, template, containment, first_shingle): one row per document and template found in it, from the whole
    text. Null, empty and wordless texts match nothing; templates without words are ignored; repeated rows each
    give their own. Needs no shuffle: the templates go to every task, so they must fit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(list(templates), p)
        for b in slices(batches):
            ids, at, rows = column(b, doc_id), 0, []
            for block in blocks(column(b, text)):
                rows += [(ids[at + d], scanner.names[t], s, k) for d, t, s, k in scanner.scan(block)]
                at += len(block)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [doc_id, "template", "containment", "first_shingle"])

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} long, template string, containment double, first_shingle long")


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
