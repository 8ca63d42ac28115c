r"""Licence scan: passages against licence templates by Dice coefficient over word bigrams.

Text is normalised to lower-case words ``[a-z0-9]+``; a passage and a template are sets of word bigrams, and their Dice
coefficient is twice the shared ones by the sum of both sizes.  A passage is a line of a text, the whole text where it has
several lines, or, for a template, any run of as many words as the template has that begins with one of its bigrams: so a
licence is found however it is wrapped, and within other text.

A coefficient cannot reach the threshold t unless the sizes a <= b satisfy 2a >= t (a + b), so for lines and whole texts
the templates are those of fitting sizes, chosen before any bigram is compared; a run needs t / (2 - t) of the template's
bigrams, and runs with fewer hits are not compared.

Cases.  Null or empty text: no passage, no licence.  Passages or templates of less than two words have no bigram and match
nothing.  Ties: the higher coefficient, then the smaller licence name.  Repeated rows, or null ids: a row each.  Empty
table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartoflow.llm.common import Block, blocks, byte_table, gram_hashes, mixed, only, small_batches, span_hashes

# Notices by which works name their licence, and the texts of short licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

THRESHOLD = 0.8
_WORD = byte_table((0x30, 0x39), (0x61, 0x7A))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class _Bigrams:
    """Bigrams of a block: hash, text, line and number of each, in order; none crosses texts."""

    def __init__(self, block: Block):
        data = block.lower()
        starts, ends, owners = block.words(data, _WORD)
        hashes = gram_hashes(span_hashes(data, starts, ends), 2)
        inside = owners[: len(hashes)] == owners[1:] if len(owners) > 1 else np.zeros(0, bool)
        lines = np.searchsorted(np.flatnonzero(block.data == 10), starts)
        self.hashes, self.text, self.place = hashes[inside], owners[: len(hashes)][inside], np.flatnonzero(inside)
        self.line = np.where(lines[self.place] == lines[self.place + 1], lines[self.place], -1) if len(self.place) else self.place

    def distinct(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bigrams are the first of their kind in their passage (-1: of none), and the distinct ones of each passage."""
        at = np.flatnonzero(of >= 0)
        key = mixed(self.hashes[at] + of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = at[np.unique(key, return_index=True)[1]]
        return at, np.bincount(of[at])


class _Index:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.names, self.threshold = sorted({x for x, _ in templates}), threshold
        grams = _Bigrams(Block([x.encode() for _, x in templates]))
        first, sizes = grams.distinct(grams.text)
        self.sizes, self.long = np.zeros(len(templates), np.int64), np.bincount(grams.text, minlength=len(templates))
        self.sizes[: len(sizes)] = sizes
        self.licence = np.array([self.names.index(x) for x, _ in templates])
        order = np.argsort(grams.hashes[first], kind="stable")
        self.grams, self.of = grams.hashes[first][order], grams.text[first][order]

    def _hits(self, grams: _Bigrams) -> tuple[np.ndarray, np.ndarray]:
        """Bigrams that templates have, and those templates."""
        lo, hi = np.searchsorted(self.grams, grams.hashes), np.searchsorted(self.grams, grams.hashes, "right")
        at = np.flatnonzero(hi > lo)
        return np.repeat(at, (hi - lo)[at]), self.of[_spread(lo[at], (hi - lo)[at])]

    def _passages(self, grams: _Bigrams, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lines or whole texts: text, template and coefficient where it is high enough."""
        first, sizes = grams.distinct(of)
        # Passages that no template is of the size for go first.
        a, b = np.minimum.outer(sizes, self.sizes), np.maximum.outer(sizes, self.sizes)
        fits = 2 * a >= self.threshold * (a + b)
        first = first[fits.any(1)[of[first]]] if len(sizes) else first
        sub = object.__new__(_Bigrams)
        sub.hashes = grams.hashes[first]
        at, t = self._hits(sub)
        p = of[first[at]]
        keep = fits[p, t] if len(p) else np.zeros(0, bool)
        pair, shared = np.unique(p[keep] * len(self.sizes) + t[keep], return_counts=True)
        p, t = pair // len(self.sizes), pair % len(self.sizes)
        text = np.zeros(len(sizes), np.int64)
        text[of[first]] = grams.text[first]
        return self._over(p, text[p], t, 2.0 * shared / (sizes[p] + self.sizes[t]))

    def _over(self, p: np.ndarray, text: np.ndarray, t: np.ndarray, score: np.ndarray):
        keep = score >= self.threshold
        self.matched = np.unique(p[keep])
        return text[keep], t[keep], score[keep]

    def _runs(self, grams: _Bigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of a template's length that begin with one of its bigrams: text, template, coefficient."""
        at, t = self._hits(grams)
        order = np.lexsort((at, t))
        at, t = at[order], t[order]
        # Bigrams of a run are neighbours in the list of all, up to the end of the text.
        stop = np.searchsorted(grams.text, np.arange(grams.text[-1] + 2) if len(grams.text) else np.zeros(1))
        end = np.minimum(at + self.long[t], stop[grams.text[at] + 1]) if len(at) else at
        key = t * np.int64(1 << 40) + at
        within = np.searchsorted(key, t * np.int64(1 << 40) + end) - np.arange(len(at))
        live = np.flatnonzero(within >= self.threshold / (2 - self.threshold) * self.sizes[t])
        of = np.repeat(np.arange(len(live)), end[live] - at[live])
        words = grams.hashes[_spread(at[live], end[live] - at[live])]
        n = np.bincount(np.unique(np.stack([of.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64), minlength=len(live)) if len(live) else live
        of = np.repeat(np.arange(len(live)), within[live])
        words = grams.hashes[at[_spread(live, within[live])]]
        shared = np.bincount(np.unique(np.stack([of.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64), minlength=len(live)) if len(live) else live
        return self._over(live, grams.text[at[live]], t[live], 2.0 * shared / np.maximum(1, n + self.sizes[t[live]]))

    def scan(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its licence (-1: none), the coefficient, and how many lines (or the whole of several) match."""
        best, dice, n = np.full(block.n, -1), np.zeros(block.n), np.zeros(block.n, np.int64)
        grams = _Bigrams(block)
        if not len(grams.hashes):
            return best, dice, n
        several = np.bincount(np.searchsorted(block.ends, np.flatnonzero(block.data == 10)), minlength=block.n) > 1
        line_text = np.searchsorted(block.ends, np.flatnonzero(block.data == 10))
        for which in ("lines", "texts", "runs"):
            if which == "runs":
                text, t, score = self._runs(grams)
            else:
                text, t, score = self._passages(grams, grams.line if which == "lines" else np.where(several[grams.text], grams.text, -1))
                n += np.bincount(line_text[self.matched] if which == "lines" else self.matched, minlength=block.n)
            for doc, licence, x in zip(text.tolist(), self.licence[t].tolist(), score.tolist(), strict=True):
                if (-x, licence) < ((-dice[doc], best[doc]) if best[doc] >= 0 else (0.0, 0)):
                    best[doc], dice[doc] = licence, x
        return best, dice, n


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, licence (null: none), dice (0 where none), n_passages: lines, and the whole of several, that match."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates, threshold)
        for rows, block in blocks(batches, "text"):
            best, dice, n = index.scan(block)
            names = pa.array([index.names[i] if i >= 0 else None for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), names, pa.array(dice), pa.array(n)], names=["doc_id", "licence", "dice", "n_passages"])

    small_batches(docs.sparkSession)
    return only(docs, doc_id="doc_id", text="text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licence string, dice double, n_passages long")
