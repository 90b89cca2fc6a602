"""Licence scan: word-bigram Dice against licence templates.

A text is normalised (lower case, runs of letters and digits only) and read in
four kinds of segments: each line, each paragraph (lines up to an empty one),
the whole text, and runs of words of a template's length wherever they begin,
across lines and paragraphs: a licence in several paragraphs, under a copyright
line or in the midst of other text is found.  Templates of at least ``LONG``
bigrams meet runs of all lengths inside the size bounds, in steps of a
twentieth; shorter ones only runs of their own length.  A run counts only if
its first shared bigram stands before its last one in the template too (else
the end of one notice and the start of the next would make a third).
A segment and a template are compared by the Dice
coefficient of their bags of word bigrams, 2 |A & B| / (|A| + |B|).  Dice can
reach ``LEAST`` only if the smaller bag has at least LEAST / (2 - LEAST) of the
larger one's bigrams, so a segment meets only templates inside those size
bounds; of these only those with which it has a bigram in common.

The templates are a fixed list, the short notices in this module and the full
texts of the common licences in ``license_texts``; their bags of bigrams are
sent to all workers (a megabyte).  The full texts are read on the driver only.

Defined results.  Null and empty texts, and segments with fewer than two words,
match nothing.  Of several segments that match a template the best one is
returned, then the first and shortest; a run of words only if it is better than
all lines, paragraphs and the whole text.  Long texts are read whole.  Repeated
rows each give their rows; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessalith.llm.decontamination import normal_words, pairs
from tessalith.llm.kernel import U64, Runs, Text, frugal, slices

LEAST = 0.8
#: Bigrams from which on a template meets runs of other lengths than its own.
LONG = 8
#: Shared bigrams of runs that are counted at once.
AT_ONCE = 1 << 20

# The wording of public licences and of the usual notices of them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "All rights reserved."),
}

TEXTS = Path(__file__).resolve().parent / "license_texts"


def all_templates() -> dict[str, tuple[str, ...]]:
    """The notices, and behind them the full texts under the name of their file."""
    out = dict(TEMPLATES)
    for path in sorted(TEXTS.iterdir()):
        out[path.name] = (*out.get(path.name, ()), path.read_text(encoding="utf-8"))
    return out


_NEWLINE = np.ones(256, np.uint8)
_NEWLINE[10] = 0


def bigrams_of(texts: list[str]) -> list[np.ndarray]:
    text = Text(pc.utf8_lower(pa.array(texts, pa.string())))
    runs, hashes = normal_words(text)
    return [pairs(hashes[a:b]) if b - a > 1 else np.zeros(0, U64) for a, b in zip(runs.first, runs.first[1:], strict=False)]


class Templates:
    """Bags of bigrams: for each distinct (template, bigram) how often it occurs."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.names = [(name, k) for name, texts in templates.items() for k in range(len(texts))]
        bags = bigrams_of([t for texts in templates.values() for t in texts])
        self.size = np.array([len(b) for b in bags])
        self.least = least
        value = np.concatenate([np.zeros(0, U64), *bags])
        template = np.repeat(np.arange(len(bags)), self.size)
        place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, self.size)])
        order = np.lexsort((place, template, value))
        value, template, place = value[order], template[order], place[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (template[1:] != template[:-1])
        self.value, self.template = value[first], template[first]
        self.times = np.diff(np.append(np.flatnonzero(first), len(value)))
        self.first_place, self.last_place = place[first], place[np.flatnonzero(first) + self.times - 1]

    def matches(self, text: Text) -> np.ndarray:
        """Rows of (row, template, dice in millionths, first byte, last byte), best segment of each row and template."""
        runs, hashes = normal_words(text)
        two = pairs(hashes) if len(hashes) > 1 else np.zeros(0, U64)
        low, high = np.searchsorted(self.value, two, "left"), np.searchsorted(self.value, two, "right")
        useful = np.flatnonzero(high > low)
        out = []
        for begin, end in self.segments(text):
            words = np.searchsorted(runs.starts, begin), np.searchsorted(runs.starts, end)
            size = np.maximum(words[1] - words[0] - 1, 0)
            # The segments of one kind stand in order and apart: each useful bigram lies in one of them or crosses an edge.
            segment = np.searchsorted(words[0], useful, "right") - 1
            inside = (segment >= 0) & (useful + 1 < words[1][segment])
            bigram, segment = useful[inside], segment[inside]
            if not len(bigram):
                continue
            distinct, count = np.unique(np.stack([segment, low[bigram]], axis=1), axis=0, return_counts=True)
            segment, at = distinct[:, 0], distinct[:, 1]
            n = np.searchsorted(self.value, self.value[at], "right") - at
            entry = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            segment, count = np.repeat(segment, n), np.repeat(count, n)
            template = self.template[entry]
            a, b = size[segment], self.size[template]
            fits = np.minimum(a, b) * (2 - self.least) >= self.least * np.maximum(a, b)
            segment, template, both = segment[fits], template[fits], np.minimum(count, self.times[entry])[fits]
            key, back = np.unique(segment * len(self.names) + template, return_inverse=True)
            both = np.bincount(back, both)
            segment, template = key // len(self.names), key % len(self.names)
            dice = 2 * both / (size[segment] + self.size[template])
            good = dice >= self.least
            segment, template, dice = segment[good], template[good], dice[good]
            row = np.searchsorted(text.offsets, begin[segment], "right") - 1
            out.append(np.stack([row, template, np.rint(dice * 1e6).astype(np.int64), begin[segment] - text.offsets[row], end[segment] - text.offsets[row]], axis=1))
        found = np.concatenate([np.zeros((0, 5), np.int64), *out])
        found = np.concatenate([found, *self.word_runs(text, runs, useful, low, high, found)])
        found = found[np.lexsort((found[:, 4] - found[:, 3], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        return found[first]

    def lengths(self, size: int) -> list[int]:
        """Numbers of bigrams of the runs that a template of ``size`` bigrams is compared with, its own first."""
        low, high = self.least / (2 - self.least), (2 - self.least) / self.least
        other = {round(size * x / 20) for x in range(1, 41)} if size >= LONG else set()
        return [size, *sorted((x for x in other - {size} if low * size <= x <= high * size), key=lambda x: (abs(x - size), x))] if size else []

    def word_runs(self, text: Text, runs: Runs, useful: np.ndarray, low: np.ndarray, high: np.ndarray, found: np.ndarray) -> Iterator[np.ndarray]:
        """Rows as in ``matches`` of the runs of words that are better than what is ``found``."""
        useful = useful[runs.row[useful] == runs.row[useful + 1]]
        n = high[useful] - low[useful]
        entries = np.repeat(low[useful] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        places, of = np.repeat(useful, n), self.template[entries]
        order = np.argsort(of, kind="stable")
        entries, places = entries[order], places[order]
        bounds = np.searchsorted(of[order], np.arange(len(self.size) + 1))
        for t, size in enumerate(self.size.tolist()):
            at, entry = places[bounds[t] : bounds[t + 1]], entries[bounds[t] : bounds[t + 1]]
            # A run of the least length inside the bounds needs so many shared bigrams.
            if not len(at) or np.bincount(runs.row[at]).max() * 2 < self.least * size * (1 + self.least / (2 - self.least)) - 1:
                continue
            best = np.full(len(text), -1, np.int64)
            own = found[found[:, 1] == t]
            np.maximum.at(best, own[:, 0], own[:, 2])
            row = runs.row[at]
            for length in self.lengths(size):
                begin = np.minimum(at, runs.first[row + 1] - 1 - length)
                a, b = np.searchsorted(at, begin), np.searchsorted(at, begin + length)
                most = np.minimum(b - a, size) * 2 / (size + length)
                hope = np.flatnonzero((begin >= runs.first[row]) & (most >= self.least) & (np.rint(most * 1e6) > best[row]))
                hope = hope[np.unique(begin[hope], return_index=True)[1]]
                hope = hope[self.first_place[entry[a[hope]]] <= self.last_place[entry[b[hope] - 1]]]
                for part in np.array_split(hope, 1 + int((b - a)[hope].sum()) // AT_ONCE) if len(hope) else ():
                    m = (b - a)[part]
                    member = np.repeat(a[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    key, count = np.unique(np.repeat(np.arange(len(part)), m) * len(self.value) + entry[member], return_counts=True)
                    both = np.bincount(key // len(self.value), np.minimum(count, self.times[key % len(self.value)]), len(part))
                    dice = 2 * both / (size + length)
                    good = dice >= self.least
                    start, r, dice = begin[part[good]], row[part[good]], np.rint(dice[good] * 1e6).astype(np.int64)
                    better = dice > best[r]
                    start, r, dice = start[better], r[better], dice[better]
                    np.maximum.at(best, r, dice)
                    yield np.stack([r, np.full(len(r), t), dice, runs.starts[start] - text.offsets[r], runs.ends[start + length] - text.offsets[r]], axis=1)

    @staticmethod
    def segments(text: Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Begins and ends of the lines, of the paragraphs and of the texts."""
        lines = Runs(text, _NEWLINE)
        yield lines.starts, lines.ends
        # A paragraph goes on while the next line begins right behind one newline, in the same text.
        new = np.ones(len(lines), bool)
        new[1:] = (lines.starts[1:] - lines.ends[:-1] > 1) | (lines.row[1:] != lines.row[:-1])
        first = np.flatnonzero(new)
        if len(first):
            yield lines.starts[first], lines.ends[np.append(first[1:] - 1, len(lines) - 1)]
        full = np.flatnonzero(np.diff(text.offsets) > 0)
        yield text.offsets[:-1][full], text.offsets[1:][full]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, license, template, dice, begin, end (bytes of the lower-cased text) of the best segment for every template that matches."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or all_templates(), least))
    own = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_lower(batch.column(1))], names=["i", "t"])
            for part, text in slices(batch, "t"):
                found = known.matches(text)
                if len(found):
                    ids = part.column("i").take(pa.array(found[:, 0]))
                    names = [known.names[t] for t in found[:, 1]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in names]), pa.array([k for _, k in names], pa.int64()), pa.array(found[:, 2] / 1e6), pa.array(found[:, 3]), pa.array(found[:, 4])], names=["doc_id", "license", "template", "dice", "begin", "end"])

    return own.mapInArrow(frugal(scanned), "doc_id long, license string, template long, dice double, begin long, end long")


