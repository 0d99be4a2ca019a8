"""License scans: passages compared to licence templates by Dice over word bigrams.

A text is normalised to its words (case, marks and white space do not count). For
multisets of word bigrams A, B

    dice = 2 |A & B| / (|A| + |B|)   so   dice >= t   needs   |A| between
    t |B| / (2 - t)   and   (2 - t) |B| / t

Templates longer than the text allows are pruned by these bounds, and those of whose
bigrams the text has too few. For each of the others the text is read as a row of hits
(bigrams of the template, worth 2 - t) and misses (-t): a passage of dice >= t is a run
that sums to at least t |B|, so parts of the text without such a run are pruned too. In
the rest, windows within the size bounds are compared from starts an eighth of the
template apart: the best end for the start, then the best start for that end. Passages
may begin and end anywhere, in the middle of a line too.

Templates are the whole texts in ``license_texts``, and notices. The scan is one pass
without a shuffle. Of passages that overlap, the one that shares most bigrams with its
template stays.

Results on odd input: null, empty and one-word texts match nothing; very long texts are
read whole, in time that grows with their length; ties between templates go to the
higher dice, then the first name; rows without an id are scanned like any; repeated rows
are scanned once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import slices, table

MIN_DICE = 0.8
# fixed values: licence notices by SPDX-like name
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0 header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
NOTICES |= {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "AGPL-3.0 header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ],
    "GPL-2.0 header": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version."
    ],
    "GPL-3.0 header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ],
    "LGPL-2.1 header": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version."
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
_WORD = re.compile(r"[^\W_]+")
Match = tuple[str, float, int, int, int]  # name, dice, first and last bigram, shared bigrams


def templates() -> dict[str, list[str]]:
    """The notices and whole texts."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for f in resources.files("tallyfold.llm").joinpath("license_texts").iterdir():
        out.setdefault(f.name.removesuffix(".txt"), []).append(f.read_text())
    return out


def lowered(text: str) -> str:
    """Lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


class Templates:
    """Bigrams of all templates by number, and each template's counts of them."""

    def __init__(self, texts: dict[str, list[str]], min_dice: float = MIN_DICE):
        self.min_dice, self.number = min_dice, {}
        words = sorted((len(w), name, w) for name, some in texts.items() for t in some if len(w := _WORD.findall(lowered(t))) > 1)
        for _, _, w in words:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.names = [name for _, name, _ in words]
        self.sizes = np.array([n - 1 for n, _, _ in words], np.int64)
        rows = [self.bigrams(self.numbers(w)) for _, _, w in words]
        self.known = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
        self.counts = [Counter(np.searchsorted(self.known, r).tolist()) for r in rows]
        # templates of each bigram: the rows of ``owner`` from ``first`` on
        pairs = sorted((g, k) for k, c in enumerate(self.counts) for g in c)
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([g for g, _ in pairs], np.int64), np.arange(len(self.known) + 1))

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def bigrams(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:-1] * (len(self.number) + 1) + numbers[1:]

    def matches(self, words: list[str]) -> list[Match]:
        """The passages of a text, by place."""
        if len(words) < 2 or not len(self.known):
            return []
        t, n = self.min_dice, len(words) - 1
        grams = self.bigrams(self.numbers(words))
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == grams)
        if not len(place):
            return []
        gram = at[place]
        size = self.first[gram + 1] - self.first[gram]
        rows = np.repeat(self.first[gram] - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner, where = self.owner[rows], np.repeat(np.arange(len(place)), size)
        hits = np.bincount(owner, minlength=len(self.sizes))
        found: list[Match] = []
        for k in np.flatnonzero((t * self.sizes / (2 - t) <= n + 1e-9) & (hits >= t * self.sizes / (2 - t) - 1e-9)):
            mine = where[owner == k]
            found += self._passages(int(k), place[mine], gram[mine])
        taken, out = bytearray(n), []
        for m in sorted(found, key=lambda m: (-m[4], -m[1], m[0], m[2])):
            if taken.find(1, m[2], m[3] + 1) < 0:
                taken[m[2] : m[3] + 1] = b"\1" * (m[3] + 1 - m[2])
                out.append(m)
        return sorted(out, key=lambda m: m[2])

    def _passages(self, k: int, place: np.ndarray, gram: np.ndarray) -> Iterator[Match]:
        """Passages of one template, given its hits in the text."""
        t, size = self.min_dice, int(self.sizes[k])
        most, step = (2 - t) * size / t + 1e-9, max(1, size // 8)
        for a, b in self._runs(place, t * size - 1e-9):
            at, spots, grams = a, place[a:b].tolist(), gram[a:b].tolist()
            while at < b:
                i = at - a
                j, _ = self._grow(k, spots[i:], grams[i:], most)
                end = i + j
                back = [-x for x in reversed(spots[: end + 1])]
                j, shared = self._grow(k, back, grams[: end + 1][::-1], most)
                begin = end - j
                dice = 2 * shared / (spots[end] - spots[begin] + 1 + size)
                if dice >= t - 1e-12:
                    yield self.names[k], dice, spots[begin], spots[end], shared
                    at = a + end + 1
                else:
                    at += max(1, int(np.searchsorted(place[at:b], place[at] + step)))

    def _runs(self, place: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Stretches of hits within which some run of hits and misses sums to ``least``."""
        t = self.min_dice
        i, n = 0, len(place)
        spots = place.tolist()
        while i < n:
            total, best, j = 2 - t, 2 - t, i
            while j + 1 < n:
                gap = t * (spots[j + 1] - spots[j] - 1)
                if total - gap <= 0:
                    break
                total += 2 - t - gap
                best = max(best, total)
                j += 1
            if best >= least:
                yield i, j + 1
            i = j + 1

    def _grow(self, k: int, spots: list[int], grams: list[int], most: float) -> tuple[int, int]:
        """Of the windows that begin at the first hit, the last hit of the best one, and
        the bigrams it shares."""
        left, counts, size = {}, self.counts[k], int(self.sizes[k])
        shared, best, out = 0, 0.0, (0, 0)
        for j, (spot, g) in enumerate(zip(spots, grams, strict=True)):
            wide = spot - spots[0] + 1
            if wide > most:
                break
            n = left.get(g, counts[g])
            if n > 0:
                shared += 1
                if (dice := 2 * shared / (wide + size)) > best:
                    best, out = dice, (j, shared)
            left[g] = n - 1
        return out


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, license, dice, start, end (code points) of every passage that matches."""
    known = Templates(texts or templates(), min_dice)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = lowered(text)
                found = known.matches(_WORD.findall(text))
                if found:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    rows += [(doc, name, dice, spans[a][0], spans[b + 1][1]) for name, dice, a, b, _ in found]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "dice", "start", "end"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, license string, dice double, start long, end long")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
