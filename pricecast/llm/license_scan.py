"""License scans: Dice coefficient of word bigrams against licence templates (operator 3).

Every whole text is scanned at three grains: its lines, its paragraphs of several lines, and
the text as a whole. Notices that share their line or paragraph with other words, or stand in
comments, are found as windows of words. A unit is normalised (ASCII lower case, words of letters, digits and
non-ASCII characters) and its set of word bigrams is compared with each template's:
2 |A and B| / (|A| + |B|). A template can only reach ``MIN_DICE`` if the sizes satisfy
t / (2 - t) <= |A| / |B| <= (2 - t) / t, and if the smaller size's worth of shared bigrams is
found; the size bounds prune templates before any bigram is looked up, an index from bigram to
templates does the rest.

A window that begins or ends at a bigram that is not the template's, or whose first bigram
comes again in it, is no better than a shorter one; so from each of the template's bigrams in the
text the window grows to the size bound or to that bigram's next place, and the best end is taken.
Only templates with enough bigrams in the whole text are tried; that also tells whether any unit
can match. A window goes if better ones cover half of its words or more; it is listed unless a unit
that overlaps it has its licence already.

Templates are a bounded parameter (``TEMPLATES``); each task holds them. No shuffle.

Defined cases: null and empty texts and units of one word match nothing; equal scores go to the
alphabetically first licence; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pricecast.llm.common import map_columns
from pricecast.llm.decontam import words

MIN_DICE = 0.8

# Fixed texts: public licence notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, version 2.0."],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "Released under the MIT License.", "This work is licensed under the MIT License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.", "This work is licensed under the BSD License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "Released under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.",
                "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "Licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "Licensed under CC BY-SA 4.0."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without permission."],
}

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")    # as ``words`` parts them


def bigrams(text: str | None) -> set[tuple[bytes, bytes]]:
    w = words(text)
    return set(zip(w, w[1:], strict=False))


class Matcher:
    """Templates by size, and which template holds which bigram."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.owns: list[set[tuple[bytes, bytes]]] = []
        self.index: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for name in sorted(templates):
            for text in templates[name]:
                own = bigrams(text)
                if own:
                    for b in own:
                        self.index[b].append(len(self.names))
                    self.names.append(name)
                    self.sizes.append(len(own))
                    self.owns.append(own)
        self.known = frozenset(self.index)
        bound = least / (2 - least)
        self.low = min(self.sizes, default=1) * bound
        self.high = max(self.sizes, default=0) / bound
        self.bound = bound

    def best(self, unit: str) -> tuple[str, float] | None:
        """The best licence at or over the threshold."""
        # a unit has fewer bigrams than half its characters: a cheap form of the size bound
        if len(unit) < 2 * self.low + 1:
            return None
        own = bigrams(unit)
        n = len(own)
        if not self.low <= n <= self.high:
            return None
        get = self.index.get
        shared = Counter(t for b in own if (ts := get(b)) for t in ts
                         if self.sizes[t] * self.bound <= n <= self.sizes[t] / self.bound)
        found = None
        for t, k in shared.items():
            dice = 2 * k / (n + self.sizes[t])
            if dice >= self.least and (found is None or (-dice, self.names[t]) < (-found[1], found[0])):
                found = (self.names[t], dice)
        return found

    def windows(self, w: list[bytes], tried: list[int]) -> list[tuple[float, str, int, int]]:
        """(dice, licence, first word, last word) of the best windows of the words ``w``, best first."""
        found = []
        pairs = list(zip(w, w[1:], strict=False))
        for t in tried:
            size, own = self.sizes[t], self.owns[t]
            for a, first in enumerate(pairs):
                if first not in own:
                    continue
                seen, shared, best = {first}, 1, (2 / (1 + size), a)
                for q in range(a + 1, len(pairs)):
                    b = pairs[q]
                    if b == first:
                        break
                    if b in seen:
                        continue
                    seen.add(b)
                    if len(seen) * self.bound > size:
                        break
                    if b in own:
                        shared += 1
                        dice = 2 * shared / (len(seen) + size)
                        if dice > best[0]:
                            best = (dice, q)
                if best[0] >= self.least:
                    found.append((best[0], self.names[t], a, best[1] + 1))
        found.sort(key=lambda x: (-x[0], x[1], x[2], -x[3]))
        kept: list[tuple[float, str, int, int]] = []
        covered = bytearray(len(w))
        for x in found:
            n = x[3] + 1 - x[2]
            if 2 * covered.count(1, x[2], x[3] + 1) < n:
                covered[x[2]:x[3] + 1] = b"\1" * n
                kept.append(x)
        return kept

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) of the matching units and windows of a whole text, by position."""
        if not text:
            return []
        w = words(text)
        shared = Counter(t for b in self.known & set(zip(w, w[1:], strict=False)) for t in self.index[b])
        tried = [t for t, k in sorted(shared.items()) if 2 * k / (k + self.sizes[t]) >= self.least]
        if not tried:     # units hold no bigrams but the text's
            return []
        units: set[tuple[int, int]] = {(0, len(text))}
        at = 0
        for line in text.split("\n"):
            units.add((at, at + len(line)))
            at += len(line) + 1
        at = 0
        for m in [*_PARAGRAPH.finditer(text), None]:
            units.add((at, m.start() if m else len(text)))
            at = m.end() if m else at
        out = []
        for a, b in sorted(units):
            if (got := self.best(text[a:b])) is not None:
                out.append((a, b, *got))
        places = [m.span() for m in _WORD.finditer(text)]
        listed: dict[str, list[list[int]]] = defaultdict(list)    # merged, by position
        for a, b, name, _ in out:
            if (at := listed[name]) and a <= at[-1][1]:
                at[-1][1] = max(at[-1][1], b)
            else:
                at.append([a, b])
        for dice, name, a, b in self.windows(w, tried):
            start, end = places[a][0], places[b][1]
            k = bisect_left(listed[name], [end])
            if not k or listed[name][k - 1][1] <= start:
                out.append((start, end, name, dice))
        return sorted(out, key=lambda x: (x[0], x[1]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = MIN_DICE) -> DataFrame:
    """One row per document: doc_id, n_matches, licenses (sorted), best_license, best_dice, spans."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_matches", T.LongType()),
                           T.StructField("licenses", T.StringType()), T.StructField("best_license", T.StringType()),
                           T.StructField("best_dice", T.DoubleType()), T.StructField("spans", T.StringType())])
    state: dict = {}
    texts_of = TEMPLATES if templates is None else templates

    def run(ids: list, texts: list) -> dict[str, list]:
        if not state:
            state["m"] = Matcher(texts_of, least)
        found = [state["m"].scan(t) for t in texts]
        best = [min(((-d, n) for _, _, n, d in f), default=(0.0, None)) for f in found]
        return {"doc_id": ids, "n_matches": [len(f) for f in found],
                "licenses": [",".join(sorted({n for _, _, n, _ in f})) for f in found],
                "best_license": [n for _, n in best], "best_dice": [abs(d) for d, _ in best],
                "spans": [",".join(f"{n}:{a}:{b}" for a, b, n, _ in f) for f in found]}

    return map_columns(docs.select("doc_id", "text"), run, schema)
