"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates.

Paragraphs are the blocks between blank lines, wrapped lines joined, and every
single line; of those over WINDOW words, each stretch of WINDOW words, half
overlapping, is one too, so a notice inside a long paragraph is seen and no
word is left out. A sparse logistic regression over their words and word pairs
(present or not) has a class for each licence and one for "unknown". It is
trained on the templates below, whole, cut and damaged, and on short notices
made from the licences' names; the unknown class learns from paragraphs of the
documents that are near no template, and from sentences that name licences
without granting them. Calibration uses examples that training has not seen,
with refusals in words of their own: a temperature, and the least probabilities
of any licence, for paragraphs that meet many word pairs and for others, that
let through FALSE_ALARMS of the unknown ones at most (from 0.5 to 0.95).

A paragraph that passes is confirmed against the templates of the licences
that the classifier holds for possible: CONFIRMED of a template's word pairs
must be met, or of the paragraph's own, in that template; its numbers must be met;
and no word of denial may stand before the words that are met. The licence met best wins, so versions are told apart.
Paragraphs that two licences share have a class of their own, resolved by the document's others.

Training draws at most MAX_UNKNOWN paragraphs of WINDOW words or fewer, one a
document, by a hash of the text, and fits in one task on the driver.

Defined cases: null and empty texts have no licences; a text with several
licences has them all, sorted; repeated rows are judged alike; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MAX_UNKNOWN, FALSE_ALARMS, CONFIRMED, POSSIBLE, LONG, WINDOW, ROUNDS = 3000, 0.001, 0.8, 0.02, 20, 60, 180

#: Names of licences, by SPDX identifier.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT license"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
#: Short notices, and sentences that name a licence without granting it (for training, and for calibration).
GRANTS = ["Licensed under the {}.", "This work is licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.", "This code is available under the {}.", "Licensed under {}.", "This work is licensed under {}."]
DENIALS = ["This work is not licensed under the {}.", "It was never released under the {}.", "The {} is a popular choice among authors.", "She wrote a paper about the {}.", "Unlike the {}, these terms are strict.", "Read the {} before you ask.", "Some prefer the {} to others."]
OTHER_DENIALS = ["It is no longer licensed under the {}.", "We do not use the {}.", "The history of the {} began early.", "Nothing here is released under the {}.", "They compared the {} with their own terms."]
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_OLD = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
#: Paragraphs of public licence texts and of the notices that these ask for.
TEXTS = {
    "AGPL-3.0": [_GPL.format("Affero General Public License", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        _BSD_WARRANTY,
    ],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License. https://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. https://creativecommons.org/licenses/by-nc/4.0/"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. https://creativecommons.org/licenses/by-sa/4.0/"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"],
    "GPL-2.0": [_GPL_OLD.format("program", "General Public License", "2"), _GPL.format("General Public License", "2")],
    "GPL-3.0": [_GPL.format("General Public License", "3"), _GPL_OLD.format("program", "General Public License", "3")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [_GPL_OLD.format("library", "Lesser General Public License", "2.1")],
    "LGPL-3.0": [_GPL.format("Lesser General Public License", "3"), _GPL_OLD.format("library", "Lesser General Public License", "3")],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
}
#: Titles of licence texts, which must be a paragraph of their own.
TITLES = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"],
}
#: Sentences near licences in words that are none.
GENERAL = [
    "The driver showed her license to the officer.", "A version of the story was released to the public.", "All work and no play.", "You may use this source for free.",
    "General terms and conditions of the public library.", "The foundation published a free copy of the work.", "In the common version of the program the creative work is copied.",
    "She asked for permission to copy the files.", "The software was written by any person at work.", "Her rights were reserved for the other person.", "Licensed to drive.",
    "Released in version 4.0 of the game.", "He was granted a copy under the law.", "All seats are reserved.", "The rights of all persons are equal.", "No warranty was given for the car.",
]
#: Words of denial.
DENYING = frozenset("not never no nothing none neither nor without unlike isn't cannot".split())
_WORD = re.compile(r"[a-z0-9.+'-]*[a-z0-9]")


def templates() -> dict[str, list[str]]:
    """Paragraphs by class: texts, short notices and identifiers."""
    out = {f: [*ps, *TITLES.get(f, [])] for f, ps in TEXTS.items()}
    for f, names in NAMES.items():
        own = out.setdefault(f, [])
        own += [g.format(n) for n in names for g in GRANTS]
        own += [f"SPDX-License-Identifier: {f}{end}" for end in ("", *(("-only", "-or-later") if "GPL" in f else ()))]
    return out


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str]) -> set[str]:
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


class Template:
    """A paragraph to compare with: its word pairs and its numbers."""

    def __init__(self, text: str, title: bool = False):
        self.title = title
        w = words(text)
        self.words = frozenset(w)
        self.pairs = frozenset(zip(w, w[1:]))
        self.numbers = frozenset(x for x in w if x[0].isdigit())

    def share(self, w: list[str]) -> float:
        """The share of this paragraph's word pairs that are in w."""
        return len(self.pairs.intersection(zip(w, w[1:]))) / max(1, len(self.pairs))

    def met(self, w: list[str]) -> tuple[float, int]:
        """How far words w are this paragraph (or, above 0 only from six word pairs on, a part of it), from 0 to 1, and in how many word pairs.

        0 if numbers differ or it is denied. A part's pairs count half, so that whole paragraphs come first.
        """
        own = list(zip(w, w[1:]))
        common = self.pairs.intersection(own)
        whole = self.share(w)
        part = len(common) / max(1, len(set(own))) if len(common) >= 6 else 0.0
        if self.title and len(common) < CONFIRMED * len(set(own)):
            return 0.0, 0
        numbers = {x for x in w if x[0].isdigit()}
        if whole >= part:
            agree = self.numbers <= numbers
        else:  # a part of the paragraph, whose numbers must be in it
            agree = numbers <= self.numbers
        if not agree:
            return 0.0, 0
        for i, x in enumerate(w):
            if x in DENYING and not any(p in common for p in own[max(0, i - 1) : i + 1]) and any(p in common for p in own[i + 1 : i + 7]):
                return 0.0, 0
        return (whole, 2 * len(common)) if whole >= CONFIRMED else (part, len(common)) if part >= CONFIRMED else (max(whole, part), 0)


def paragraphs(text: str) -> Iterator[tuple[int, bool, int, list[str]]]:
    """First line of the block, whether its lines are joined, line and words of each paragraph, of at most WINDOW words."""
    lines = [words(x) for x in text.split("\n")]
    blank = [not x.strip() for x in text.split("\n")]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and not blank[end]:
            end += 1
        block = [w for x in lines[at:end] for w in x]
        if end - at > 1:
            yield from ((at, True, line, w) for line, w in _windows(at, block, lines[at:end]))
        for i in range(at, end):
            yield from ((at, False, line, w) for line, w in _windows(i, lines[i], [lines[i]]))
        at = end + 1


def _windows(line: int, w: list[str], lines: list[list[str]]) -> Iterator[tuple[int, list[str]]]:
    if len(w) <= WINDOW:
        if w:
            yield line, w
        return
    starts = np.cumsum([0, *(len(x) for x in lines)])
    for i in range(0, len(w) - WINDOW // 2, WINDOW // 2):
        yield line + int(np.searchsorted(starts, i, "right")) - 1, w[i : i + WINDOW]


class Classifier:
    """Multinomial logistic regression over the grams of the templates and of the sentences that name licences."""

    def __init__(self, unknown: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        texts = templates()
        self.families = sorted(texts)
        self.templates = {f: [Template(p, p in TITLES.get(f, ())) for p in ps] for f, ps in texts.items()}
        none = len(self.families)
        fits, tests = [], []
        for k, f in enumerate(self.families):
            for p in texts[f]:
                w = words(p)
                fits += [(k, w)] * 4 + [(k, x) for x in _damaged(rng, w, 8 + len(w) // 4)]
                tests += [(k, x) for x in _damaged(rng, w, 2)]
        names = [n for ns in NAMES.values() for n in ns]
        fits += [(none, words(d.format(n))) for d in DENIALS for n in names] + [(none, words(p)) for p in GENERAL * 3]
        tests += [(none, words(d.format(n))) for d in OTHER_DENIALS for n in names]
        every = [w for f in self.families for p in texts[f] for w in words(p)]
        mixed = [[every[i] for i in rng.integers(0, len(every), int(rng.integers(2, 14)))] for _ in range(450)]
        far = [w for w in map(words, unknown) if w and not any(t.met(w)[0] >= 0.3 for ts in self.templates.values() for t in ts if not t.words.isdisjoint(w))]
        fits += [(none, w) for w in mixed[:300] + far[::2]]
        tests += [(none, w) for w in mixed[300:] + far[1::2]]
        known = sorted({g for _, w in fits[: -len(mixed[:300] + far[::2]) or None] for g in grams(w)})
        self.vocabulary = {g: i for i, g in enumerate(known)}
        self.w = self._fit(fits, none + 1)
        y = np.array([k for k, _ in tests])
        logits = np.array([self._logits(w) for _, w in tests])
        self.heat = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
        # Only what passes the comparison can be a false alarm: one bound for paragraphs met in many word pairs, one for the others.
        alarms: dict[bool, list[float]] = {True: [], False: []}
        for p, (k, w) in zip(1 - _softmax(logits / self.heat)[:, none], tests, strict=True):
            if k == none and (found := self._confirmed(w, np.ones(none))):
                alarms[found[3]].append(float(p))
        n = int(FALSE_ALARMS * (y == none).sum())
        self.least = {full: float(np.clip(sorted(ps)[max(0, len(ps) - 1 - n)] if ps else 0.5, 0.5, 0.95)) for full, ps in alarms.items()}
        # The most that a gram can add to the margin of any licence over unknown, and the margin that is needed: an exact bound.
        margin = self.w[:, :none] - self.w[:, none:]
        top = np.maximum(margin[:-1].max(1), 0)
        self.gain = {g: float(top[i]) for g, i in self.vocabulary.items() if top[i] > 0}
        self.base = float(margin[-1].max())
        low = min(self.least.values())
        self.need = self.heat * float(np.log(low / (1 - low) / none))

    def _ids(self, w: list[str]) -> list[int]:
        return [i for i in map(self.vocabulary.get, grams(w)) if i is not None]

    def _logits(self, w: list[str]) -> np.ndarray:
        return self.w[self._ids(w)].sum(0) + self.w[-1]

    def _fit(self, rows: list[tuple[int, list[str]]], k: int) -> np.ndarray:
        """Sparse full-batch descent with momentum and a small ridge; the last row is the bias."""
        ids = [sorted({*self._ids(w), len(self.vocabulary)}) for _, w in rows]
        n = np.array([len(i) for i in ids])
        column, row = np.concatenate(ids), np.repeat(np.arange(len(rows)), n)
        start = np.cumsum(n) - n
        by_column = np.argsort(column, kind="stable")
        present, first = np.unique(column[by_column], return_index=True)
        y = np.array([c for c, _ in rows])
        weight = (len(rows) / k / np.maximum(1, np.bincount(y, minlength=k)))[y]
        weight[y == k - 1] *= k / 2
        one, w = np.eye(k)[y], np.zeros((len(self.vocabulary) + 1, k))
        step, size = np.zeros_like(w), 0.9 * weight.sum() / len(rows)
        for _ in range(ROUNDS):
            error = weight[:, None] * (_softmax(np.add.reduceat(w[column], start)) - one) / weight.sum()
            grad = 1e-5 * w
            grad[present] += np.add.reduceat(error[row[by_column]], first)
            step = 0.9 * step - size * grad
            w = w + step
        return w

    def _confirmed(self, w: list[str], p: np.ndarray) -> tuple[str, float, bool, bool] | None:
        """The possible licence whose template is met in most word pairs, how far, whether as a whole, and whether in LONG pairs; None if two are met alike."""
        best, own, whole = (0, 0.0), set(), False
        for f, likely in zip(self.families, p, strict=False):
            for t in self.templates[f] if likely >= POSSIBLE else ():
                met, n = t.met(w)
                if n and (n, met) >= best:
                    own = own | {f} if (n, met) == best else {f}
                    best, whole = (n, met), t.share(w) >= CONFIRMED
        return (own.pop(), best[1], whole, best[0] >= LONG) if len(own) == 1 else None

    def classify(self, w: list[str]) -> tuple[str, float, float, bool] | None:
        """Family, probability that it is any licence, share of the template met and whether of the whole one, or None for unknown."""
        gain = self.gain
        if self.base + sum(gain.get(g, 0.0) for g in grams(w)) < self.need:
            return None
        p = _softmax(self._logits(w)[None] / self.heat)[0]
        if 1 - p[-1] < min(self.least.values()):
            return None
        found = self._confirmed(w, p[:-1])
        return (found[0], float(1 - p[-1]), *found[1:3]) if found and 1 - p[-1] >= self.least[found[3]] else None

    def licences(self, text: str) -> tuple[list[str], list[dict]]:
        """Families of a text, and its licence paragraphs: lines that are whole ones, blocks for what their lines do not say, and parts where blocks say nothing."""
        hits: dict[tuple[int, str], dict] = {}
        for _, group in groupby(paragraphs(text), lambda p: p[0]):
            got = [(joined, line, c) for _, joined, line, w in group if (c := self.classify(w))]
            told = {c[0] for joined, _, c in got if joined}
            alone = {c[0] for joined, _, c in got if not joined and c[3]}
            for joined, line, (family, p, met, whole) in got:
                if (family in alone) if joined else (not whole and told):
                    continue
                if met > hits.get((line, family), {"met": 0.0})["met"]:
                    hits[line, family] = {"line": line, "family": family, "probability": p, "met": met}
        found = {f for _, f in hits}
        if "BSD" in found:  # of the two licences that share these paragraphs, the one with more clauses if they are there
            found = found - {"BSD"} | ({"BSD-2-Clause"} if "BSD-3-Clause" not in found else set())
        return sorted(found), [hits[k] for k in sorted(hits)]


def _damaged(rng: np.random.Generator, w: list[str], n: int) -> Iterator[list[str]]:
    """Paragraphs with some words lost, and stretches of long ones."""
    for _ in range(n):
        kept = [x for x in w if rng.random() > 0.08] or w
        if len(kept) > 16 and rng.random() < 0.6:
            size = int(rng.integers(12, min(WINDOW, len(kept))))
            at = int(rng.integers(0, len(kept) - size + 1))
            kept = kept[at : at + size]
        yield kept


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, text: str = "text") -> Classifier:
    """A classifier whose unknown class knows paragraphs of docs."""
    t = docs.select(F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    share = min(1.0, MAX_UNKNOWN / max(1, t.count()))
    h = F.xxhash64(F.lit("licences"), "t")
    drawn = t.where(F.pmod(h, F.lit(1_000_000)) <= int(share * 1_000_000)).select(F.split("t", "\n").alias("l"), h.alias("h"))
    line = drawn.select(F.split(F.get("l", F.pmod("h", F.size("l")).cast("int")), " ").alias("w"), "h")
    start = F.pmod(F.shiftright("h", 17), F.greatest(F.lit(1), F.size("w") - WINDOW + 1)).cast("int") + 1
    part = line.select(F.array_join(F.slice("w", start, WINDOW), " ").alias("line"), "h").where("line <> ''")
    return Classifier([r["line"] for r in part.orderBy("h", "line").limit(MAX_UNKNOWN).collect()])


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, licences (families, sorted), paragraphs {line, family, probability, met}."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("met", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            got = [model.licences(t.as_py() or "") for t in b.column("text")]
            columns = [b.column("doc_id"), pa.array([f for f, _ in got], pa.list_(pa.string())), pa.array([h for _, h in got], found_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licences", "paragraphs"])

    return d.mapInArrow(run, f"doc_id {kind}, licences array<string>, paragraphs array<struct<line:int,family:string,probability:double,met:double>>")
