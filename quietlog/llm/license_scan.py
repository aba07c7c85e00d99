"""Licence scans: Dice coefficient over word bigrams between stretches of a text and licence templates.

A stretch is a line, a paragraph (lines up to an empty one) or the whole text. Texts and templates are normalised alike: lower-cased, split at ASCII
punctuation and white space. With sets of a and b bigrams the coefficient is at most 2 min(a, b) / (a + b), so a template is only
compared where the stretch's size lies within b * t/(2-t) and b * (2-t)/t; stretches that share too few bigrams with all templates are dropped before that.

A licence that no stretch matches is looked for inside the text, across lines: in every run of words whose length lies within the same bounds of a template's. Such a
run holds at least b * t/(2-t) of the template's bigrams, so only places where they stand that close are scored, each for all lengths at once by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.textcore import PUNCTUATED, U64, Batch, grams, objects, pieces, small_batches

DICE = 0.8
#: Short public notices, and the openings of the licences' texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "All-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}
#: The licences' whole texts.
TEXTS: dict[str, tuple[str, ...]] = {f.name[:-4]: (f.read_text(encoding="utf-8"),) for f in sorted((resources.files("quietlog.llm") / "licences").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def bigram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bigram) without repeats, in order. One word alone is its own bigram."""
    b = Batch(texts, lower=True, gaps=PUNCTUATED)
    h = b.hashes()
    g = grams(h, 2)
    same = b.doc[:-1] == b.doc[1:] if len(h) > 1 else np.zeros(0, bool)
    alone = np.flatnonzero(np.diff(b.first) == 1)
    of = np.concatenate([b.doc[:-1][same] if len(h) > 1 else np.zeros(0, np.int64), alone])
    found = np.concatenate([g[same] if len(h) > 1 else np.zeros(0, U64), grams(h[b.first[alone]], 1)])
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    edge = np.ones(len(of), bool)
    edge[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return of[edge], found[edge]


class Templates:
    def __init__(self, templates: Mapping[str, tuple[str, ...]], dice: float):
        self.names = [(name, k) for name in sorted(templates) for k in range(len(templates[name]))]
        of, self.found = bigram_sets([templates[n][k] for n, k in self.names])
        self.size = np.bincount(of, minlength=len(self.names))
        self.known = np.unique(self.found)
        self.holds = np.zeros((len(self.known), len(self.names)), np.float32)
        self.holds[np.searchsorted(self.known, self.found), of] = 1
        self.held, self.holders = np.count_nonzero(self.holds, axis=1), np.nonzero(self.holds)[1]
        # An opening that stands word for word in a longer template of its licence and in one of another says nothing of which it is: it is no run.
        b = Batch([templates[n][k] for n, k in self.names], lower=True, gaps=PUNCTUATED)
        words = np.diff(b.first)
        plain = [b" ".join([b"", *(b.raw[x:y] for x, y in zip(b.start[lo:hi], b.end[lo:hi], strict=True)), b""]) for lo, hi in zip(b.first, b.first[1:], strict=False)]
        within = [{self.names[j][0] for j in range(len(plain)) if len(plain[j]) > len(x) and x in plain[j]} for x in plain]
        self.alone = [name not in w or len(w) == 1 for (name, _), w in zip(self.names, within, strict=True)]
        #: Bigrams in a row, repeats included, in a run that may match: least and most.
        self.least, self.most = np.ceil(self.size * dice / (2 - dice) - 1e-9).astype(int), np.floor((words - 1) * (2 - dice) / dice + 1e-9).astype(int)
        self.low, self.high, self.dice = self.size * dice / (2 - dice) - 1e-9, self.size * (2 - dice) / dice + 1e-9, dice

    def matches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, template, Dice coefficient) of at least dice."""
        of, found = bigram_sets(stretches)
        size = np.bincount(of, minlength=len(stretches))
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hit = self.known[at] == found
        of, at = of[hit], at[hit]
        if not len(of):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        start = np.flatnonzero(np.diff(of, prepend=-1))
        some = of[start]
        # Size bounds first: stretches that no template may match are not counted at all.
        length = np.diff(np.append(start, len(of)))
        may = (size[some][:, None] >= self.low) & (size[some][:, None] <= self.high) & (2.0 * length[:, None] >= (self.dice - 1e-6) * (size[some][:, None] + self.size))
        hope = may.any(axis=1)
        at = at[np.repeat(hope, length)]
        some, may, length = some[hope], may[hope], length[hope]
        if not len(some):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        common = np.add.reduceat(self.holds[at], np.cumsum(length) - length, axis=0)
        dice = np.where(may, 2.0 * common / (size[some][:, None] + self.size), 0)
        i, j = np.nonzero(dice >= self.dice - 1e-9)
        return some[i], j, dice[i, j]

    def runs(self, texts: list[str | None], found: set[tuple[int, str]]) -> Iterator[tuple[int, str, float]]:
        """(text, licence, Dice coefficient of the best run) of at least dice, without those in found. A run has two words at least."""
        b = Batch(texts, lower=True, gaps=PUNCTUATED)
        g = grams(b.hashes(), 2)
        if not len(g):
            return
        k = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        pos = np.flatnonzero((self.known[k] == g) & (b.doc[:-1] == b.doc[1:]))
        count = self.held[k[pos]]
        template = self.holders[np.repeat((np.cumsum(self.held) - self.held)[k[pos]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        order = np.argsort(template, kind="stable")
        pos, cut = np.repeat(pos, count)[order], np.searchsorted(template[order], np.arange(len(self.names) + 1))
        best: dict[tuple[int, str], float] = {}
        for j, (licence, _) in enumerate(self.names):
            p, least, most = pos[cut[j] : cut[j + 1]], self.least[j], self.most[j]
            if most < 1 or len(p) < least or not self.alone[j]:
                continue
            near = np.flatnonzero((p[least - 1 :] - p[: len(p) - least + 1] < most) & (b.doc[p[least - 1 :]] == b.doc[p[: len(p) - least + 1]]))
            doc = b.doc[p[near]]
            lo, hi = np.maximum(p[near + least - 1] - most + 1, b.first[doc]), np.minimum(p[near] + most, b.first[doc + 1] - 1)
            new = np.ones(len(near), bool)  # places that overlap are scored together
            new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
            for d, x, y in zip(doc[new], lo[new], hi[np.append(new[1:], True)[: len(new)]], strict=True):
                if (d, licence) not in found:
                    value = self.best_run(g[x:y], p[np.searchsorted(p, x) : np.searchsorted(p, y)] - x, j)
                    if value >= self.dice - 1e-9:
                        best[d, licence] = max(best.get((d, licence), 0.0), value)
        yield from ((d, licence, v) for (d, licence), v in best.items())

    def best_run(self, g: np.ndarray, hits: np.ndarray, j: int) -> float:
        """The greatest coefficient of template j and a run of least to most of the bigrams g; hits are the places of the template's.

        A place counts as a different bigram in the runs that begin after the bigram's place before."""
        n, best = len(g), 0.0
        order = np.argsort(g, kind="stable")
        before = np.full(n, -1)
        same = g[order[1:]] == g[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        at = np.arange(n)
        passed = np.searchsorted(hits, at)
        for length in range(self.least[j], min(self.most[j], n) + 1):
            begin = np.maximum(before + 1, at - length + 1)
            runs = n - length + 1
            every = np.cumsum(np.bincount(begin, minlength=n))[:runs] - at[:runs]
            common = np.cumsum(np.bincount(begin[hits], minlength=n))[:runs] - passed[:runs]
            best = max(best, float((2.0 * common / (every + self.size[j])).max()))
        return best


def stretches_of(text: str) -> list[str]:
    """The different lines, paragraphs and the whole of a text."""
    lines = text.splitlines()
    out = dict.fromkeys(x for x in lines if x.strip())
    if len(lines) > 1:
        out |= dict.fromkeys(p for p in text.replace("\r\n", "\n").split("\n\n") if p.strip())
        out[text] = None
    return list(out)


def scanned(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, dice: float = DICE, texts: Mapping[str, tuple[str, ...]] = TEXTS) -> DataFrame:
    """Per row of docs and licence found in it: doc_id, licence, dice (of the best stretch, 6 digits), stretches (how many different ones match).

    Where no stretch matches, dice is of the best run of words, and stretches is 1. Of a licence with several templates, whole texts among them, the best counts. Null and empty texts hold none; repeated rows give repeated results; a null doc_id
    stays null. Templates are few and fixed: they travel with the code. Other columns are not read."""
    known = Templates({name: (*templates.get(name, ()), *texts.get(name, ())) for name in {*templates, *texts}}, dice)
    small_batches(docs.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(it):
            parts = [stretches_of(t) if isinstance(t, str) else [] for t in pdf.text]
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            at, template, value = known.matches([s for p in parts for s in p])
            rows = pd.DataFrame({"doc": of[at], "licence": objects([known.names[j][0] for j in template]), "dice": np.round(value, 6), "at": at})
            best = rows.groupby(["doc", "licence"], as_index=False).agg(dice=("dice", "max"), stretches=("at", "nunique"))
            inside = list(known.runs([t if isinstance(t, str) else None for t in pdf.text], set(zip(best.doc, best.licence, strict=True))))
            if inside:
                best = pd.concat([best, pd.DataFrame([(d, licence, round(v, 6), 1) for d, licence, v in inside], columns=["doc", "licence", "dice", "stretches"])], ignore_index=True)
            ids = pdf.doc_id.astype("Int64").array
            yield pd.DataFrame({"doc_id": ids.take(best.doc.to_numpy(np.int64)), "licence": objects(best.licence.tolist()), "dice": best.dice.astype(float), "stretches": best.stretches.astype("int64")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInPandas(run, "doc_id long, licence string, dice double, stretches long")


def op7_license_scan(spark, sf_dir):
    """Licences in all documents."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
