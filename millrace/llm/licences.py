"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by templates.

A paragraph ends where a line without words stands (blank, or comment marks alone); single line feeds do not end it, and marks such as `#`, `//`,
`*` or `--` at the start of a line are no words, so wrapped and commented notices are read as one. Paragraphs are cut into windows of `WINDOW` words,
each overlapping the one before by half, and so are their lines, so a notice inside a long paragraph is not diluted. A window is a sparse set of hashed words and word pairs; softmax regression gives a probability for each licence family and for
"unknown". The model is trained here, in numpy, on notices of the templates below, whole and cut, with words dropped and with corpus words around
them, against windows drawn from the corpus (at most `SAMPLE`, by a hash of the document) and shuffled licence words. Probabilities are calibrated by the
temperature that fits a held-out fifth best. A prediction counts if its calibrated probability reaches `LEAST` and the window shares at least
`CONFIRM` of the word pairs of a template of that family (of the shorter one of the two).

Only windows with at least one word pair of a template are scored: the others cannot be confirmed. One map over whole texts, no shuffle.

Cases: null and empty texts have no findings. Overlapping windows of one family in a paragraph are one finding, the best by similarity, then
probability, then place; windows apart from each other are findings of their own. Of overlapping findings of different families the one
that shares most word pairs with a template stays. A document that repeats gives its findings again. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import Tokens
from .stages import sampled
from .words import slices, window_hashes

BUCKETS, WINDOW, SAMPLE = 1 << 16, 30, 3000
LEAST, CONFIRM = 0.5, 0.6
ROUNDS, RATE, DECAY = 150, 0.5, 1e-4
UNKNOWN = "unknown"

# Short notices by which licences of a family are declared.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "This work has been dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ],
}


def _windows(new: np.ndarray) -> np.ndarray:
    """The windows of pieces of words, as start * (WINDOW + 1) + size; `new`: does a piece begin at this word?"""
    n = len(new)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    at = np.arange(n) - np.repeat(begin, size)
    left = np.repeat(size, size) - at
    starts = np.flatnonzero((at % (WINDOW // 2) == 0) & ((at == 0) | (left > WINDOW // 2)))
    return starts * (WINDOW + 1) + np.minimum(left[starts], WINDOW)


class Windows:
    """Windows of a slice of documents and their hashed words and word pairs."""

    def __init__(self, column: pa.Array):
        self.tokens = tokens = Tokens(column)
        n = len(tokens)
        lines = np.cumsum(tokens.data == 10)[tokens.starts] if n else np.zeros(0, np.int64)
        doc = tokens.docs
        other = doc[1:] != doc[:-1]
        lone = _windows(np.append(True, (lines[1:] != lines[:-1]) | other)[:n])
        new = np.append(True, (lines[1:] > lines[:-1] + 1) | other)[:n]
        self.paragraph_of_word = np.cumsum(new) - 1
        both = np.unique(np.concatenate([lone, _windows(new)]))
        self.starts = both // (WINDOW + 1)
        self.ends = self.starts + both % (WINDOW + 1)
        self.docs, self.paragraphs = doc[self.starts], self.paragraph_of_word[self.starts]
        hashes = tokens.hashes()
        self.one = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        self.two = np.append((window_hashes(hashes, 2) % np.uint64(BUCKETS)).astype(np.int64), 0)[:n]

    def take(self, keep: np.ndarray) -> None:
        self.starts, self.ends, self.docs, self.paragraphs = (x[keep] for x in (self.starts, self.ends, self.docs, self.paragraphs))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, first) of all windows: words, and pairs within the window."""
        size = self.ends - self.starts
        first = np.concatenate([[0], np.cumsum(2 * size - 1)])
        word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts, size)
        pair = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1) + np.repeat(self.starts, size - 1)
        out = np.empty(int(first[-1]), np.int64)
        spot = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
        out[spot] = self.one[word]
        spot = np.arange(len(pair)) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1) + np.repeat(first[:-1] + size, size - 1)
        out[spot] = self.two[pair]
        return out, first

    def pairs(self, k: int) -> set[tuple[str, str]]:
        words = self.texts(k)
        return set(zip(words, words[1:]))

    def texts(self, k: int) -> list[str]:
        return [x.decode("utf-8", "replace") for x in self.tokens.texts(self.starts[k], self.ends[k] - self.starts[k])]


class Classifier:
    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature
        notices = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
        shown = Windows(pa.array([text for _, text in notices]))
        self.templates: dict[str, list[set[tuple[str, str]]]] = {}
        for k in range(len(shown.starts)):
            self.templates.setdefault(notices[shown.docs[k]][0], []).append(shown.pairs(k))
        self.known = np.zeros(BUCKETS, bool)
        for a, b in zip(shown.starts, shown.ends):
            self.known[shown.two[a : b - 1]] = True

    def logits(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) == 1:
            return np.zeros((0, len(self.families)), np.float32)
        return np.add.reduceat(self.weights[features], first[:-1], axis=0) + self.bias

    def probabilities(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return softmax(self.logits(features, first) / self.temperature)

    def confirmed(self, family: str, pairs: set[tuple[str, str]]) -> float:
        """The largest share of word pairs in common with a template of the family, of the shorter one, but not of a few words only."""
        size = max(len(pairs), WINDOW // 2)
        return max((len(t & pairs) / min(len(t), size) for t in self.templates.get(family, [])), default=0.0)

    def shared(self, family: str, pairs: set[tuple[str, str]]) -> int:
        """The largest number of word pairs in common with a template of the family."""
        return max((len(t & pairs) for t in self.templates.get(family, [])), default=0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(others: list[list[str]], seed: int) -> tuple[list[str], list[str]]:
    """Texts and families: notices in many surroundings, corpus windows and shuffled licence words."""
    rng = np.random.default_rng(seed)
    notices = [(family, text.split()) for family, texts in TEMPLATES.items() for text in texts]
    vocabulary = sorted({word for _, words in notices for word in words})
    texts, families = [], []
    for family, words in notices:
        for k in range(40):
            kept = [w for w in words if k < 8 or rng.random() > 0.08] or words
            around = list(others[rng.integers(len(others))]) if others else list(rng.permutation(vocabulary))
            room = max(WINDOW - len(kept), 0)
            before = int(rng.integers(0, room + 1)) if k % 2 else 0
            after = int(rng.integers(0, room - before + 1)) if k % 4 > 1 else 0
            texts.append(" ".join([*around[:before], *kept, *around[-after:][:after]][:WINDOW]))
            families.append(family)
    for words in others:
        texts.append(" ".join(words))
        families.append(UNKNOWN)
    for _ in range(max(len(others) // 4, 200)):
        texts.append(" ".join(rng.permutation(vocabulary)[: rng.integers(2, 8)]))
        families.append(UNKNOWN)
    return texts, families


def train(others: list[list[str]], seed: int = 5) -> Classifier:
    """Softmax regression by Adagrad on four fifths of the examples; the temperature from the last fifth."""
    texts, names = _examples(others, seed)
    families = sorted(TEMPLATES) + [UNKNOWN]
    seen = Windows(pa.array(texts))
    seen.take(np.append(True, seen.docs[1:] != seen.docs[:-1]))
    wanted = np.array([families.index(names[d]) for d in seen.docs])
    features, first = seen.features()
    held = np.random.default_rng(seed).random(len(wanted)) < 0.2
    model = Classifier(families, np.zeros((BUCKETS, len(families)), np.float32), np.zeros(len(families), np.float32))
    used = np.unique(features)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    small = Classifier(families, np.zeros((len(used), len(families)), np.float32), model.bias)
    at = place[features]
    row = np.repeat(np.arange(len(wanted)), np.diff(first))
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
    share = np.bincount(wanted[~held], minlength=len(families))
    weight = np.where(held, 0, 1 / np.maximum(share, 1)[wanted]).astype(np.float32)[:, None] / len(families)
    goal = np.eye(len(families), dtype=np.float32)[wanted]
    past, past_bias = np.full_like(small.weights, 1e-8), np.full_like(small.bias, 1e-8)
    for _ in range(ROUNDS):
        slope = (softmax(small.logits(at, first)) - goal) * weight
        g = np.add.reduceat(slope[row[order]], starts, axis=0) + DECAY / len(families) * small.weights
        past += g * g
        small.weights -= RATE * g / np.sqrt(past)
        g = slope.sum(axis=0)
        past_bias += g * g
        small.bias -= RATE * g / np.sqrt(past_bias)
    raw = small.logits(at, first)[held]
    if len(raw):
        losses = {t: -np.log(softmax(raw / t)[np.arange(len(raw)), wanted[held]] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        model.temperature = min(losses, key=losses.get)
    model.weights[used], model.bias = small.weights, small.bias
    return model


def corpus_windows(docs: DataFrame, most: int = SAMPLE) -> list[list[str]]:
    """Windows for the unknown class: one from each of the documents with the smallest hashes, unless a template would confirm it."""
    blank = Classifier(sorted(TEMPLATES), np.zeros((1, len(TEMPLATES))), np.zeros(len(TEMPLATES)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, order = Windows(piece.column("text")), piece.column("o").to_numpy()
                first = np.searchsorted(found.docs, np.arange(piece.num_rows + 1))
                rows = [(d, a + order[d] % (b - a)) for d, (a, b) in enumerate(zip(first, first[1:])) if a < b]
                rows = [(d, k) for d, k in rows if max(blank.confirmed(f, found.pairs(k)) for f in TEMPLATES) < CONFIRM / 2]
                columns = [pa.array([order[d] for d, _ in rows], pa.int64()), pa.array([" ".join(found.texts(k)) for _, k in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["o", "text"])

    chosen = sampled(docs.select("doc_id").filter(F.col("text").isNotNull()), most, F.col("doc_id"), F.lit(3)).select("doc_id", "o")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("o", "text")
    rows = rows.mapInArrow(pick, "o long, text string").orderBy("o", "text").limit(most).collect()
    return [r.text.split() for r in rows]


def scan_licences(docs: DataFrame, least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, paragraph (from 0, of those with words), family, probability, similarity, passage (words of the window)."""
    model = train(corpus_windows(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = findings(model, piece.column("text"), least, confirm)
                columns = [piece.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.float64()), (4, pa.float64()), (5, pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "family", "probability", "similarity", "passage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, paragraph long, family string, probability double, similarity double, passage string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def findings(model: Classifier, column: pa.Array, least: float, confirm: float) -> list[tuple]:
    found = Windows(column)
    hits = np.concatenate([[0], np.cumsum(model.known[found.two])])
    found.take(hits[np.maximum(found.ends - 1, found.starts)] > hits[found.starts])
    if not len(found.starts):
        return []
    p = model.probabilities(*found.features())
    best = p.argmax(axis=1)
    first = np.searchsorted(found.tokens.docs, np.arange(len(column)))
    runs: dict[tuple, list[list]] = {}
    latest: dict[tuple, int] = {}
    for k in np.flatnonzero((best < len(model.families) - 1) & (p.max(axis=1) >= least)):
        family, pairs = model.families[best[k]], found.pairs(k)
        similar = model.confirmed(family, pairs)
        if similar < confirm:
            continue
        doc, start, end = int(found.docs[k]), int(found.starts[k]), int(found.ends[k])
        number = int(found.paragraphs[k] - found.paragraph_of_word[first[doc]])
        value = (round(similar, 9), float(p[k, best[k]]), -start, int(k))
        own = runs.setdefault((doc, number), [])
        at = latest.get((doc, number, family))
        if at is not None and start < own[at][2]:
            _, begin, stop, most, had = own[at]
            own[at] = [family, begin, max(stop, end), max(most, model.shared(family, pairs)), max(had, value)]
        else:
            latest[doc, number, family] = len(own)
            own.append([family, start, end, model.shared(family, pairs), value])
    out = []
    for (doc, number), own in sorted(runs.items()):
        out += [(doc, number, family, v[1], v[0], " ".join(found.texts(v[3]))) for family, *_, v in sorted(_apart(own), key=lambda r: (r[0], r[1]))]
    return out


def _apart(runs: list[list]) -> list[list]:
    """Of overlapping runs of different families those that share most word pairs with a template: a line may stand in the notices of several."""
    kept: list[list] = []
    for run in sorted(runs, key=lambda r: (-r[3], r[1], r[0])):
        at = bisect(kept, run[1], key=lambda r: r[1])
        if (at == 0 or kept[at - 1][2] <= run[1]) and (at == len(kept) or run[2] <= kept[at][1]):
            kept.insert(at, run)
    return kept
