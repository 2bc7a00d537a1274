"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

Lines, and paragraphs of several lines, are judged. The presence of word 1- to
3-grams (by 64-bit hash) goes into a multinomial logistic regression over the
licence families, "unknown" for notices that name any other licence, and
"none". It is trained on the driver from the templates below, varied by a
seeded generator (words dropped, years and holders, text around them, made-up
names for unknown licences), against at most SAMPLE whole lines of the corpus,
of SAMPLE_BYTES together, as "none" (those with the least hash; the bound is
the parameter `sample`). A temperature, set on held-out variants, calibrates
the probabilities. What is a licence by MIN_PROBABILITY but of no family by as
much is put out as "unknown". A finding is confirmed by its templates: the
largest share of a template's word bigrams that the paragraph has.

Texts are scored where they lie, without a shuffle; only lines with features
that carry weight are looked at in full.

A very long line or text is scored whole, in about 60 times its size of memory.

Defined results: null and empty texts have no paragraphs; repeated rows and
repeated lines each give their findings; where two families are equally
probable the first in the list is named; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._common import least_hashed, ship

#: Bits of the filter that passes over n-grams without a weight.
BITS = 16
SAMPLE = 4000
SAMPLE_BYTES = 16 << 20
MIN_PROBABILITY = 0.6
MIN_TEMPLATE = 0.5

# Templates: fixed values, the usual short notices of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software under the terms of the GNU Lesser General Public License",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD license",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain", "This work is in the public domain"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"],
}
#: Everyday sentences that share words with the notices but license nothing: "none".
DECOYS = [
    "You need a driving license to rent a car", "He released the general public version of his work", "The public library is free to use", "The license fee was raised under the new terms",
    "This work is under way and will be released", "The conditions are met and the source is known", "Version 2.0 of the work was released to the public", "All rights to the file are held by the author",
    "A person may copy the file without restriction", "The creative work of the commons is free", "The Apache helicopter was licensed to fly", "He studied at MIT under a general",
]
#: Notices that name a licence which is not listed, with a made-up name in its place: class "unknown".
UNLISTED = [
    "Licensed under the {} License", "Licensed under the {} License, Version 1.0", "Licensed under the {} Public License, version 1.2", "This work is licensed under the {} license", "Released under the {} License 2.0",
    "SPDX-License-Identifier: {}-1.0", "SPDX-License-Identifier: {}", "This program is made available under the terms of the {} Public License 2.0", "Distributed under the {} Software License, Version 1.0", "This file is subject to the {} License agreement",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Use of this software is governed by the {} license terms",
]
# And the listed notices without their own names: only a name tells a family from one that isn't listed.
_NAMES = re.compile(r"MIT|Apache|GNU (?:Lesser )?General|GNU GPL|L?GPL|BSD(?: 3-Clause)?|Mozilla|MPL|CC0|CC BY(?:-[A-Z]{2})?|Creative Commons [\w-]+")
UNLISTED += sorted({_NAMES.sub("{}", x) for texts in TEMPLATES.values() for x in texts if _NAMES.search(x)} - set(UNLISTED))
FAMILIES = list(TEMPLATES)
UNKNOWN = len(FAMILIES)  # the next class; the last one is "none"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and paragraph of every 1- to 3-gram, and the words of each paragraph as n + 1 offsets; here a document is a paragraph."""
    low = _LOWER[data]
    starts, ends, at = t.word_spans(low, offsets, _WORD)
    word = t.span_hash(low, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    h, places, owners = word, [], []
    for n in range(1, 4):
        places.append(t.mix(h + np.uint64(n)))
        owners.append(owner[: len(h)])
        if n < 3:
            inside = owner[n:] == owner[: len(owner) - n] if len(owner) > n else np.zeros(0, bool)
            h = np.where(inside, h[: len(inside)] * np.uint64(t.BASE) + word[n : n + len(inside)], np.uint64(0))
    good = [np.ones(len(places[0]), bool)]
    for n in (1, 2):
        g = np.zeros(len(places[n]), bool)
        m = max(0, len(owner) - n)
        g[:m] = owner[n:] == owner[:m]
        good.append(g[: len(places[n])])
    place = np.concatenate([p[g] for p, g in zip(places, good, strict=True)])
    return place, np.concatenate([o[g] for o, g in zip(owners, good, strict=True)]), at


def _flat(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return t.buffers(pa.array(lines, pa.string()))


def _once(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (paragraph, place) once."""
    if not len(place):
        return place, owner
    wide = np.int64(int(place.max()) + 1)
    both = np.unique(owner * wide + place)
    return both % wide, both // wide


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the n-grams that carry weight
    weights: np.ndarray  # keys by classes; the last class is "none"
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        self.known = np.zeros(1 << BITS, bool)
        self.known[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that paragraphs have, each once."""
        hit = np.flatnonzero(self.known[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[hit]), max(0, len(self.keys) - 1))
        good = self.keys[at] == h[hit] if len(self.keys) else np.zeros(0, bool)
        return _once(at[good], owner[hit[good]])

    def probabilities(self, h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        key, line = self.find(h, owner)
        logits = np.tile(self.bias, (n, 1))
        for c in range(len(self.bias)):
            logits[:, c] += np.bincount(line, self.weights[key, c], n)
        logits /= self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def variants(rng: np.random.Generator, each: int = 24) -> tuple[list[str], list[int]]:
    """Seeded variants of the templates and decoys."""
    lines, classes = [], []
    for c, texts in [*enumerate(TEMPLATES.values()), (UNKNOWN, UNLISTED), (UNKNOWN + 1, DECOYS)]:
        for text in texts:
            for k in range(each):
                name = " ".join("".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 4)))).capitalize() for _ in range(int(rng.integers(1, 3))))
                parts = text.replace("{}", name).split()
                own = [w for w in parts if k == 0 or len(parts) < 6 or rng.random() > 0.06]
                if k % 3 == 1:
                    own = ["Copyright", "(c)", str(int(rng.integers(1990, 2030))), *own]
                if k % 4 == 2:
                    own = [*own, "See", "the", "file", "for", "details"]
                lines.append(" ".join(own))
                classes.append(c)
    return lines, classes


def fit(lines: list[str], classes: list[int], seed: int = 7, steps: int = 200, l2: float = 1e-5) -> Model:
    n, k = len(lines), UNKNOWN + 2
    y = np.array(classes)
    place, owner, _ = ngrams(*_flat(lines))
    # Only what occurs in a notice or decoy can carry weight; the rest of a line says "none" by the bias.
    told = np.unique(ngrams(*_flat(variants(np.random.default_rng(seed))[0]))[0])
    empty = Model(told, np.zeros((len(told), k)), np.zeros(k), 1.0)
    col, owner = empty.find(place, owner)
    held = np.random.default_rng(seed).random(n) < 0.2
    share = np.bincount(y[~held], minlength=k)
    weight = np.where(held, 0.0, 1.0 / np.maximum(share[y], 1)) / k  # classes count alike
    w, b = np.zeros((len(told), k)), np.zeros(k)
    sums = np.full_like(w, 1e-8), np.full_like(b, 1e-8)

    def logits():
        return np.stack([np.bincount(owner, w[col, c], n) for c in range(k)], 1) + b

    for _ in range(steps):
        z = logits()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None]
        gw = np.stack([np.bincount(col, p[owner, c], len(told)) for c in range(k)], 1) + l2 * w
        for x, g, s in ((w, gw, sums[0]), (b, p.sum(0), sums[1])):
            s += g * g
            x -= 0.2 * g / np.sqrt(s)
    z = logits()[held]
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 31):
        q = z / temperature
        q = q - q.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[held]]))
        best = min(best, (loss, float(temperature)))
    heavy = np.abs(w).max(axis=1) >= 0.02
    return Model(told[heavy], w[heavy], b, best[1])


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on the templates' variants and at most `sample` lines of the corpus without a notice's key words."""
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where("length(trim(line)) > 0")
    lines = lines.where(~F.lower("line").rlike(r"licen[sc]|copyright|public domain|all rights reserved"))
    # Whole lines, and of those so many that they come to SAMPLE_BYTES.
    chosen = least_hashed(lines.select("line"), ["line"], sample).withColumn("h", F.xxhash64("line"))
    chosen = chosen.withColumn("sum", F.sum(F.octet_length("line")).over(Window.orderBy("h", "line").rowsBetween(Window.unboundedPreceding, 0)))  # `sample` rows at most
    few = [r[0] for r in chosen.where(F.col("sum") <= SAMPLE_BYTES).orderBy("line").select("line").collect()]
    made, classes = variants(np.random.default_rng(seed))
    return fit(made + few, classes + [UNKNOWN + 1] * len(few), seed)


def _bigrams(text: str) -> set:
    data, offsets = _flat([text])
    low = _LOWER[data]
    starts, ends, _ = t.word_spans(low, offsets, _WORD)
    raw = low.tobytes()
    ws = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return set(zip(ws, ws[1:], strict=False)) or {(w,) for w in ws}


def _findings(data: np.ndarray, bounds: np.ndarray, model: Model, known: dict[str, list[set]], min_probability: float) -> list[tuple[int, str, float, float]]:
    """(paragraph, family, probability, share of the closest template) of the paragraphs that are licences."""
    n = len(bounds) - 1
    place, line, _ = ngrams(data, bounds)
    p = model.probabilities(place, line, n)
    best = p[:, :-1].argmax(1)
    some = np.zeros(n, bool)
    some[line] = True
    out = []
    for i in np.flatnonzero((1 - p[:, -1] >= min_probability) & some).tolist():
        family = FAMILIES[best[i]] if best[i] < UNKNOWN and p[i, best[i]] >= min_probability else "unknown"
        own = _bigrams(data[bounds[i] : bounds[i + 1]].tobytes().decode(errors="replace"))
        templates = known[family] if family in known else [x for every in known.values() for x in every]
        out.append((i, family, float(p[i, best[i]] if family in known else 1 - p[i, -1]), max(len(own & x) / len(x) for x in templates)))
    return out


def scan(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY, min_template: float = MIN_TEMPLATE) -> DataFrame:
    """doc_id, paragraph and last (its first and last line, from 0), family or unknown, probability, template (share of the closest one) and confirmed, of every finding.

    Lines are judged by themselves, and so are all paragraphs of several lines;
    a paragraph that fits a template better than each of its lines stands for them.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of the templates, whatever the corpus
    known = {f: [_bigrams(x) for x in texts] for f, texts in TEMPLATES.items()}
    schema = "doc_id long, paragraph int, last int, family string, probability double, template double, confirmed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            n = rows.num_rows
            # Lines of all documents, one after the other, and the paragraphs between blank ones.
            feeds = np.flatnonzero(data == 10)
            starts = np.concatenate([offsets[:-1], feeds + 1])
            owner = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])
            by = np.lexsort((starts, owner))
            starts, owner = starts[by], owner[by]
            bounds = np.append(starts, len(data))
            words = np.concatenate([[0], np.cumsum(t.NOT_SPACE[data])])
            blank = words[bounds[1:]] == words[bounds[:-1]]
            first_line = np.searchsorted(owner, np.arange(n))
            begins = np.ones(len(starts), bool)
            begins[1:] = (owner[1:] != owner[:-1]) | blank[:-1]
            head = np.flatnonzero(begins)
            tail = np.append(head[1:], len(starts)) - 1
            found = [(i, i, *x) for i, *x in _findings(data, bounds, shared.value, known, min_probability)]
            lines = {i: x for i, _, *x in found}
            several = tail - head - blank[tail] > 0
            for k, *x in _findings(data, np.append(starts[head], len(data)), shared.value, known, min_probability):
                if several[k]:
                    a, b = int(head[k]), int(tail[k] - blank[tail[k]])
                    mine = [lines[i] for i in range(a, b + 1) if i in lines]
                    if x[2] > max((y[2] for y in mine), default=-1.0) and (x[0] != "unknown" or not mine):
                        found = [y for y in found if not a <= y[0] <= b] + [(a, b, *x)]
            found.sort(key=lambda x: x[0])
            first = np.array([x[0] for x in found], np.int64)
            last = np.array([x[1] for x in found], np.int64)
            own = owner[first] if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(own, pa.int64())),
                    pa.array((first - first_line[own]).astype(np.int32)),
                    pa.array((last - first_line[own]).astype(np.int32)),
                    pa.array([x[2] for x in found], pa.string()),
                    pa.array([x[3] for x in found], pa.float64()),
                    pa.array([x[4] for x in found], pa.float64()),
                    pa.array([x[4] >= min_template and x[2] != "unknown" for x in found], pa.bool_()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)
