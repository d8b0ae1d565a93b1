"""Licence families of paragraphs: a trained n-gram classifier with an unknown class, confirmed against templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import slices, text_of, trim
from tidefold.llm.linear import platt, sigmoid

#: Templates by family: notices and key sentences of public licences (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
FAMILIES = ("unknown", *TEMPLATES)
#: Least similarity (see _similarity) to the family's closest template.
CONFIRM = 0.6
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|\n")


def words_of(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def ngrams(words: list[str]) -> set[str]:
    """Words, pairs and triples."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False))}


@dataclass
class Model:
    """Weights of the templates' n-grams: fixed by the templates' size, not the corpus's."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray
    scale: float
    shift: float


def _similarity(grams: set[str], words: int, templates: list[tuple[set[str], int]]) -> float:
    """To the closest template: Dice, or, for a sentence of more n-grams than the template, the share of the template's that it has."""
    return max(2 * len(grams & t) / (min(len(grams), len(t)) + len(t)) for t, _ in templates) if words else 0.0


_TEMPLATE_GRAMS = {f: [(ngrams(words_of(t)), len(words_of(t))) for t in ts] for f, ts in TEMPLATES.items()}


def _needed(template: str) -> set[str]:
    """Words, long ones first, one of which a sentence must have to be confirmed by the template.

    Without them it shares at most r of the template's t n-grams, so its similarity is at most 2 r / (r + t).
    """
    words = words_of(template)
    grams = ngrams(words)

    def enough(chosen: set[str]) -> bool:
        rest = sum(chosen.isdisjoint(g.split()) for g in grams)
        return 2 * rest < CONFIRM * (rest + len(grams))

    chosen: set[str] = set()
    for w in (order := sorted({*words}, key=lambda w: (-len(w), w))):
        if not enough(chosen):
            chosen.add(w)
    for w in order:
        if enough(chosen - {w}):
            chosen -= {w}
    return chosen


#: What has none of these words can't be confirmed by any template, so it is not scored.
_MARKS = frozenset().union(*(_needed(t) for ts in TEMPLATES.values() for t in ts))


def _marked(text: str) -> bool:
    return not _MARKS.isdisjoint(words_of(text))


def train(docs: DataFrame, text: str = "text", sample: int = 4000, seed: int = 2) -> Model:
    """Fit a softmax regression on noisy copies of the templates and, for the unknown class, on corpus sentences and the
    templates' words in random order.

    The corpus sentences are the `sample` distinct ones with the smallest hash, of all sentences of all texts: a bounded,
    uniform sample in which no source or group of copies counts more than once. Those that a template confirms are no
    unknowns and are left out. A fifth of the examples is kept apart for the calibration of "known" against "unknown".
    Without texts the other unknowns remain. Tasks send at most `sample` sentences each.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, str] = {}
        limit = 1 << 64
        for b in slices(batches, 4 << 20, "text"):
            for t in b.column("text").to_pylist():
                for s in _SENTENCE.split(t):
                    if (h := xxhash.xxh64_intdigest(s)) < limit:
                        found[h] = s
                if len(found) > 4 * sample:
                    found = dict(sorted(found.items())[:sample])
                    limit = max(found) + 1
        rows = sorted(found.items())[:sample]
        yield pa.record_batch([pa.array(np.array([h for h, _ in rows], np.uint64).view(np.int64)), pa.array([" ".join(words_of(s)) for _, s in rows], pa.string())], ["h", "words"])
        trim()

    rng = np.random.default_rng(seed)
    drawn = docs.select(text_of(docs, text).alias("text")).mapInArrow(smallest, "h bigint, words string").distinct()
    rows = drawn.orderBy(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), "words").limit(sample).collect()  # unsigned order
    examples: list[tuple[list[str], int]] = []
    for k, (family, templates) in enumerate(TEMPLATES.items(), 1):
        for t in templates:
            w = words_of(t)
            for _ in range(40):
                v = [x for x in w if rng.random() > 0.08] or w
                if rng.random() < 0.3:
                    at = int(rng.integers(len(v) + 1))
                    v = v[:at] + [f"x{int(rng.integers(1 << 30))}"] + v[at:]
                examples.append((v, k))
                examples.append((list(rng.permutation(w)[: int(rng.integers(1, len(w) + 1))]), 0))
    for r in rows:
        w = r["words"].split()
        if w and all(_similarity(ngrams(w), len(w), ts) < CONFIRM for ts in _TEMPLATE_GRAMS.values()):
            examples.append((w, 0))
    vocabulary = {g: i for i, g in enumerate(sorted({g for ts in _TEMPLATE_GRAMS.values() for t, _ in ts for g in t}))}
    feats = [np.array([vocabulary[g] for g in ngrams(w) if g in vocabulary], np.int64) for w, _ in examples]
    y = np.array([k for _, k in examples])
    held = rng.random(len(y)) < 0.2
    index, row = np.concatenate(feats), np.repeat(np.arange(len(feats)), list(map(len, feats)))
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    width, classes = len(vocabulary), len(FAMILIES)
    w, b = np.zeros((width, classes)), np.zeros(classes)
    use = ~held[row]
    ui, ur = index[use], row[use]
    goal = np.eye(classes)[y] * ~held[:, None]

    def scores() -> np.ndarray:
        return np.stack([np.bincount(row, weights=w[index, c] * norm[row], minlength=len(y)) for c in range(classes)], 1) + b

    for _ in range(120):
        z = scores()
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * ~held[:, None]
        r = (p - goal) * norm[:, None]
        w -= 4.0 * (np.stack([np.bincount(ui, weights=r[ur, c], minlength=width) for c in range(classes)], 1) / max(1, (~held).sum()) * 20 + 1e-5 * w)
        b -= 0.5 * (p - goal).mean(0)
    z = scores()
    margin = z[:, 1:].max(1) - z[:, 0]
    scale, shift = platt(margin[held], (y[held] > 0).astype(float))
    return Model({g: w[i] for g, i in vocabulary.items()}, b, scale, shift)


def classify(sentence: str, model: Model) -> tuple[str, float, float]:
    """(family, calibrated probability that it is no unknown, similarity to the family's closest template)."""
    words = words_of(sentence)
    grams = ngrams(words)
    known = [model.weights[g] for g in grams if g in model.weights]
    z = model.bias + (np.sum(known, 0) / np.sqrt(len(known)) if known else 0)
    k = int(np.argmax(z[1:])) + 1
    family = FAMILIES[k]
    p = float(sigmoid(np.array(model.scale * (z[k] - z[0]) + model.shift)))
    return family, p, _similarity(grams, len(words), _TEMPLATE_GRAMS[family])


def licences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraphs, found): for every whole text its paragraphs (lines with a word) and, for each paragraph with a
    confirmed licence sentence, (paragraph from 0, family, probability, similarity).

    Sentences are classified one by one, so a notice at the head of a long paragraph is found; a paragraph's verdict
    is its most probable sentence. A prediction stands if it is likelier than unknown and its family's closest
    template has a similarity of CONFIRM or more (Dice; of longer sentences, the share of the template they have).
    Sentences without any of the words of which a template needs one can't reach that and are not scored. Of equally
    probable families the first listed counts, of sentences the first. Null and empty texts have no paragraphs; null
    and repeated keys are kept as they come; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, float, float]] = {}
        kinds = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for b in slices(batches, 4 << 20, "text"):
            counts, found = [], []
            for t in b.column("text").to_pylist():
                lines = [x for x in t.split("\n") if _WORD.search(x)]
                hits = []
                if _marked(t):
                    for k, line in enumerate(lines):
                        best = None
                        for s in _SENTENCE.split(line) if _marked(line) else ():
                            if not _marked(s):
                                continue
                            if s not in cache:
                                if len(cache) > 100_000:
                                    cache.clear()
                                cache[s] = classify(s, model)
                            family, p, similar = cache[s]
                            if p >= 0.5 and similar >= CONFIRM and (best is None or p > best["probability"]):
                                best = {"paragraph": k, "family": family, "probability": p, "similarity": similar}
                        if best:
                            hits.append(best)
                counts.append(len(lines))
                found.append(hits)
            yield pa.record_batch([b.column("key"), pa.array(counts, pa.int64()), pa.array(found, kinds)], ["key", "paragraphs", "found"])
        trim()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, paragraphs bigint, found array<struct<paragraph:bigint,family:string,probability:double,similarity:double>>"
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, schema)
