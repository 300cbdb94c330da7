"""License scans: a trained paragraph classifier on DataFrame functions alone.

A line with a marker word (a word of notices that is rare elsewhere) is judged by itself and, as notices are wrapped, with
the lines of its paragraph around it: one before and up to three after, as far as none without a letter or digit comes
between. Both are classed by a sparse logistic regression over their word 1- and 2-grams into licence families or
"unknown". The model is fitted on the driver, from standard notices with words dropped and inserted and with other text
around them, and from a bounded sample of lines of the corpus as examples of "unknown" (``sample_docs`` texts,
``sample_lines`` lines of each, ``sample_words`` words of a line); a temperature fitted on a fifth of the examples that
is held out calibrates its probabilities. A predicted family counts if a standard notice of it confirms it: enough of the
notice's 2-grams must be there.

Only n-grams with a marker word have weights, so text without such a word is "unknown" for certain and one regular
expression sorts it out. Scoring is a projection: no join, no shuffle, no Python on the executors; texts are read whole.

Defined results: null and empty texts have no findings; repeated rows are scanned each; an empty table gives an empty
table, and its model knows standard notices only; a notice of several lines is one finding, at its first line with a
marker that is found.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Standard notices, as their licences word them (fixed values).
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "This software is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Distributed under the GNU General Public License version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Creative Commons Attribution NonCommercial license",
    ],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "public-domain": ["This work has been dedicated to the public domain", "Released into the public domain under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Copyright 2020 Example Inc. All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"],
}
FAMILIES = sorted(NOTICES)
#: A family needs this probability, and this share of a notice's 2-grams in the paragraph.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass
class Model:
    markers: list[str]
    weights: dict[str, list[float]]  # n-gram -> weight of each family, then of unknown
    bias: list[float]
    temperature: float

    def probabilities(self, paragraph: str) -> dict[str, float]:
        """The same as the Column form below, for tests and fitting."""
        z = np.array(self.bias, float)
        for g in grams_of(words_of(paragraph)):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        z = z / self.temperature
        p = np.exp(z - z.max())
        return dict(zip([*FAMILIES, UNKNOWN], (p / p.sum()).tolist(), strict=True))


def fit(unknown: list[str], copies: int = 40, seed: int = 5, sample_words: int = 200) -> Model:
    """A model from the notices and from paragraphs that are no notices, of which the first ``sample_words`` words count."""
    rng = random.Random(seed)
    plain = [words_of(p)[:sample_words] for p in unknown]
    seen = Counter(w for p in plain for w in set(p))
    known = {w for notices in NOTICES.values() for n in notices for w in words_of(n)}
    # Markers: words of notices, of three letters or more, that at most one of 500 other paragraphs has.
    markers = sorted(w for w in known if len(w) >= 2 and not w.isdigit() and seen[w] * 500 <= max(len(plain), 1) and w not in _COMMON)
    marked = set(markers)
    filler = [w for p in plain[:50] for w in p[:20]] or ["lorem", "ipsum", "dolor"]
    examples: list[tuple[set[str], int]] = []
    for k, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            words = words_of(notice)
            for c in range(copies):
                w = [x for x in words if c == 0 or rng.random() > 0.1]
                if c % 3 == 1:
                    at = rng.randrange(len(w) + 1)
                    w = w[:at] + [rng.choice(filler) for _ in range(rng.randrange(1, 6))] + w[at:]
                elif c % 3 == 2:  # in the lines around it
                    w = [rng.choice(filler) for _ in range(rng.randrange(12))] + w + [rng.choice(filler) for _ in range(rng.randrange(30))]
                examples.append((grams_of(w), k))
    others = len(FAMILIES)
    examples += [(grams_of(p), others) for p in plain]
    for _ in range(copies * 15):  # single marker words in other text are no notice
        w = [rng.choice(filler) for _ in range(12)]
        w[rng.randrange(12)] = rng.choice(markers)
        examples.append((grams_of(w), others))
    vocabulary = sorted({g for x, _ in examples for g in x if marked & set(g.split()) and all(w in known for w in g.split())})
    at = {g: k for k, g in enumerate(vocabulary)}
    rng.shuffle(examples)
    x = np.zeros((len(examples), len(at) + 1))
    x[:, -1] = 1
    for k, (grams, _) in enumerate(examples):
        x[k, [at[g] for g in grams if g in at]] = 1
    y = np.eye(others + 1)[[k for _, k in examples]]
    weight = 1.0 / np.maximum(1, y.sum(0))[y.argmax(1)]
    cut = len(x) * 4 // 5
    w = _softmax_regression(x[:cut], y[:cut], weight[:cut] / weight[:cut].sum())
    z, truth = x[cut:] @ w, y[cut:]
    temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=lambda t: -np.log(np.maximum(1e-12, (_softmax(z / t) * truth).sum(1))).mean())
    return Model(markers, {g: w[k].tolist() for g, k in at.items()}, w[-1].tolist(), temperature)


#: Words of notices that are ordinary words too; they may stand in an n-gram with a marker but are none.
_COMMON = frozenset("the this that is are in to of or and any you it under a an not with without may use be all via has been into work public by form code source file files person copy free general following out can met met. example inc project program version terms later other".split())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _softmax_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by gradient steps with momentum."""
    w = np.zeros((x.shape[1], y.shape[1]))
    v = np.zeros_like(w)
    for _ in range(steps):
        g = x.T @ ((_softmax(x @ w) - y) * weight[:, None]) + ridge * w
        v = 0.9 * v - 1.5 * g
        w += v
    return w


def train(docs: DataFrame, sample_docs: int = 400, sample_lines: int = 40, sample_words: int = 200) -> Model:
    """``sample_docs`` texts (by the order of a hash of the id) lend the examples of unknown: ``sample_lines`` lines of each
    at most, and no line that holds most of a notice."""
    some = docs.where("doc_id is not null and text is not null")
    picked = some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # ids alone travel
    rows = some.join(F.broadcast(picked), "doc_id", "left_semi").select(F.slice(F.split("text", "\n"), 1, sample_lines).alias("lines")).collect()
    notices = [_pairs(words_of(n)) for x in NOTICES.values() for n in x]
    lines = sorted(line for r in rows for line in r["lines"])
    return fit([line for line in lines if line and not any(_share(n, line) >= 0.5 for n in notices)], sample_words=sample_words)


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _share(pairs: set[str], line: str) -> float:
    return len(pairs & _pairs(words_of(line))) / max(1, len(pairs))


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with findings: an array of (line, family, probability, share, wrapped) for each licence notice; wrapped: the
    line alone wouldn't do.

    An existing column of that name is replaced. Built-in functions only.
    """
    columns = [c for c in docs.columns if c != "findings"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    marker = "(?i)(?<![a-z0-9])(?:" + "|".join(model.markers) + ")(?![a-z0-9])"
    docs = docs.select(*columns, F.when(text.rlike(marker), F.split(text, "\n")).alias("findings"))
    all_lines = F.col("findings")
    lines = F.filter(F.transform(all_lines, lambda p, k: F.struct(k.alias("line"), p.alias("p"))), lambda x: x["p"].rlike(marker))

    def spans(x: Column) -> Column:
        """The line by itself, and with its neighbours."""
        at = lambda k: F.get(all_lines, x["line"] + k)
        full = lambda y: F.coalesce(y.rlike("[A-Za-z0-9]"), F.lit(False))
        after = F.lit("")
        for k in (3, 2, 1):
            after = F.when(full(at(k)), F.concat_ws(" ", at(k), after)).otherwise("")
        around = F.concat_ws(" ", F.when((x["line"] > 0) & full(at(-1)), at(-1)), x["p"], after)
        return F.array(F.struct(x["line"].alias("line"), x["p"].alias("p"), F.lit(False).alias("wrapped")), F.struct(x["line"].alias("line"), around.alias("p"), F.lit(True).alias("wrapped")))

    lines = F.flatten(F.transform(lines, spans))
    weights = F.create_map(*[c for g, w in sorted(model.weights.items()) for c in (F.lit(g), F.array(*[F.lit(round(v, 6)) for v in w]))])
    start = F.array(*[F.lit(round(v, 6)) for v in model.bias])

    def grams(x: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.lower(x["p"]), "[^a-z0-9]+", " ")), " ")
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(x["line"].alias("line"), x["wrapped"].alias("wrapped"), F.array_distinct(F.concat(words, pairs)).alias("g"))

    def scores(x: Column) -> Column:
        known = F.filter(F.transform(x["g"], lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull())
        z = F.aggregate(known, start, lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
        return F.struct(x["line"].alias("line"), x["wrapped"].alias("wrapped"), x["g"].alias("g"), F.transform(z, lambda v: v / F.lit(model.temperature)).alias("z"))

    def families(x: Column) -> Column:
        top = F.array_max(x["z"])
        p = F.transform(x["z"], lambda v: F.exp(v - top))
        k = F.array_position(x["z"], top)
        return F.struct(x["line"].alias("line"), x["wrapped"].alias("wrapped"), x["g"].alias("g"), F.element_at(F.array(*[F.lit(f) for f in [*FAMILIES, UNKNOWN]]), k.cast("int")).alias("family"), (F.lit(1.0) / F.aggregate(p, F.lit(0.0), lambda s, v: s + v)).alias("probability"))

    def confirmed(x: Column) -> Column:
        share = F.lit(0.0)
        for family in FAMILIES:
            best = F.greatest(F.lit(0.0), *[F.size(F.array_intersect(x["g"], F.array(*[F.lit(g) for g in sorted(_pairs(words_of(n)))]))) / F.lit(float(max(1, len(_pairs(words_of(n)))))) for n in NOTICES[family]])
            share = F.when(x["family"] == family, best).otherwise(share)
        return F.struct(x["line"].alias("line"), x["family"].alias("family"), x["probability"].alias("probability"), share.alias("share"), x["wrapped"].alias("wrapped"))

    found = lines
    for step in (grams, scores, families, confirmed):
        found = F.transform(found, step)
    sure = F.filter(found, lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= LEAST_PROBABILITY) & (x["share"] >= LEAST_SHARE))

    def own(x: Column, y: Column) -> Column:
        """Whether y tells of the same notice as x and goes before it."""
        near = (y["family"] == x["family"]) & (F.abs(y["line"] - x["line"]) <= 4)
        return near & (~y["wrapped"] | (y["line"] < x["line"]))

    # Twice a line's spans make one finding; the array is a document's few notices.
    docs = docs.withColumn("findings", sure)
    once = F.filter("findings", lambda x: ~x["wrapped"] | ~F.exists("findings", lambda y: own(x, y)))
    empty = F.array().cast("array<struct<line:int,family:string,probability:double,share:double,wrapped:boolean>>")
    return docs.select(*columns, F.coalesce(once, empty).alias("findings"))
