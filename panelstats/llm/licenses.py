"""Licence statements in documents: comparison with templates, and a trained paragraph classifier for what resembles none closely.

The classifier is a multinomial logistic regression over the word n-grams that templates hold, with a class for windows that state no licence. It is fitted on
varied copies of the templates and on every window of every text of the corpus that states none by a template: a Spark job counts the windows of each set of n-grams, and
``LogisticRegression`` is fitted to the sets, weighted by these counts. A first fit, on three quarters of the templates and sets, sets the temperature by those it never saw.
The highest window of the whole corpus sets the probability from which a paragraph counts; so that unknown licences in the corpus itself don't hide each other, it is no higher than what half
of the copies of the templates kept aside reach in the first model. Every window of every text goes through the model. Where a template of
the family that it names is found, the statement is confirmed; what it passes and no template confirms is returned as unknown.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import discard, map_arrow, slices, stage, utf8

# Customary titles, short notices and sentences of the texts of well-known licences.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "GNU Affero General Public License", "Affero GPL", "Licensed under AGPL", "Licensed under the AGPL", "AGPL License", "AGPLv3", "AGPL-3.0", "AGPL 3"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
               "Apache License", "Apache Licence", "Apache Software License", "Apache-2.0", "License: Apache", "Licensed under Apache",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"],
    "bsd": ["Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "BSD License", "BSD Licence", "BSD 2-Clause", "BSD 3-Clause", "3-clause BSD", "2-clause BSD", "BSD-style license", "License: BSD", "Licensed under BSD", "New BSD", "Simplified BSD",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "CC BY 4.0", "CC BY 3.0", "CC BY 2.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC 2.0", "Creative Commons Attribution-NonCommercial License", "Attribution-NonCommercial 4.0", "Attribution-NonCommercial 3.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA 2.0", "Creative Commons Attribution-ShareAlike License", "Attribution-ShareAlike 4.0", "Attribution-ShareAlike 3.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "CC0 1.0", "Creative Commons Zero", "CC0",
            "has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "GNU General Public License", "GNU GPL", "GPL License", "License: GPL", "Licensed under GPL", "Licensed under the GPL", "GPL version 2", "GPL version 3", "GPL-2.0", "GPL-3.0", "GPL v2", "GPL v3", "GPLv2", "GPLv3"],
    "isc": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "ISC License", "ISC Licence", "License: ISC", "Licensed under ISC",
            "Provided that the above copyright notice and this permission notice appear in all copies.",
            "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL License", "License: LGPL", "Licensed under LGPL", "Licensed under the LGPL",
             "LGPL version 2", "LGPL version 3", "LGPL-2.1", "LGPL-2.0", "LGPL-3.0", "LGPL v2", "LGPL v3", "LGPLv2", "LGPLv3"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "MIT License", "MIT Licence", "MIT licensed", "License: MIT", "Licensed under MIT", "Released under MIT", "Expat License",
            "Including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
            "Mozilla Public License", "MPL-2.0", "MPL-1.1", "MPL 2", "License: MPL", "Licensed under MPL",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.",
                  "The Unlicense", "License: Unlicense", "Licensed under Unlicense",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Family of a statement that resembles no template.
UNKNOWN = "unknown"
#: SPDX identifiers by their beginning; the first that fits counts.
SPDX = {"agpl-": "agpl", "apache-": "apache", "bsd-": "bsd", "0bsd": "bsd", "cc-by-nc-sa-": None, "cc-by-nc-nd-": None, "cc-by-nc-": "cc-by-nc", "cc-by-nd-": None, "cc-by-sa-": "cc-by-sa", "cc-by-": "cc-by",
        "cc0-": "cc0", "gpl-": "gpl", "isc": "isc", "lgpl-": "lgpl", "mit": "mit", "mpl-": "mpl", "unlicense": "unlicense"}

#: Places in the list of filler words.
FILLER = 5000
#: L2 penalty, and rounds over the corpus's windows at most, of a fit.
PENALTY, ROUNDS = 1e-5, 40
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
VARIANTS = 120
BITS = 17
NGRAMS = 3
_SHIFT = np.uint64(64 - BITS)
#: How far, in log odds, a statement that no template confirms has to lie above all windows of the corpus without a template,
MARGIN = 1.5
#: unless those reach further than half of the templates' variants do in a model that never saw their templates.
PASSED = 0.5
#: One of so many templates of a family, and of sets of the corpus's n-grams, is kept from the first model, which sets the temperature.
ASIDE = 4
#: Least share of a template's word pairs that a confirmed statement holds.
ALIKE = 0.7
#: Templates of at most so many word pairs have to be held whole.
WHOLE = 5
#: Longer blocks are read in windows of so many words, each half over the one before.
WINDOW = 40
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?;]\s")
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier):[ \t(]*({_ID}(?:[ \t)]*[ \t](?:AND|OR|WITH)[ \t]+[ \t(]*{_ID})*)")
_SPDX_ID = re.compile(rf"(WITH[ \t]+)?({_ID})")
_PAIR = np.uint64(0xBF58476D1CE4E5B9)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = _hash(word)
        return value


def _gram_values(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each word."""
    value = words
    for k in range(1, n):
        value = value[:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[k:]
    return (value ^ value >> np.uint64(31)) * np.uint64(0x94D049BB133111EB + 2 * n)


class _Grams:
    """The word n-grams of all templates, numbered."""

    def __init__(self):
        known, every = _Words(), [_words(t) for texts in TEMPLATES.values() for t in texts]
        coded = [np.array([known[w] for w in words], np.uint64) for words in every]
        self.keys = np.unique(np.concatenate([_gram_values(c, n) for c in coded for n in range(1, NGRAMS + 1) if len(c) >= n]))
        self.marked = np.zeros(1 << BITS, bool)
        self.marked[self.keys >> _SHIFT] = True
        #: templates by the numbers of their word pairs, or of their only word
        self.pairs = [np.unique(np.searchsorted(self.keys, _gram_values(c, min(2, len(c))))) for c in coded]
        of = sorted((int(g), t) for t, pairs in enumerate(self.pairs) for g in pairs)
        self.owned, self.owner = np.array([g for g, _ in of]), np.array([t for _, t in of])
        size = np.array([len(pairs) for pairs in self.pairs])
        self.need = np.where(size <= WHOLE, size, np.ceil(ALIKE / 2 * size))

    def find(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number) of the n-grams of a run of words that a template holds."""
        values = _gram_values(words, n)
        place = np.flatnonzero(self.marked[values >> _SHIFT])
        at = np.minimum(np.searchsorted(self.keys, values[place]), len(self.keys) - 1)
        same = self.keys[at] == values[place]
        return place[same], at[same]

    def alike(self, number: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` windows with these distinct n-grams, those that hold all pairs of a short template or half of ``ALIKE`` of a longer one's."""
        low, high = np.searchsorted(self.owned, number), np.searchsorted(self.owned, number, "right")
        many = high - low
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        case, held = np.unique(np.repeat(owner, many) * len(self.need) + self.owner[at], return_counts=True)
        out = np.zeros(n, bool)
        out[case[held >= self.need[case % len(self.need)]] // len(self.need)] = True
        return out


@functools.cache
def _grams() -> _Grams:
    return _Grams()


def _features(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, paragraph) of every word n-gram that a template holds; n-grams don't leave their paragraph."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    numbers, owners = [], []
    for n in range(1, min(NGRAMS, len(words)) + 1):
        place, number = _grams().find(words, n)
        same = owner[place] == owner[place + n - 1]
        numbers.append(number[same])
        owners.append(owner[place[same]])
    return np.concatenate(numbers or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def _distinct(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once a paragraph, paragraphs in order."""
    pairs = np.unique(owner << 32 | numbers)
    return pairs & (1 << 32) - 1, pairs >> 32


def _coded(paragraphs: list[list[str]], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([known[w] for p in paragraphs for w in p], np.uint64)
    return words, np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])]).astype(np.int64)


def _words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:])) or {tuple(words)}


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    have = _pairs(words)
    return max(len(have & t) / len(t) for t in _TEMPLATE_PAIRS[family])


_TEMPLATE_PAIRS = {family: [_pairs(_words(t)) for t in texts] for family, texts in TEMPLATES.items()}


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # n-grams of the templates x (families + unknown)
    bias: np.ndarray
    temperature: float = 1.0
    #: Probability from which a paragraph counts, and from which it counts though no template confirms it.
    threshold: float = 0.5
    sure: float = 0.5

    def probabilities(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.judged(*_distinct(*_features(words, bounds)), len(bounds) - 1)

    def judged(self, number: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` paragraphs with these distinct n-grams."""
        logits = np.stack([np.bincount(owner, self.weights[number, k], n) for k in range(len(self.bias))], 1) if len(owner) else np.zeros((n, len(self.bias)))
        return self.softmax(logits, np.bincount(owner, minlength=n))

    def softmax(self, logits: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities from the summed weights of so many distinct n-grams."""
        logits = (logits / np.sqrt(np.maximum(size, 1))[:, None] + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(1, keepdims=True)


def _varied(rng: np.random.Generator, words: list[str], filler: list[str]) -> list[str]:
    """A template with some words lost, if it is not a title, and some of the corpus around it."""
    kept = words if len(words) <= WHOLE + 1 else [w for w in words if rng.random() > 0.06]
    around = lambda: [filler[k] for k in rng.integers(0, len(filler), rng.integers(0, 13))] if filler and rng.random() < 0.6 else []
    return around() + kept + around()


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the lines of a text that are not blank."""
    found, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            found.append((at, at + len(line)))
        at += len(line) + 1
    return found


def _seen(docs: DataFrame, text_col: str) -> DataFrame:
    """grams, n, words: every set of template n-grams that a window of any text holds, its windows and their words; windows that touch a statement or look like a template are left out."""

    def work(batches):
        known, matcher = _Words(), _Matcher()
        tag = [np.uint64(known[w]) for w in ("spdx", "license", "identifier")]
        for batch in slices(batches, text_col, 1 << 20):
            words, bounds, _, _, _, heads, sizes = _laid_out([_lower(t) for t in utf8(batch.column(0)).to_pylist()], known)
            stated = np.zeros(len(words) + 1, np.int64)
            for _, start, stop, _, _ in matcher.runs(words, bounds, *matcher.pairs(words, bounds)):
                stated[start + 1:stop + 1] = 1
            for at in np.flatnonzero((words[:-2] == tag[0]) & (words[1:-1] == tag[1]) & (words[2:] == tag[2])).tolist():
                stated[at + 1:at + 4] = 1
            before = np.cumsum(stated)  # words of statements before each word
            free = before[heads + sizes] == before[heads]
            heads, sizes, scorer = heads[free], sizes[free], _Scorer(None, words)
            for k in range(0, len(heads), 16384):
                size = sizes[k:k + 16384]
                number, window = _distinct(*scorer.held(heads[k:k + 16384], size))
                plain = ~_grams().alike(number, window, len(size))
                number, many = number[plain[window]], np.bincount(window, minlength=len(size))[plain]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(number, pa.int32())), pa.array(size[plain], pa.int64())],
                                                 names=["grams", "words"])

    return map_arrow(docs.select(text_col), work, "grams array<int>, words bigint").groupBy("grams").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


def _filler(seen: DataFrame) -> list[str]:
    """Words as frequent as in the windows of the corpus, in FILLER places; one that no template holds stands for all others."""
    grams, known = _grams(), _Words()
    number = {int(_grams().find(np.array([known[w]], np.uint64), 1)[1][0]): w for texts in TEMPLATES.values() for t in texts for w in _words(t)}
    total = seen.agg(F.sum("words")).first()[0] or 0
    if not total:
        return []
    counts = {number[r.g]: r.n for r in seen.select(F.explode("grams").alias("g"), "n").where(F.col("g").isin(*number)).groupBy("g").agg(F.sum("n").alias("n")).collect()}
    return [w for w in sorted(counts) for _ in range(round(FILLER * counts[w] / total))] + ["\x00"] * max(1, round(FILLER * (1 - sum(counts.values()) / total)))


def fit(docs: DataFrame, text_col: str = "text", seed: int = 11) -> Model:
    """The classifier for a corpus, of all windows of all its texts. An empty corpus gives a model fitted on the templates alone."""
    spark, families, rng = docs.sparkSession, sorted(TEMPLATES), np.random.default_rng(seed)
    seen = stage(_seen(docs, text_col), "licence-windows")
    filler = _filler(seen)
    rows, aside = [], []
    for k, f in enumerate(families):
        for j, t in enumerate(TEMPLATES[f]):
            rows += [(k, _varied(rng, _words(t), filler)) for _ in range(VARIANTS)]
            aside += [j % ASIDE == ASIDE - 1] * VARIANTS
    label, held = np.array([k for k, _ in rows]), np.flatnonzero(aside)
    number, owner = _distinct(*_features(*_coded([w for _, w in rows], _Words())))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
    variants = spark.createDataFrame(pa.table({"grams": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number, pa.int32())), "label": pa.array(label, pa.float64()), "aside": pa.array(aside)}))
    empty = spark.createDataFrame([([], 1, False)], "grams array<int>, n bigint, aside boolean")  # a window without any of the n-grams states no licence, whatever the corpus
    apart = F.pmod(F.xxhash64("grams"), F.lit(ASIDE)) == 0
    plain = seen.select("grams", "n", apart.alias("aside")).union(empty).withColumn("label", F.lit(float(len(families))))
    size = F.size("grams")
    features = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(_grams().keys)).alias("size"), F.col("grams").alias("indices"),
                        F.array_repeat(1 / F.sqrt(F.greatest(size, F.lit(1))), size).alias("values")).alias("features")
    staged = stage(plain.unionByName(variants.withColumn("n", F.lit(1).cast("bigint"))).select("label", "aside", "n", features), "licence-fit")
    examples = spark.read.schema(StructType([StructField("label", DoubleType()), StructField("aside", BooleanType()), StructField("n", LongType()), StructField("features", VectorUDT())])).parquet(staged._llm_path)
    trial, model = _train(examples.where("not aside"), families), _train(examples, families)

    def unseen(t: float) -> np.ndarray:
        """Of the first model, probabilities of the templates kept aside."""
        trial.temperature = t
        return trial.probabilities(*_coded([rows[k][1] for k in held], _Words()))

    sums = _none(seen.where(apart), trial).agg(F.sum("n"), *(F.sum(F.col("n") * F.col("none")[k]) for k in range(len(TEMPERATURES)))).first()
    loss = [-np.log(np.maximum(unseen(t)[np.arange(len(held)), label[held]], 1e-12)).mean() - (sums[1 + k] or 0) / max(1, sums[0] or 0) for k, t in enumerate(TEMPERATURES)]
    best = int(np.argmin(loss))
    model.temperature = TEMPERATURES[best]
    highest = _none(seen, model).agg(F.min(F.col("none")[best])).first()[0]
    discard(seen, staged)
    if highest is not None:
        other = np.clip(unseen(model.temperature)[:, -1], 1e-9, 1 - 1e-9)
        level, usual = np.log(np.expm1(-min(highest, -1e-9))), np.quantile(np.log((1 - other) / other), PASSED)
        model.threshold, model.sure = (max(0.5, float(1 / (1 + np.exp(-min(level + more, usual))))) for more in (0.0, MARGIN))
    return model


def _none(seen: DataFrame, model: Model) -> DataFrame:
    """n and none: windows of each set of n-grams, and the logarithm of its probability to state no licence at each of ``TEMPERATURES``."""

    def work(batches):
        for batch in batches:
            held = batch.column(0)
            owner = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            number, out = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.zeros((len(held), len(TEMPERATURES)))
            for k, t in enumerate(TEMPERATURES):
                out[:, k] = np.log(np.maximum(replace(model, temperature=t).judged(number, owner, len(held))[:, -1], 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * len(TEMPERATURES), pa.int32()), pa.array(out.ravel()))], names=["n", "none"])

    return map_arrow(seen.select("grams", "n"), work, "n bigint, none array<double>")


def _train(examples: DataFrame, families: list[str]) -> Model:
    """Multinomial logistic regression; the windows of the corpus weigh together as much as the variants of the templates."""
    plain = F.col("label") == len(families)
    total = {r.plain: r.n for r in examples.groupBy(plain.alias("plain")).agg(F.sum("n").alias("n")).collect()}
    weighted = examples.withColumn("weight", F.when(plain, F.col("n") * (total[False] / total.get(True, 1))).otherwise(1.0))
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=PENALTY, standardization=False, maxIter=ROUNDS).fit(weighted)
    return Model(families, fitted.coefficientMatrix.toArray().T.copy(), fitted.interceptVector.toArray())


class _Scorer:
    """Probabilities of windows of a run of words, whose n-grams are hashed once however many windows hold them."""

    def __init__(self, model: Model | None, words: np.ndarray):
        self.model, self.grams = model, []
        for n in range(1, min(NGRAMS, len(words)) + 1):
            place, number = _grams().find(words, n)
            order = np.lexsort((place, number))
            before = np.full(len(place), -1, np.int64)  # the last place of the same n-gram
            same = np.flatnonzero(number[order][1:] == number[order][:-1])
            before[order[same + 1]] = place[order[same]]
            self.grams.append((n, place, number, before))

    def windows(self, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(heads), len(self.model.bias)))
        for k in range(0, len(heads), 16384):
            number, window = self.held(heads[k:k + 16384], sizes[k:k + 16384])
            out[k:k + 16384] = self.model.judged(number, window, len(out[k:k + 16384]))
        return out

    def held(self, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, window) of the distinct n-grams of some windows."""
        numbers, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, place, number, before in self.grams:
            low, high = np.searchsorted(place, heads), np.searchsorted(place, heads + sizes - n, "right")
            many = np.maximum(high - low, 0)
            window = np.repeat(np.arange(len(heads)), many)
            at = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + low[window]
            first = before[at] < heads[window]
            numbers.append(number[at[first]])
            windows.append(window[first])
        return np.concatenate(numbers), np.concatenate(windows)


class _Matcher:
    """Runs of words that hold enough of a template's word pairs."""

    def __init__(self):
        known = _Words()
        pair = lambda p: int((np.array([known[p[0]]], np.uint64) * _PAIR + np.uint64(known[p[1]]))[0])
        every = [(family, _words(t)) for family in sorted(TEMPLATES) for t in TEMPLATES[family]]
        self.names = {known[words[0]]: family for family, words in every if len(words) == 1}
        self.templates = [(family, words) for family, words in every if len(words) > 1]
        held = [{pair(p) for p in _pairs(words)} for _, words in self.templates]
        of: dict[int, set[str]] = {}
        for (family, _), pairs in zip(self.templates, held):
            for h in pairs:
                of.setdefault(h, set()).add(family)
        #: pairs that no other family's templates hold; a run has most of them
        self.own = [{h for h in pairs if len(of[h]) == 1} for pairs in held]
        self.size = np.array([len(pairs) for pairs in held])
        self.need = np.array([n if n <= WHOLE else int(np.ceil(ALIKE * n)) for n in self.size])
        self.span = [len(words) + len(words) // 2 for _, words in self.templates]
        rows = sorted((h, k) for k, pairs in enumerate(held) for h in pairs)
        self.keys, self.first, self.count = np.unique(np.array([h for h, _ in rows], np.uint64), return_index=True, return_counts=True)
        self.owner = np.array([k for _, k in rows], np.int64)

    def pairs(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of neighbours; where those of templates are, in which block, and which they are."""
        pairs = words[:-1] * _PAIR + words[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == pairs)
        block = np.searchsorted(bounds, place, "right") - 1
        inside = place + 1 < bounds[block + 1]
        return pairs, place[inside], block[inside], at[place[inside]]

    def runs(self, words: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, place: np.ndarray, block: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int, str, float]]:
        """(block, first word, word after the last, family, share of the template), runs of one family that meet being one."""
        if not len(words):
            return []
        more = self.count[key]
        row = np.repeat(np.arange(len(place)), more)
        template = self.owner[self.first[key[row]] + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)]
        case = block[row] * len(self.size) + template
        order = np.lexsort((place[row], case))
        case, row = case[order], row[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(case)) + 1, [len(case)]]) if len(case) else np.zeros(1, np.int64)
        found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
        for a, b in zip(cuts[:-1], cuts[1:]):
            b_, k = divmod(int(case[a]), len(self.size))
            if b - a < self.need[k]:
                continue
            spots = place[row[a:b]]
            found.setdefault((b_, self.templates[k][0]), []).extend(self._within(k, spots.tolist(), pairs[spots].tolist()))
        for j in np.flatnonzero(np.isin(words, np.array(list(self.names), np.uint64))).tolist():
            found.setdefault((int(np.searchsorted(bounds, j, "right")) - 1, self.names[int(words[j])]), []).append((j, j + 1, 1.0))
        out = []
        for (b_, family), hits in sorted(found.items()):
            merged: list[list] = []
            for start, stop, share in sorted(hits):
                if merged and start < merged[-1][1]:
                    merged[-1][1:] = max(stop, merged[-1][1]), max(share, merged[-1][2])
                else:
                    merged.append([start, stop, share])
            out += [(b_, start, stop, family, share) for start, stop, share in merged]
        return out

    def _within(self, k: int, spots: list[int], pairs: list[int]) -> list[tuple[int, int, float]]:
        """Runs of one template in one block, left to right; each grows while new pairs of the template follow."""
        out, left, j, held = [], 0, 0, {}
        while j < len(spots):
            while left < j and spots[j] + 2 - spots[left] > self.span[k]:
                held[pairs[left]] -= 1
                held = held if held[pairs[left]] else {h: n for h, n in held.items() if n}
                left += 1
            held[pairs[j]] = held.get(pairs[j], 0) + 1
            j += 1
            if len(held) < self.need[k] or 2 * len(self.own[k] & held.keys()) <= len(self.own[k]):
                continue
            ahead = j
            while ahead < len(spots) and spots[ahead] + 2 - spots[left] <= self.span[k]:
                if pairs[ahead] not in held:
                    held |= {h: held.get(h, 0) + 1 for h in pairs[j:ahead + 1]}
                    j = ahead + 1
                ahead += 1
            while held[pairs[left]] > 1:
                held[pairs[left]] -= 1
                left += 1
            out.append((spots[left], spots[j - 1] + 2, len(held) / int(self.size[k])))
            left, held = j, {}
        return out


def _lower(text: str) -> str:
    """In lower case, every character keeping its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def _bounds(text: str, first: int, last: int, spans: list[tuple[int, int]]) -> tuple[int, int]:
    """Characters of some words with the marks that touch them."""
    a, b = spans[first][0], spans[last - 1][1]
    low, high = spans[first - 1][1] if first else 0, spans[last][0] if last < len(spans) else len(text)
    while a > low and not text[a - 1].isspace():
        a -= 1
    while b < high and not text[b].isspace():
        b += 1
    return a, b


def _identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, family) of the identifiers in SPDX expressions; exceptions after WITH are none."""
    found = []
    for line in _SPDX.finditer(text):
        for name in _SPDX_ID.finditer(text, *line.span(1)):
            low = name[2].lower()
            if not name[1] and name[2] not in ("AND", "OR", "WITH"):
                family = next((f for head, f in SPDX.items() if low.startswith(head)), None)
                found.append((*name.span(2), family or UNKNOWN))
    return found


def _windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which part, first word, number of words) of the windows of parts of a text."""
    count = np.where(sizes > 0, -(-np.maximum(1, sizes - WINDOW // 2) // (WINDOW // 2)), 0)
    part = np.repeat(np.arange(len(starts)), count)
    shift = (np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)) * (WINDOW // 2)
    return part, starts[part] + shift, np.minimum(sizes[part] - shift, WINDOW)


def _laid_out(lows: list[str], known: _Words) -> tuple[np.ndarray, ...]:
    """Words of some texts; bounds and text of each block; first word of each text; block, first word and size of each window, of lines and of blocks of several."""
    parts, block, row = [], [], []  # of each line
    for k, low in enumerate(lows):
        block.append(block[-1] + 1 if block else 0)
        parts.append([])
        row.append(k)
        for line in low.split("\n"):
            found = _WORD.findall(line)
            block.append(block[-1] + (not found and not line.strip()))
            parts.append(found)
            row.append(k)
    words, lines = _coded(parts, known)
    block, row = np.array(block, np.int64), np.array(row, np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))  # first line of each block
    bounds = np.append(lines[first], len(words))
    base = lines[np.searchsorted(row, np.arange(len(lows)))]
    several = np.flatnonzero(np.add.reduceat(np.diff(lines) > 0, first) > 1) if len(first) else first
    starts = np.concatenate([lines[:-1], bounds[several]])
    part, heads, sizes = _windows(starts, np.concatenate([np.diff(lines), np.diff(bounds)[several]]))
    in_block = np.concatenate([block, several])[part] if len(part) else part
    return words, bounds, row[first], base, in_block, heads, sizes


def _unknown(text: str, spans: list[tuple[int, int]], known: list[tuple[int, int]], passed: list[tuple[int, int, int, float]], judge) -> list[tuple[int, int, int, float]]:
    """(block, first word, word after the last, probability) of what passes and no template confirms, runs that meet being one.

    Words of a confirmed statement's sentence, up to a window's length from it, are left out; what then remains of a window is judged again.
    """
    ends = [bool(_END.search(text[a[1]:b[0]])) for a, b in zip(spans, spans[1:])] if known else []
    taken = np.zeros(len(spans), bool)
    for start, stop in known:
        a, b = start, stop
        while a > max(0, start - WINDOW) and not ends[a - 1]:
            a -= 1
        while b < min(len(spans), stop + WINDOW) and not ends[b - 1]:
            b += 1
        taken[a:b] = True
    found: list[list] = []
    for block, start, stop, p in sorted(passed):
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken[start:stop], [True]]).astype(np.int8))).tolist()
        for a, b in zip(edge[::2], edge[1::2]):
            share = p if b - a == stop - start else judge(start + a, start + b)
            if share is None:
                continue
            if found and found[-1][0] == block and start + a <= found[-1][2]:
                found[-1][2:] = max(found[-1][2], start + b), max(found[-1][3], share)
            else:
                found.append([block, start + a, start + b, share])
    return found


def _named(model: Model, hits: list[tuple[int, int, str, float]], p: np.ndarray) -> list[tuple[int, int, str, float, float]]:
    """Statements that the classifier names, each with the probability of its family; a run whose templates are not the named family's, and not held whole either, is of no known family."""
    out = []
    for (a, b, family, share), q in zip(hits, p):
        if family != UNKNOWN and share < 1 and model.families[int(q[:-1].argmax())] != family:
            family = UNKNOWN
        out.append((a, b, family, share, float(q[model.families.index(family)] if family != UNKNOWN else 1 - q[-1])))
    return out


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence statement: doc_id, paragraph (the line it starts in, from 0, blank lines not counted), start and stop (characters), family, probability, similarity.

    Whole texts are read, block by block: blank lines end a block, single line breaks do not. A text has as many rows as statements; statements of several families may
    overlap, and those of one family that overlap are one. Every window is judged and every family compared; the probability is that of the statement's own words. What the classifier takes
    for a licence and no template confirms has family 'unknown', the probability that it is any licence, and the largest share of a template that it holds, which may be none; so have
    identifiers of other licences in SPDX lines. Null, empty and blank texts have no blocks; null and repeated ids are kept; other columns are not read.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def work(batches):
        m, known, matcher = shared.value, _Words(), _Matcher()
        for batch in slices(batches, text_col, 1 << 20):
            texts = utf8(batch.column(1)).to_pylist()
            lows = [_lower(t) for t in texts]
            words, bounds, owner, base, in_block, heads, sizes = _laid_out(lows, known)
            near = matcher.pairs(words, bounds)
            judged = _Scorer(m, words).windows
            any_licence = 1 - judged(heads, sizes)[:, -1]
            passed: dict[int, list] = {}
            for j in np.flatnonzero(any_licence >= m.sure).tolist():
                k = int(owner[in_block[j]])
                passed.setdefault(k, []).append((int(in_block[j]), int(heads[j] - base[k]), int(heads[j] + sizes[j] - base[k]), float(any_licence[j])))
            stated: dict[int, list] = {}
            for b, start, stop, family, share in matcher.runs(words, bounds, *near):
                k = int(owner[b])
                stated.setdefault(k, []).append((start - int(base[k]), stop - int(base[k]), family, share))
            tagged = {k for k, low in enumerate(lows) if "spdx-license-identifier" in low}
            rows = []
            for k in sorted({*passed, *stated, *tagged}):
                spans, heads_of = [x.span() for x in _WORD.finditer(lows[k])], [a for a, _ in paragraphs(texts[k])]
                hits = stated.get(k, [])
                for a, b, family in _identifiers(texts[k]) if k in tagged else ():
                    a, b = bisect_left(spans, (a, 0)), bisect_left(spans, (b, 0))
                    if not any(f == family and x < b and y > a for x, y, f, _ in hits):
                        hits.append((a, b, family, 1.0 if family != UNKNOWN else 0.0))
                if hits:
                    p = judged(np.array([h[0] for h in hits]) + base[k], np.array([h[1] - h[0] for h in hits]))
                    out = _named(m, hits, p)
                else:
                    out = []

                def again(a, b):
                    p = 1 - float(judged(np.array([a + base[k]]), np.array([b - a]))[0, -1])
                    return p if p >= m.sure else None

                for _, a, b, p in _unknown(texts[k], spans, [h[:2] for h in hits], passed.get(k, []), again):
                    own = [lows[k][x:y] for x, y in spans[a:b]]
                    out.append((a, b, UNKNOWN, max(similarity(own, f) for f in TEMPLATES), p))
                for a, b, family, share, p in sorted(out):
                    a, b = _bounds(texts[k], a, b, spans)
                    rows.append((k, bisect_right(heads_of, a) - 1, a, b, family, p, share))
            column = lambda c, t: pa.array([r[c] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(column(0, pa.int64())), column(1, pa.int32()), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.string()), column(5, pa.float64()), column(6, pa.float64())],
                names=["doc_id", "paragraph", "start", "stop", "family", "probability", "similarity"])

    return map_arrow(docs.select(id_col, text_col), work, f"doc_id {kind}, paragraph int, start bigint, stop bigint, family string, probability double, similarity double")
