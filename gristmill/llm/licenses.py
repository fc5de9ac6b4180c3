"""License scan by a trained paragraph classifier (operator 3).

A sparse softmax regression over hashed word 1- and 2-grams gives stretches of a paragraph a licence
family, `unknown` (a licence of no family here) or `none`.  Paragraphs are cut at blank lines, so a wrapped notice is
seen whole; one of more than WINDOW words is judged by its windows of so many words, half overlapping.
The classes are trained here, on perturbed template notices, on notices whose telling words are replaced (`unknown`), and on
other paragraphs; the temperature is calibrated on a held-out part, and a stretch whose chance of a licence stays
under `least` is none.  A predicted family is confirmed by the family's templates, the share of a template's word 3-grams that
stand around the stretch; templates never name a family that was not predicted.  A paragraph with a likely licence and
no confirmed family is `unknown`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrays import let
from gristmill.llm._spark import batches, tidy
from gristmill.llm._text import ALNUM, LOWER, NOT_SPACE, U64, chunks, hash_spans, roll, spans

# Short public licence notices by family.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS."],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# Sentences that speak of licences without giving one.
OTHER = [
    "The license of this work is not known.", "All rights reserved.", "She has a driving license and a public office.", "He is under the table.", "Version 2.0 of the game was released under the old name.", "Please see the license file for the terms and conditions of use.",
    "The software is free of charge for students.", "A person may obtain a copy of this file at the office.", "The general public was not admitted.", "This work is under construction, version 3.", "The following conditions are met with a smile.", "International law is common and creative work is permitted.",
]
FAMILIES = ["none", "unknown", *sorted(TEMPLATES)]
DIM_BITS = 20
WINDOW = 20


def _paragraphs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the paragraphs of all texts, and each text's number of them. Blank lines end a paragraph and belong to it."""
    cut = np.flatnonzero(data == 10) + 1
    line = np.sort(np.concatenate([cut, offs[:-1]]))
    running = np.concatenate([[0], np.cumsum(data == 10)])
    n = running[offs[1:]] - running[offs[:-1]] + 1
    said = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    blank = said[np.append(line[1:], offs[-1])] == said[line]
    start = np.zeros(len(line), bool)
    start[1:] = ~blank[1:] & blank[:-1]
    start[np.cumsum(n) - n] = True
    return np.append(line[start], offs[-1]), np.add.reduceat(start.astype(np.int64), np.cumsum(n) - n)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and first words of each paragraph; hashed 1- and 2-gram features and the paragraph of each."""
    data = LOWER[data]
    s, e, first = spans(data, offs, ALNUM)
    h = hash_spans(data, s, e)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    two = roll(h, 2)
    inside = of[1:] == of[:-1]
    return h, first, (np.concatenate([h, two[inside]]) >> U64(64 - DIM_BITS)).astype(np.int64), np.concatenate([of, of[1:][inside]])


class Classifier:
    """Weights, temperature, and the templates' 3-grams."""

    def __init__(self, negatives: list[str], seed: int = 20):
        rng = np.random.default_rng(seed)
        vocabulary = sorted({w for n in negatives for w in n.split()} | {"alpha", "beta", "gamma"})
        common = [w for f in TEMPLATES for w in {x.strip(".,;:()").lower() for t in TEMPLATES[f] for x in t.split()}]
        common = {w for w in common if common.count(w) > 2}
        texts, y = [], []

        def add(words: list[str], label: int) -> None:
            """A stretch of at most WINDOW words with these words, or as many of them as fit, somewhere in it."""
            m = min(len(words), WINDOW)
            at, room = rng.integers(0, len(words) - m + 1), rng.integers(0, WINDOW - m + 1)
            other = [vocabulary[k] for k in rng.integers(0, len(vocabulary), room)]
            lead = rng.integers(0, room + 1)
            texts.append(" ".join([*other[:lead], *words[at : at + m], *other[lead:]]))
            y.append(label)

        for i, family in enumerate(FAMILIES[2:], 2):
            for t in TEMPLATES[family]:
                texts.append(t)
                y.append(i)
                telling = [w.strip(".,;:()").lower() not in common for w in t.split()]
                for _ in range(24):
                    add([w for w in t.split() if rng.random() > 0.06], i)
                    if any(telling) and not all(telling) and _ % 2:
                        add([vocabulary[rng.integers(0, len(vocabulary))] if x else w for w, x in zip(t.split(), telling, strict=True)], 1)
        for t in OTHER:
            for _ in range(10):
                add([w for w in t.split() if rng.random() > 0.1], 0)
        for w in sorted({w for f in TEMPLATES for t in TEMPLATES[f] for w in t.split()}):  # a notice's words over and over are no notice
            for n in (4, WINDOW):
                add([w] * n, 0)
        for t in negatives:
            w = t.split()
            for i in range(0, max(1, len(w)), WINDOW):  # as paragraphs are judged
                texts.append(" ".join(w[i : i + WINDOW]))
                y.append(0)
        f, of = self._features(texts)
        seen, column = np.unique(f, return_inverse=True)
        self.column = np.zeros(1 << DIM_BITS, np.int32)  # 0: not in the training texts; its weights are those of the constant
        self.column[seen] = np.arange(1, len(seen) + 1)
        y = np.array(y)
        value = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(y)), 1))[of]
        row = np.concatenate([np.arange(len(y)), of])  # a constant for each text, then its features
        column, value = np.concatenate([np.zeros(len(y), np.int64), column + 1]), np.concatenate([np.ones(len(y)), value])
        held = rng.random(len(y)) < 0.2
        w = self._train(row, column, value, np.eye(len(FAMILIES))[y], ~held, len(seen) + 1)
        z = self._scores(row, column, value, w, len(y))[held]
        temperatures = np.geomspace(0.25, 4, 33)
        loss = [-np.log(np.maximum(self._softmax(z / t)[np.arange(held.sum()), y[held]], 1e-12)).mean() if held.any() else 0 for t in temperatures]
        self.weights = (w / temperatures[int(np.argmin(loss))]).astype(np.float32)
        self.held_accuracy = float((np.argmax(z, axis=1) == y[held]).mean()) if held.any() else 1.0
        self.templates = [[], []] + [[self.grams(t) for t in TEMPLATES[f]] for f in FAMILIES[2:]]

    @staticmethod
    def _scores(row: np.ndarray, column: np.ndarray, value: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        order = np.argsort(row, kind="stable")
        return np.add.reduceat(w[column[order]] * value[order, None], np.searchsorted(row[order], np.arange(rows)), axis=0)

    @classmethod
    def _train(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, used: np.ndarray, size: int, rounds: int = 200) -> np.ndarray:
        """Logistic regression over sparse rows by gradient steps with momentum."""
        keep = used[row]
        row, column, value = (np.cumsum(used) - 1)[row[keep]], column[keep], value[keep]
        target = target[used]
        by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
        first = np.searchsorted(row[by_row], np.arange(len(target)))
        own, head = np.unique(column[by_column], return_index=True)
        w = np.zeros((size, target.shape[1]))
        step = np.zeros_like(w)
        for _ in range(rounds):
            z = np.add.reduceat(w[column[by_row]] * value[by_row, None], first, axis=0)
            miss = (cls._softmax(z) - target) / max(1, len(target))
            grad = 1e-5 * w
            grad[own] += np.add.reduceat(miss[row[by_column]] * value[by_column, None], head, axis=0)
            step = 0.9 * step - 4.0 * grad
            w += step
        return w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[2:]

    @staticmethod
    def grams(text: str) -> frozenset[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        h = features(raw, np.array([0, len(raw)]))[0]
        return frozenset(roll(h, min(3, len(h))).tolist())

    def confirmed(self, family: int, have: set[int], match: float) -> bool:
        """Whether a template of the family is there, and none of another family is there more fully."""
        near = [max(len(t & have) / len(t) for t in ts) if ts else 0.0 for ts in self.templates]
        return near[family] >= match and near[family] >= max(near) - 1e-9

    def judge(self, data: np.ndarray, offs: np.ndarray, least: float, match: float) -> tuple[list[list[int]], np.ndarray]:
        """For each paragraph its families' numbers, and the calibrated probability of a licence in its likeliest stretch."""
        h, first, f, of = features(data, offs)
        size = np.diff(first)
        weights = self.weights.astype(np.float64)
        weights[0] = 0
        one, two = weights[self.column[f[: len(h)]]], np.zeros((len(h), len(FAMILIES)))
        two[np.flatnonzero(of[1 : len(h)] == of[: max(len(h) - 1, 0)])] = weights[self.column[f[len(h) :]]]
        one, two = (np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(x, axis=0)]) for x in (one, two))
        many = np.where(size > WINDOW, -(-(size - WINDOW) // (WINDOW // 2)) + 1, 1)
        line = np.repeat(np.arange(len(size)), many)
        k = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
        words = np.minimum(size[line], WINDOW)
        start = first[line] + np.minimum(k * (WINDOW // 2), size[line] - words)
        end, pairs = start + words, np.maximum(words - 1, 0)
        z = (one[end] - one[start] + two[start + pairs] - two[start]) / np.sqrt(np.maximum(words + pairs, 1))[:, None] + self.weights[0]
        p = self._softmax(z)
        every = np.where(words > 0, 1 - p[:, 0], 0.0)
        out: list[list[int]] = [[] for _ in size]
        family = np.argmax(p[:, 1:], axis=1) + 1
        for u in np.flatnonzero(every >= least).tolist():
            r = line[u]
            if family[u] > 1 and family[u] not in out[r]:
                own = h[max(first[r], start[u] - WINDOW) : min(first[r + 1], end[u] + WINDOW)]
                if self.confirmed(int(family[u]), set(roll(own, min(3, len(own))).tolist()), match):
                    out[r] = [x for x in out[r] if x > 1] + [int(family[u])]
                    continue
            out[r] = out[r] or [1]
        return out, np.maximum.reduceat(every, np.cumsum(many) - many)


def _scan(model, least: float, match: float):
    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier = model.value
        for b in parts:
            for a, z, data, offs in chunks(b.column(1)):
                starts, n = _paragraphs(data, offs)
                families, chance = m.judge(data, starts, least, match)
                ends = np.cumsum(n)
                found = [[(i, f) for i, own in enumerate(families[e - k : e]) for f in sorted(own)] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(a, z - a), pa.array(n), pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32())),
                        pa.array([[FAMILIES[f] for _, f in x] for x in found], pa.list_(pa.string())), pa.array(np.maximum.reduceat(chance, ends - n)),
                    ],
                    names=["doc", "n_paragraphs", "at", "families", "chance"],
                )

    return run


def fit(docs: DataFrame, *, text_col: str = "text", n_negatives: int = 400, sample_words: int = 4 * WINDOW) -> Classifier:
    """Trains on the templates and, as other text, on a sample: of at most `n_negatives` different texts (those of the smallest hashes) a stretch of `sample_words` words from anywhere in it, its place drawn by the hash; stretches that share a 3-gram with a template are left out."""
    texts = docs.select(F.col(text_col).alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    drawn = texts.select("h").distinct().orderBy("h").limit(n_negatives)
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    stretch = let(words, lambda w: F.array_join(F.slice(w, (1 + F.pmod(F.col("h"), F.greatest(F.size(w) - sample_words + 1, F.lit(1)))).cast("int"), sample_words), " "))
    sample = texts.join(F.broadcast(drawn), "h").select("h", stretch.alias("s")).groupBy("h").agg(F.min("s").alias("s")).where("s <> ''").orderBy("h")
    templates = frozenset().union(*(Classifier.grams(t) for ts in TEMPLATES.values() for t in ts))
    return Classifier([r["s"] for r in sample.collect() if not Classifier.grams(r["s"]) & templates])  # n_negatives rows of sample_words words


def scan(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, match: float = 0.6) -> DataFrame:
    """(id, n_paragraphs, at, families, chance) for each row of docs.

    at: indexes of the paragraphs that hold a licence notice, with their families beside (a paragraph of several families
    comes several times); chance: the largest calibrated licence probability of a stretch.  A null or empty text is one empty
    paragraph without a licence; very long texts are judged whole.  Of equally likely families the first by name is predicted.
    Repeated rows are scanned alike; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(spark.sparkContext.broadcast(model), least, match), "doc long, n_paragraphs long, at array<int>, families array<string>, chance double").withColumnRenamed("doc", id_col)
