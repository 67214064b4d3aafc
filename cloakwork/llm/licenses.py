"""Licence scan: a trained paragraph classifier, a calibrated unknown class and template comparison.

Paragraphs are lines with a word, and runs of such lines that each share word pairs with templates (a notice
wrapped over lines), where none of the run is a confirmed notice alone. Features are hashed word 1-, 2- and 3-grams, each counted over the
paragraph and divided by the root of their number. A softmax regression over licence families and
`unknown` is trained on the driver: notices made from the templates below (cut, joined with words around
them) against a bounded sample of the corpus' own paragraphs that share no template: the first PARAGRAPHS
lines, cut to LETTERS characters, of NEGATIVES / PARAGRAPHS documents by hash of their doc_id. A temperature fitted on a held-out quarter calibrates probabilities; a paragraph whose
best family is less likely than SURE is unknown. A prediction is confirmed when the paragraph contains
at least CONTAINED of the two-word shingles of one of that family's templates.

Cases: null and empty texts have no paragraphs; without corpus paragraphs training uses notices and random
words only; rows with equal doc_id and text are one document and get the same result, other rows with one or no
doc_id do not mix; texts and lines of any length are scanned whole; families that tie in probability are
ordered by name; an empty table gives no rows; clashing columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.textkit import U64, batches, mix, runs, word_hashes, words_of

#: Short notices of public licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
}
FAMILIES = (*TEMPLATES, "unknown")
BITS = 15
ORDERS = (1, 2, 3)
NEGATIVES = 1600
PARAGRAPHS = 4
LETTERS = 400
#: Word pairs of templates that a line of a wrapped notice has.
PAIRS = 2
SURE = 0.5
CONTAINED = 0.7


def features(words: np.ndarray) -> np.ndarray:
    """Hashed n-gram positions of one paragraph."""
    return np.concatenate([(runs(words, n) >> U64(64 - BITS)).astype(np.int64) for n in ORDERS])


def logits(words: np.ndarray, cuts: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores (paragraphs x families) of consecutive paragraphs: n-grams that cross from one to the next count for none."""
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), weights.shape[1]), np.float64)
    total = np.zeros(len(sizes), np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for n in ORDERS:
        at = (runs(words, n) >> U64(64 - BITS)).astype(np.int64)
        if not len(at):
            continue
        whole = owner[: len(at)] == owner[n - 1 :]
        own = owner[: len(at)]
        for c in range(weights.shape[1]):
            out[:, c] += np.bincount(own, weights[:, c].take(at) * whole, len(sizes))
        total += np.bincount(own, whole, len(sizes))
    return out / np.sqrt(np.maximum(total, 1))[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _template_shingles() -> dict[str, list[np.ndarray]]:
    return {k: [np.unique(runs(w, 2)) for w in words_of(v)] for k, v in TEMPLATES.items()}


def containment(words: np.ndarray, templates: list[np.ndarray]) -> float:
    own = np.unique(runs(words, 2))
    return max((float(np.isin(t, own).mean()) for t in templates if len(t)), default=0.0)


def train(paragraphs: list[str], seed: int = 7, rounds: int = 80) -> dict:
    """Weights, bias and temperature from templates and negative paragraphs."""
    rng = np.random.default_rng(seed)
    shingles = _template_shingles()
    negatives = [w for w in words_of(paragraphs) if len(w) and max(containment(w, t) for t in shingles.values()) < 0.5]
    filler = np.unique(np.concatenate(negatives)) if negatives else mix(np.arange(1, 2000, dtype=U64))
    rows, labels = [], []
    for label, family in enumerate(TEMPLATES):
        for words in words_of(TEMPLATES[family]):
            for _ in range(40):
                cut = int(rng.integers(0, max(1, len(words) // 6) + 1))
                own = words[cut:] if rng.random() < 0.3 else words
                before, after = (rng.choice(filler, int(rng.integers(0, 8)) * int(rng.random() < 0.5)) for _ in range(2))
                rows.append(np.concatenate([before, own, after]))
                labels.append(label)
    words_of_licence = np.concatenate([w for v in TEMPLATES.values() for w in words_of(v)])
    unknown = negatives + [rng.choice(filler, int(rng.integers(1, 60))) for _ in range(200)]
    unknown += [np.where(rng.random(n) < 0.2, rng.choice(words_of_licence, n), rng.choice(filler, n)) for n in rng.integers(5, 40, 300)]
    rows += unknown
    labels += [len(TEMPLATES)] * len(unknown)
    y = np.array(labels)
    size, n = len(FAMILIES), len(rows)
    at = [features(w) for w in rows]
    owner = np.repeat(np.arange(n), [len(x) for x in at])
    columns = np.concatenate(at)
    scale = 1 / np.sqrt(np.bincount(owner, minlength=n).clip(1))
    fit = rng.random(n) < 0.75
    weights, bias, seen = np.zeros((1 << BITS, size)), np.zeros(size), np.zeros((1 << BITS, size)) + 1e-6
    used = fit[owner]
    share = 1 / np.bincount(y[fit], minlength=size).clip(1)

    def score(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(owner, x[columns, c], n) for c in range(size)]) * scale[:, None] + bias

    for _ in range(rounds if n else 0):
        error = softmax(score(weights))
        error[np.arange(n), y] -= 1
        error *= (share[y] * fit)[:, None]
        step = error * scale[:, None]
        slope = np.column_stack([np.bincount(columns[used], step[owner[used], c], 1 << BITS) for c in range(size)]) + 1e-5 * weights
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
        bias -= 0.3 * error.sum(axis=0)
    z = score(weights)[~fit]
    losses = [(-np.log(softmax(z / t)[np.arange(len(z)), y[~fit]] + 1e-12).mean(), t) for t in np.geomspace(0.25, 4, 33)]
    return {"weights": (weights / min(losses)[1]).astype(np.float32), "bias": bias / min(losses)[1]}


def scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """Each paragraph that is predicted to be a licence notice: doc_id, text_key, paragraph (its first line, from 0), lines, family, probability, similarity, confirmed."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    sample = texts.filter(F.col("text").isNotNull()).select("doc_id", "text_key", F.transform(F.slice(F.split("text", "\n", PARAGRAPHS + 1), 1, PARAGRAPHS), lambda x: F.substring(x, 1, LETTERS)).alias("p"))
    wanted, total = max(1, negatives // PARAGRAPHS), texts.count()
    first = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(wanted)
    # The least hashes lie below this bound, which spares each task sending as many rows as are wanted in all.
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, 8 * wanted / max(1, total)))
    chosen = sample.filter(F.xxhash64("doc_id") < min(bound, (1 << 63) - 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(wanted).collect()
    if len(chosen) < wanted:
        chosen = first.collect()
    model = train([x for r in chosen for x in r["p"]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(words: np.ndarray, cuts: np.ndarray, model: dict, shingles: dict) -> Iterator[tuple]:
        """(paragraph, family, probability, similarity) of those that are no unknown text."""
        odds = softmax(logits(words, cuts, model["weights"], model["bias"]))
        best = odds.argmax(axis=1)
        for i in np.flatnonzero((best < len(TEMPLATES)) & (odds.max(axis=1) >= SURE) & (np.diff(cuts) > 0)):
            family = FAMILIES[best[i]]
            yield int(i), family, float(odds[i, best[i]]), containment(words[cuts[i] : cuts[i + 1]], shingles[family])

    def classify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shingles = shared.value, _template_shingles()
        pairs = np.unique(np.concatenate([t for own in shingles.values() for t in own]))
        for batch in source:
            held, doc, line = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = text.split("\n") if text else []
                held += own
                doc += [i] * len(own)
                line += range(len(own))
            found, alone, parts = [], set(), []
            for first, _, data, starts, ends, cuts in batches(held):
                words = word_hashes(data, starts, ends)
                for i, family, sure, alike in judge(words, cuts, m, shingles):
                    found.append((doc[first + i], line[first + i], 1, family, sure, alike))
                    if alike >= CONTAINED:
                        alone.add(first + i)
                two = runs(words, 2)
                near = np.flatnonzero(np.isin(two, pairs))
                at = np.searchsorted(cuts, near, "right") - 1
                at = at[near + 1 < cuts[at + 1]]
                many = np.bincount(at, minlength=len(cuts) - 1)
                parts += [(first + int(i), words[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(many >= PAIRS)]
            wrapped: list[list[tuple[int, np.ndarray]]] = []
            for at, words in parts:
                last = wrapped[-1][-1][0] if wrapped else -2
                if at == last + 1 and doc[at] == doc[last]:
                    wrapped[-1].append((at, words))
                else:
                    wrapped.append([(at, words)])
            wrapped = [w for w in wrapped if len(w) > 1 and not any(at in alone for at, _ in w)]
            if wrapped:
                texts_of = [np.concatenate([words for _, words in w]) for w in wrapped]
                cuts = np.cumsum([0, *map(len, texts_of)])
                for i, family, sure, alike in judge(np.concatenate(texts_of), cuts, m, shingles):
                    at = wrapped[i][0][0]
                    found = [x for x in found if not (x[0] == doc[at] and line[at] <= x[1] < line[at] + len(wrapped[i]))] if alike >= CONTAINED else found
                    if alike >= CONTAINED:
                        found.append((doc[at], line[at], len(wrapped[i]), family, sure, alike))
            docs_of = pa.array([x[0] for x in found], pa.int64())
            columns = [pa.array([x[k] for x in found], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.float64()), (5, pa.float64()))]
            confirmed = pa.array([x[5] >= CONTAINED for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(docs_of), batch.column(1).take(docs_of), *columns, confirmed], names=["doc_id", "text_key", "paragraph", "lines", "family", "probability", "similarity", "confirmed"])

    return texts.mapInArrow(classify, "doc_id bigint, text_key bigint, paragraph int, lines int, family string, probability double, similarity double, confirmed boolean")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, licence (its confirmed family with the highest probability, else null), notices, confirmed notices."""
    # Repeated rows find the same notices again.
    found = scan(docs).dropDuplicates(["doc_id", "text_key", "paragraph"])
    best = F.max(F.when(F.col("confirmed"), F.struct("probability", "family")))["family"]
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).agg(best.alias("licence"), F.count(F.lit(1)).alias("notices"), F.sum(F.col("confirmed").cast("long")).alias("confirmed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_key"))
    rows = rows.join(found, (F.col("_key") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return rows.select("doc_id", "licence", F.coalesce("notices", F.lit(0)).alias("notices"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"))
