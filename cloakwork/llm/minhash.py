"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. A pass over all texts counts in how many documents each five-word shingle occurs, in a count-min sketch
   of fixed size (DEPTH x 2^WIDTH counters, added up over a tree of tasks and broadcast: 2 MB whatever the
   size of the corpus). A shingle weighs its times in the text by 1 + ln((1 + documents) / (1 + count)).
2. A second pass draws BANDS x ROWS consistent samples of each text; equal samples of two texts are as
   likely as their weighted Jaccard similarity. Bands of samples are bucket keys.
3. Equal texts are one node from the start. Nodes that share a bucket and agree in AGREE samples are candidates
   (see graph.link) and are verified by the weighted Jaccard similarity of the whole texts, at least SIMILARITY. In
   the last turn the shingles that no other text of that turn has are weighed: what two texts share weighs at most
   as much as the rest of either, and pairs that cannot reach SIMILARITY with that are left out. keep_first keeps
   one row of each class, the one with the smallest doc_id, then text, and all rows without a text.

Cases: a null text is its own class; texts without words are near no other, but equal ones are one class;
texts of under five words are one shingle; rows with equal doc_id and text are one document, and more rows
with one doc_id may lie in several classes; a null doc_id is allowed (its class is that of its text); an
empty table gives no rows; texts of any length are compared whole; clashing columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.graph import crowded, link, share, shares
from cloakwork.llm.scratch import body, discard, rest, restored, stash, stash_all
from cloakwork.llm.textkit import U64, mix, shingles, slices, words_of

SIMILARITY = 0.8
SHINGLE = 5
BANDS = 10
ROWS = 3
DEPTH = 2
WIDTH = 18
#: Samples in which candidates agree, of all BANDS x ROWS: texts as alike as SIMILARITY do with probability 0.997.
AGREE = 18
#: Far more than sums of weights in another order differ.
SLIP = 1e-6
_FAN = 64


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Count-min sketch of shingles over documents, and the number of documents. texts: one column."""
    size = 1 << WIDTH

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, held = np.zeros((DEPTH, size), np.int64), 0, []

        def flush() -> None:
            if held:
                own = np.concatenate(held)
                for d in range(DEPTH):
                    cells[d] += np.bincount(((own >> U64(32 * d)) & U64(size - 1)).astype(np.int64), minlength=size)
                held.clear()

        waiting = 0
        for batch in source:
            for words in words_of(batch.column(0).to_pylist()):
                n += 1
                own = np.unique(shingles(words, SHINGLE))
                held.append(own)
                waiting += len(own)
                if waiting > 1_000_000:
                    flush()
                    waiting = 0
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["part", "n", "cells"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DEPTH * size, np.int64)
        for raw in group["cells"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // _FAN], "n": [int(group["n"].sum())], "cells": [total.tobytes()]})

    level = stash(texts.mapInArrow(count, "part bigint, n bigint, cells binary"), "sketch")
    while level.count() > 1:
        level = stash(level.groupBy((F.col("part") / _FAN).cast("bigint").alias("_to")).applyInPandas(add, "part bigint, n bigint, cells binary"), "sketch")
    row = level.first()
    if row is None:
        return np.zeros((DEPTH, size), np.int64), 0
    return np.frombuffer(row["cells"], np.int64).reshape(DEPTH, size), row["n"]


class Weigher:
    """TF-IDF weights of a text's shingles, from the sketch."""

    def __init__(self, cells: np.ndarray, documents: int):
        idf = 1 + np.maximum(0.0, math.log1p(documents) - np.log1p(cells))
        self._idf = idf.astype(np.float32)
        self._low = U64((1 << WIDTH) - 1)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, times = np.unique(shingles(words, SHINGLE), return_counts=True)
        # The smallest count has the largest weight.
        idf = np.maximum.reduce([self._idf[d][((keys >> U64(32 * d)) & self._low).astype(np.int64)] for d in range(DEPTH)])
        return keys, times * idf.astype(np.float64)


_STEPS = 1 << 16
#: Draws times shingles that are worked on at once: fits the CPU cache.
_CELLS = 1 << 15


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of _STEPS equal parts, by bisection."""
    p = (np.arange(_STEPS) + 0.5) / _STEPS
    low, high = np.zeros(_STEPS), np.full(_STEPS, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted samples: of each draw, the shingle and its quantised weight."""

    def __init__(self, n: int):
        gamma = _gamma_quantiles()
        self._rate, self._per_rate = gamma.astype(np.float32), (1 / gamma).astype(np.float32)
        self._log_c = np.log(gamma).astype(np.float32)
        self._salts = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def draw(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value per draw."""
        log_w = np.log(weights).astype(np.float32)[None, :]
        out = np.empty(len(self._salts), U64)
        low = U64(_STEPS - 1)
        step = max(1, _CELLS // max(1, len(keys)))
        for a in range(0, len(out), step):
            bits = keys[None, :] * self._salts[a : a + step, None]
            bits ^= bits >> U64(29)
            bits *= U64(0xBF58476D1CE4E5B9)
            at = (bits >> U64(48)).view(np.int64)
            rate = self._rate.take(at)
            level = self._per_rate.take(at)
            level *= log_w
            beta = ((bits >> U64(32)) & low).astype(np.float32)
            beta *= np.float32(1 / _STEPS)
            level += beta
            np.floor(level, out=level)
            beta -= level
            beta -= np.float32(1)
            beta *= rate
            beta += self._log_c.take(((bits >> U64(16)) & low).view(np.int64))
            best = np.argmin(beta, axis=1)
            chosen = level[np.arange(len(best)), best].astype(np.int64).view(U64)
            out[a : a + step] = mix(keys[best] ^ mix(chosen + U64(0x632BE59BD9B4E019)))
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    grouped = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grouped[:, j])
    return key.view(np.int64)


def nibbles(samples: np.ndarray) -> tuple[int, int]:
    """Four bits of each of up to 32 samples, as two 64-bit integers."""
    bits = np.zeros(32, U64)
    bits[: len(samples)] = samples & U64(15)
    low, high = ((bits[i : i + 16] << (np.arange(16, dtype=U64) * U64(4))).sum(dtype=U64).view(np.int64) for i in (0, 16))
    return int(low), int(high)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending keys."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node (the text's key), root (its class' smallest node), class_id (smallest doc_id of the class) for each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells, documents = document_counts(texts.select("text"))
    shared = spark.sparkContext.broadcast((cells, documents))

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher, sampler = Weigher(*shared.value), Sampler(BANDS * ROWS)
        for batch in source:
            drawn = [sampler.draw(*weigher.of(w)) if len(w) else None for w in words_of(batch.column(2).to_pylist())]
            keys = [None if x is None else band_keys(x) for x in drawn]
            low, high = zip(*[(None, None) if x is None else nibbles(x) for x in drawn]) if drawn else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["doc_id", "node", "bands", "low", "high"])

    signed = stash(texts.select("doc_id", text_key(F.col("text")).alias("node"), "text").mapInArrow(sign, "doc_id bigint, node binary, bands array<bigint>, low bigint, high bigint"), "signed")
    buckets = crowded(signed.filter(F.col("node").isNotNull()).select(F.explode("bands").alias("key"), "node", F.struct("low", "high").alias("mark")))

    def agree(a: str, b: str) -> Column:
        """Whether enough of the four-bit pieces that two texts' marks are made of are equal."""
        apart = F.lit(0)
        for part in ("low", "high"):
            x = F.col(f"{a}.{part}").bitwiseXOR(F.col(f"{b}.{part}"))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            apart = apart + F.bit_count(x.bitwiseAND(0x1111111111111111))
        return apart <= BANDS * ROWS - AGREE

    needed = buckets.select("node").distinct()
    bodies = texts.withColumn("node", text_key(F.col("text"))).join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    bodies = stash(bodies, "bodies")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (bodies.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")

        def alike(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weigher = Weigher(*shared.value)

            @lru_cache(64)
            def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
                return weigher.of(next(words_of([text])))

            for batch in slices(source, 128):
                pairs_of = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
                good = [similarity(weighted(x), weighted(y)) >= least for x, y in pairs_of]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(alike, "a binary, b binary")

    def hopeful(nodes: DataFrame) -> DataFrame:
        """(node, hope): its weight in all (whole) and in shingles that another of the nodes has (common), where that may be enough."""

        def weighted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weigher = Weigher(*shared.value)
            for batch in slices(source, 128):
                own = [weigher.of(words) for words in words_of(batch.column("text").to_pylist())]
                owner = np.repeat(np.arange(len(own)), [len(keys) for keys, _ in own])
                keys, weights = (pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k, _ in own], [w for _, w in own]))
                wholes = pa.array(np.array([w.sum() for _, w in own])[owner])
                yield pa.RecordBatch.from_arrays([keys, batch.column("node").take(pa.array(owner)), weights, wholes], names=["key", "node", "weight", "whole"])

        held = stash(bodies.join(nodes, "node", "left_semi").select("node", "text"), "near-open-bodies")
        letters = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        n = shares(int(letters) // 8)
        grams = held.mapInArrow(weighted, "key bigint, node binary, weight double, whole double")
        one = F.struct("node", "weight", "whole")
        # Of a key that one text has, that text's row; of others nothing is needed.
        alone = (share(grams, i, n).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(one).alias("x")).filter("n = 1").groupBy("x.node").agg(F.sum("x.weight").alias("alone"), F.first("x.whole").alias("whole")) for i in range(n))
        alone = stash_all(alone, "near-alone")
        per = alone.groupBy("node").agg(F.sum("alone").alias("alone"), F.first("whole").alias("whole"))
        # Texts without a shingle of their own have no row, and nothing is known of them.
        hope = F.when(F.col("whole").isNotNull(), F.struct((F.col("whole") - F.col("alone")).alias("common"), "whole"))
        out = held.select("node").join(per, "node", "left").filter(F.col("whole").isNull() | (F.col("whole") - F.col("alone") >= (least - SLIP) * F.col("whole")))
        out = stash(out.select("node", hope.alias("hope")), "near-hopeful")
        discard(held, alone)
        return out

    def able(a: str, b: str) -> Column:
        """Whether two texts can be alike enough if they share as much as they may."""
        common = F.least(f"{a}.common", f"{b}.common")
        enough = common >= (least - SLIP) * (F.col(f"{a}.whole") + F.col(f"{b}.whole") - common)
        return F.coalesce(enough, F.lit(True))

    roots = link(buckets, verify, "near", "mark", agree, hopeful=hopeful, able=able)
    rows = stash(signed.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # Of these only the rows are read again: what stays on disk would stay through the stages that follow.
    discard(signed, bodies)
    first = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "root", "left").select("doc_id", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that another of their class stays for: the row with the smallest doc_id (then text) of each class."""
    named = classes(docs)
    kept = named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("node").alias("k"))).alias("m")).select("m.d", "m.k")
    keyed = docs.select(rest(docs), body(docs), F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_node"))
    # Texts are dealt by node once: the test of ids is no key of the join, and the row that stays is looked for where the join has put it.
    chosen = keyed.join(kept, (F.col("_node") == F.col("k")) & F.when(F.col("_id").isNull(), F.col("d").isNull()).otherwise(F.col("_id") == F.col("d")))
    chosen = chosen.dropDuplicates(["_node"]).drop("d", "k")
    return chosen.unionByName(keyed.filter(F.col("_node").isNull())).select(*restored(docs))
