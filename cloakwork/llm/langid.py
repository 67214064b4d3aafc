"""Language identification by bit-sliced Bloom filters of n-grams.

Training counts four-byte n-grams of lower-cased words (with the space at either end) per language, over
at most about SAMPLE documents of each language, and keeps the GRAMS most frequent of each, but for those much commoner in
another language (loan words, wrong labels). All languages
share one array of bit masks: position p holds the set of languages whose filter has bit p, so the AND of
a gram's three positions is the set of all languages that contain it. A text's score for a language is its
number of contained grams, corrected for that filter's false positives; the largest decides.

Only text and lang of training rows are learned from; lang, source and doc_id are no inputs of predictions.
SAMPLE and GRAMS bound what reaches the driver, whatever the size of the corpus.

Cases: null text or one without letters is `und` with score 0; a text with no known gram gets the most
frequent training language, score 0; ties go to the more frequent, then the smaller language; without
training rows all is `und`; repeated rows give repeated results; at most 64 languages, the most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.textkit import normalise

SAMPLE = 3000
GRAMS = 8000
BITS = 18
#: A gram this much rarer in a language than where it is commonest is not put in that language's filter.
RARE = 0.3
_HASHES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_NO_DIGITS = bytes(32 if 48 <= c < 58 else c for c in range(256))


def _gram_batches(texts, size: int = 1 << 18) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(offsets of texts, grams, whether each is valid): grams start inside their text's stretch."""

    def whole(parts: list[bytes]):
        data = np.frombuffer(b" " + b"  ".join(parts) + b"    ", np.uint8)
        offsets = np.cumsum([0, *(len(p) + 2 for p in parts)])
        n = len(data) - 3
        grams = data[:n].astype(np.uint32)
        for j in (1, 2, 3):
            grams |= data[j : n + j].astype(np.uint32) << np.uint32(8 * j)
        space = data == 32
        return offsets, grams, ~(space[1 : n + 1] | space[2 : n + 2])

    parts, held = [], 0
    for text in texts:
        parts.append(normalise(text).translate(_NO_DIGITS))
        held += len(parts[-1]) + 2
        if held >= size:
            yield whole(parts)
            parts, held = [], 0
    if parts:
        yield whole(parts)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> dict:
    """rows: text, lang, _key (a hash that chooses the sample). Returns languages, masks and false positive rates."""
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(64).collect()}
    languages = list(sizes)
    if not languages:
        return {"languages": []}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 31))))])
    chosen = known.filter(F.pmod("_key", F.lit(1 << 31)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found, times = [], []
                for _, keys, valid in _gram_batches([texts[i] for i in np.flatnonzero(langs == lang)]):
                    k, n = np.unique(keys[valid], return_counts=True)
                    found.append(k)
                    times.append(n)
                keys, at = np.unique(np.concatenate(found), return_inverse=True)
                totals = np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(totals)], names=["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_r") <= grams)
    rows = best.select("lang", "gram", "n").collect()
    totals, most = dict.fromkeys(languages, 0), {}
    for lang, _, n in rows:
        totals[lang] += n
    for lang, gram, n in rows:
        most[gram] = max(most.get(gram, 0.0), n / totals[lang])
    masks = np.zeros(1 << BITS, np.uint64)
    for lang, gram, n in rows:
        if n / totals[lang] < RARE * most[gram]:
            continue
        for h in _HASHES:
            masks[(gram * h & 0xFFFFFFFF) >> (32 - BITS)] |= np.uint64(1 << languages.index(lang))
    filled = np.array([np.count_nonzero(masks & np.uint64(1 << i)) / len(masks) for i in range(len(languages))])
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    return {"languages": languages, "masks": masks.astype(kind), "false": filled ** len(_HASHES)}


def predict(docs: DataFrame, model: dict, *carried: str) -> DataFrame:
    """The carried columns, lang_pred and score of each text."""
    rows = docs.select(*carried, F.col("text").cast("string").alias("_x"))
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in carried) + ", lang_pred string, score double"
    languages = model["languages"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in source:
            texts = batch.column("_x").to_pylist()
            names, scores = [], []
            for offsets, grams, valid in _gram_batches(texts if languages else []):
                held = None
                for h in _HASHES:
                    part = m["masks"][(grams * np.uint32(h)) >> np.uint32(32 - BITS)]
                    held = part if held is None else held & part
                held = np.where(valid, held, held.dtype.type(0))
                for a, b in zip(offsets[:-1], offsets[1:]):
                    n = np.count_nonzero(valid[a:b])
                    hits = np.array([np.count_nonzero(held[a:b] & held.dtype.type(1 << i)) for i in range(len(languages))])
                    fixed = np.clip((hits - n * m["false"]) / (1 - m["false"]), 0, None)
                    at = int(np.argmax(fixed))
                    names.append(languages[at])
                    scores.append(min(1.0, float(fixed[at]) / n) if n else 0.0)
            for i, text in enumerate(texts):
                if not text or not any(map(str.isalpha, text)):
                    if languages:
                        names[i], scores[i] = "und", 0.0
            if not languages:
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
            kept = [batch.column(n) for n in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*carried, "lang_pred", "score"])

    return rows.mapInArrow(decide, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not held out."""
    chosen = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = train(chosen.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("_key")))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")
