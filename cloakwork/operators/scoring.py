"""Scores that a greedy match decides, per document in one Arrow function; and corpus cutting and alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.operators.dealing import tasks_for

CHUNK, LEAST = 3000, 400


def chunks(text: str | None, size: int = CHUNK, least: int = LEAST) -> list[tuple[int, str]]:
    """(offset, text): cut at the last line end past half of the size; pieces of fewer than `least` characters go."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            line = text.rfind("\n", at + size // 2, end)
            end = line + 1 if line >= 0 else end
        if len(text[at:end].strip()) >= least:
            out.append((at, text[at:end]))
        at = end
    return out


def chunked(text: Column) -> Column:
    @F.pandas_udf("array<struct<offset:int,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"offset": o, "text": c} for o, c in chunks(t)])

    return run(text)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def sensitive_coverage(text: str, gold: list[tuple], found: list[tuple]) -> tuple[int, int, int]:
    """tp, fp, fn: gold spans (type, start, end), trimmed to letters and digits, each covered by one unused found span of its type."""
    used: set[int] = set()
    hits = 0
    for kind, start, end in gold:
        start, end = trimmed(text, start, end)
        at = next((i for i, (k, s, e) in enumerate(found) if i not in used and k == kind and s <= start and end <= e), None)
        if at is not None:
            used.add(at)
            hits += 1
    return hits, len(found) - hits, len(gold) - hits


def token_counts(text: str, gold: list[tuple], found: list[tuple]) -> tuple[int, int, int]:
    """tp, fp, fn over (type, position) of white-space tokens inside spans."""

    def tokens(spans):
        return {(k, s + m.start()) for k, s, e in spans for m in re.finditer(r"\S+", text[s:e])}

    g, f = tokens(gold), tokens(found)
    return len(g & f), len(f - g), len(g - f)


def two_annotators(a: list[tuple], b: list[tuple]) -> dict[str, float]:
    """Greedy pairing of (type, start, end), exact first, then overlapping; Jaccard and share of equal bounds."""
    left, right = list(a), list(b)
    exact = [x for x in left if x in right]
    left, right = list((Counter(left) - Counter(exact)).elements()), list((Counter(right) - Counter(exact)).elements())
    overlapping = 0
    for kind, s, e in sorted(left, key=lambda x: x[1]):
        at = next((y for y in right if y[0] == kind and y[1] < e and s < y[2]), None)
        if at:
            right.remove(at)
            overlapping += 1
    pairs = len(exact) + overlapping
    return {"pairs": pairs, "exact": len(exact), "jaccard": pairs / max(1, len(a) + len(b) - pairs), "bounds": len(exact) / max(1, pairs)}


def find_flexible(hay: str, needle: str, start: int = 0) -> tuple[int, int] | None:
    """A needle whose white space may differ."""
    words = needle.split()
    m = re.compile(r"\s+".join(map(re.escape, words))).search(hay, start) if words else None
    return m.span() if m else None


def align(text: str, findings: list[tuple[str, str, str]]) -> tuple[list[tuple[str, int, int]], int]:
    """Findings (type, value, fragment) to spans: every place of the value within its fragment and 40 more; and how many were not found."""
    out: dict[tuple[str, int, int], None] = {}
    lost = 0
    for kind, value, fragment in findings:
        area = find_flexible(text, fragment)
        hit, at = False, area[0] if area else 0
        while area and (span := find_flexible(text, value, at)) and span[1] <= area[1] + 40:
            out[kind, *span] = None
            hit, at = True, span[1]
        lost += not hit
    return list(out), lost


def gaps_preserved(text: str, spans: list[tuple[int, int]], redacted: str, tokens: list[str]) -> bool:
    """Whether everything between spans is byte for byte as before."""
    at = place = 0
    for (start, end), token in zip(sorted(spans), tokens):
        gap = text[at:start]
        if redacted[place : place + len(gap)] != gap or redacted[place + len(gap) : place + len(gap) + len(token)] != token:
            return False
        at, place = end, place + len(gap) + len(token)
    return redacted[place:] == text[at:]


def scored(rows: DataFrame, kind: str = "coverage") -> DataFrame:
    """rows (id, vertical, text, gold, found: arrays of struct(type, start, end)) with tp, fp, fn."""
    count = {"coverage": sensitive_coverage, "tokens": token_counts}[kind]

    @F.pandas_udf("struct<tp:bigint,fp:bigint,fn:bigint>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, golds, founds in batches:
            plain = lambda spans: [(s["type"], s["start"], s["end"]) for s in spans]
            yield pd.DataFrame([count(t, plain(g), plain(f)) for t, g, f in zip(texts, golds, founds)], columns=["tp", "fp", "fn"])

    return rows.withColumn("_c", run("text", "gold", "found")).select("*", "_c.tp", "_c.fp", "_c.fn").drop("_c")


def dedup_windows(predictions: DataFrame) -> DataFrame:
    """Model spans of overlapping windows (doc_id, start, end, label, score), the best score of each kept."""
    return predictions.groupBy("doc_id", "start", "end", "label").agg(F.max("score").alias("score"))


def model_spans(predictions: DataFrame, high: float = 0.7) -> DataFrame:
    return dedup_windows(predictions).withColumn("confidence", F.when(F.col("score") >= high, "high").otherwise("medium"))


def threshold_sweep(gold: DataFrame, rules: DataFrame, model: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of gold spans (chunk, type, start, end) that rules or a model at each threshold contain. One join, no cross product."""
    ids = ["chunk", "type", "start", "end"]
    other = rules.select("chunk", "type", F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit(float("inf")).alias("_score")).unionByName(model.select("chunk", "type", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("score").alias("_score")))
    other = other.withColumnRenamed("chunk", "_c").withColumnRenamed("type", "_t")
    hit = gold.join(other, (F.col("chunk") == F.col("_c")) & (F.col("type") == F.col("_t")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), "left")
    best = hit.groupBy(*ids).agg(F.max("_score").alias("_best"))
    shares = [F.struct(F.lit(t).alias("threshold"), F.avg((F.coalesce("_best", F.lit(-1.0)) >= t).cast("double")).alias("covered")) for t in thresholds]
    return best.agg(F.array(*shares).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def observations(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row per gold span (doc_id, type, start, end): whether a found span of its type overlaps it.

    In one pass over each document's spans, gold ones at their ends and found ones at their starts: of the found spans that start
    before a gold one ends, the farthest end tells.
    """
    kinds = dict(gold.dtypes)
    g = gold.select("doc_id", "type", "start", "end", F.col("end").alias("_at"), F.lit(0).alias("_found"), F.lit(None).cast(dict(found.dtypes)["end"]).alias("_e"))
    f = found.filter("doc_id IS NOT NULL AND type IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    f = f.select("doc_id", "type", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("start", "end")), F.col("start").alias("_at"), F.lit(1).alias("_found"), F.col("end").alias("_e"))
    in_order = Window.partitionBy("doc_id", "type").orderBy("_at", "_found", "start")
    row = F.struct("_found", "start", "end")
    rows = g.unionByName(f).repartition(tasks_for(g, f), "doc_id")
    rows = rows.select("*", F.max("_e").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_far"), F.lag(row).over(in_order).eqNullSafe(row).alias("_again"))
    spans = rows.filter("_found = 0 AND NOT _again")
    return spans.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("doc_id", "type", "start", "end")), F.coalesce(F.col("_far") > F.col("start"), F.lit(False)).alias("found"))


def adjudication_items(hits: DataFrame, known: DataFrame, contexts: int = 3) -> DataFrame:
    """Distinct (type, value) still without a verdict: occurrences and a few contexts."""
    open_ = hits.join(known.select("type", "value").distinct(), ["type", "value"], "left_anti")
    return open_.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("context")), 1, contexts).alias("contexts"))
