"""Detection over one text, and the Arrow function that applies it to a column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators import coords, legend
from cloakwork.operators.normalize import Normalized, normalize, soften_caps, to_source
from cloakwork.operators.overlap import Span, mask, resolve
from cloakwork.operators.registry import TYPES
from cloakwork.operators.rules import RULES, Rule

SPANS = "array<struct<type:string,start:int,end:int,raw:string,confidence:string,source:string,identity:string>>"
_CAPS_WORD = re.compile("[А-ЯЁ]{4,}")


def one_rule(r: Rule, text: str) -> list[Span]:
    out = []
    for m in r.pattern.finditer(text):
        if r.check is None or r.check(m, text):
            start, end = m.span(r.group)
            while end > start and text[end - 1] in " \t\u00a0":
                end -= 1
            out.append(Span(r.type, start, end, text[start:end], r.confidence, "rule"))
    return out


def rule_spans(text: str, types: frozenset[str]) -> list[Span]:
    return [s for r in RULES if r.type in types for s in one_rule(r, text)]


def detect(text: str | None, types: list[str] | frozenset[str]) -> list[Span]:
    """Normalise, run the rules of the wanted types, again over softened capitals if there are any, add
    legends and coordinates, resolve overlaps, and return spans of the source text."""
    if not text:
        return []
    wanted = frozenset(types)
    n = normalize(text)
    found = rule_spans(n.text, wanted)
    if _CAPS_WORD.search(n.text):
        soft = soften_caps(n.text)
        if soft != n.text:
            found += [Span(s.type, s.start, s.end, n.text[s.start : s.end], s.confidence, s.source) for s in rule_spans(soft, wanted)]
    if "GEO_NAME" in wanted:
        found += [Span("GEO_NAME", at, at + len(raw), raw, "medium", "rule") for at, raw in legend.detect(n.text)]
    if "COORD" in wanted:
        found += [Span("COORD", c.start, c.end, c.raw, "high", "rule") for c in coords.detect(n.text)]
    return sorted((_mapped(s, n, text) for s in resolve(list(dict.fromkeys(found)))), key=lambda s: s.start)


def _mapped(s: Span, n: Normalized, text: str) -> Span:
    start, end = to_source(n, s.start, s.end)
    return Span(s.type, start, end, text[start:end], s.confidence, s.source, s.identity)


def as_rows(spans: list[Span]) -> list[dict]:
    return [{"type": s.type, "start": s.start, "end": s.end, "raw": s.raw, "confidence": s.confidence, "source": s.source, "identity": s.identity} for s in spans]


def detect_spans(text: Column, types: list[str]) -> Column:
    """Spans of a text column, in Arrow batches. Only rules of the wanted types run."""
    wanted = frozenset(t for t in types if t in TYPES)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: as_rows(detect(t, wanted)))

    return run(text)


def rule_hits(text: Column, rule: Column) -> Column:
    """What the rule named beside each text finds in it as it stands, before any repair or choice among overlaps."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[s.raw for r in RULES if r.id == name for s in one_rule(r, t or "")] for t, name in zip(texts, names)], dtype=object)

    return run(text, rule)


def mask_text(text: Column, types: list[str]) -> Column:
    wanted = frozenset(types)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else mask(t, detect(t, wanted)))

    return run(text)
