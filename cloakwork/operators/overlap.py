"""Span algebra: overlap resolution, rewriting, masking, suppression."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Span:
    type: str
    start: int
    end: int
    raw: str
    confidence: str = "high"
    source: str | None = "rule"
    identity: str | None = None


def span_key(s: Span) -> tuple[str, int, int]:
    return s.type, s.start, s.end


def resolve(spans: list[Span]) -> list[Span]:
    """Greedy choice without overlaps: rules before models (no source counts as a model), high before medium
    confidence, longer first, earlier first. Kept spans are disjoint, so one search finds a conflict."""
    order = sorted(spans, key=lambda s: (s.source != "rule", s.confidence != "high", s.start - s.end, s.start))
    starts: list[int] = []
    kept: list[Span] = []
    for s in order:
        at = bisect_left(starts, s.end)
        if at and kept[at - 1].end > s.start:
            continue
        starts.insert(at, s.start)
        kept.insert(at, s)
    return kept


def rewrite(text: str, replacements: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in sorted(replacements):
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def mask(text: str, spans: list[Span]) -> str:
    return rewrite(text, [(s.start, s.end, f"[{s.type}]") for s in spans])


def without(spans: list[Span], suppressed: set[tuple[str, int, int]]) -> list[Span]:
    return [s for s in spans if span_key(s) not in suppressed]


def moved(s: Span, start: int, end: int, text: str) -> Span:
    return replace(s, start=start, end=end, raw=text[start:end])
