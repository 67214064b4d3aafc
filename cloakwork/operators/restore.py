"""Restoring originals in a text that may have bent its placeholders.

Tiers, each over what the ones before left: surrogate forms in any case (morph), exact tokens, tokens whose
normal form is equal (loose), and tokens with the same number and a type one edit away, if only one type is
that near (fuzzy). What stays unresolved is an orphan.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from cloakwork.operators import morph
from cloakwork.operators.overlap import rewrite

MAX_CANDIDATE = 40
TOKEN = re.compile(r"\[([A-Z][A-Z_]*)_([0-9]+)\]")
_CANDIDATE = re.compile(r"[\[({<*`_\\]{0,4}[ ]?[A-Za-z]{2,20}(?:_[A-Za-z]{2,12}){0,2}[ ]?[_\-–— \\]{1,3}[0-9]{1,6}[ ]?[\])}>*`_\\]{0,4}")
# Prepositions that govern a case.
PREPOSITIONS = {"от": "gen", "у": "gen", "для": "gen", "без": "gen", "из": "gen", "к": "dat", "ко": "dat", "по": "dat", "с": "ins", "со": "ins", "перед": "ins", "между": "ins", "о": "pre", "об": "pre", "при": "pre", "через": "acc", "про": "acc"}


@dataclass
class Entry:
    token: str
    type: str
    raw: str
    identity: str | None = None
    gender: str | None = None
    uses: dict[str, str] = field(default_factory=dict)
    occurrences: list[tuple[str | None, str]] = field(default_factory=list)
    surface: str | None = None


@dataclass
class Result:
    text: str
    restored: int
    orphans: list[str]
    by_tier: Counter


def parse_candidate(s: str) -> tuple[str, int] | None:
    """Type in upper case and number of a bent placeholder, markup dropped."""
    bare = re.sub(r"[\[\](){}<>*`\\]", "", s).strip(" _").upper()
    m = re.fullmatch(r"([A-Z][A-Z_ ]*?)[ _\-–—]+([0-9]+)", bare)
    return (m.group(1).replace(" ", "_"), int(m.group(2))) if m and len(s) <= MAX_CANDIDATE else None


def levenshtein_within(a: str, b: str, most: int) -> int | None:
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def cue_before(text: str, at: int) -> str | None:
    m = re.search(r"([A-Za-zА-Яа-яЁё0-9-]+)\.?[  ]*$", text[max(0, at - 48) : at])
    return m.group(1).lower() if m else None


def original_for(e: Entry, text: str, at: int, nth: int) -> str:
    """The form that stood here, else after this cue, else in the preposition's case, else as first kept."""
    cue = cue_before(text, at)
    if nth < len(e.occurrences) and e.occurrences[nth][0] == cue:
        return e.occurrences[nth][1]
    if cue in e.uses:
        return e.uses[cue]
    if e.type == "PER" and cue in PREPOSITIONS:
        lemma = " ".join(morph.lemma_of(e.raw).parts)
        return morph.inflect_full(lemma, PREPOSITIONS[cue], e.gender)
    return e.raw


def surrogate_forms(vault: list[Entry]) -> dict[str, str]:
    """Every case of a surrogate to the original in the same case; longest first is up to the reader."""
    out: dict[str, str] = {}
    for e in vault:
        if e.surface and e.surface != e.token:
            if e.type == "PER":
                for c in morph.CASES:
                    out.setdefault(morph.inflect_full(e.surface, c), morph.inflect_full(" ".join(morph.lemma_of(e.raw).parts) if c != "nom" else e.raw, c))
            out[e.surface] = e.raw
    return out


def spans(text: str, vault: list[Entry], fuzzy: bool = True, forms: bool = True) -> tuple[list[tuple[int, int, str, str]], list[str]]:
    """Replacements (start, end, original, tier) without overlaps, and orphans."""
    by_key = {}
    for e in vault:
        m = TOKEN.fullmatch(e.token)
        if m:
            by_key[m.group(1), int(m.group(2))] = e
    types = {t for t, _ in by_key}
    claimed: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    nth: Counter = Counter()

    def claim(start: int, end: int, new: str, tier: str) -> None:
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            claimed.append((start, end, new, tier))

    known = surrogate_forms(vault) if forms else {}
    if known:
        pattern = re.compile("(?<![А-Яа-яЁёA-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + ")(?![А-Яа-яЁёA-Za-z0-9])")
        for m in pattern.finditer(text):
            claim(m.start(), m.end(), known[m.group()], "morph")
    orphans = []
    for m in TOKEN.finditer(text):
        e = by_key.get((m.group(1), int(m.group(2))))
        if e and e.token == m.group():
            claim(m.start(), m.end(), original_for(e, text, m.start(), nth[e.token]), "exact")
            nth[e.token] += 1
    for m in _CANDIDATE.finditer(text) if fuzzy else TOKEN.finditer(text):
        if any(taken[m.start() : m.end()]):
            continue
        key = parse_candidate(m.group())
        if not key:
            continue
        e, tier = by_key.get(key) if fuzzy else None, "loose"
        if e is None and fuzzy:
            near = [(d, t) for t in types if (t, key[1]) in by_key and (d := levenshtein_within(key[0], t, 1)) is not None]
            if len(near) == 1:
                e, tier = by_key[near[0][1], key[1]], "fuzzy"
        lead = len(m.group()) - len(m.group().lstrip(" "))
        if e is not None:
            claim(m.start() + lead, m.end() - (len(m.group()) - len(m.group().rstrip(" "))), original_for(e, text, m.start(), nth[e.token]), tier)
            nth[e.token] += 1
        elif key[0] in types or TOKEN.fullmatch(m.group()):
            orphans.append(m.group().strip())
    return sorted(claimed), orphans


def restore(text: str, vault: list[Entry], fuzzy: bool = True) -> Result:
    found, orphans = spans(text, vault, fuzzy)
    return Result(rewrite(text, [f[:3] for f in found]), len(found), orphans, Counter(f[3] for f in found))


def describe_orphans(r: Result) -> str | None:
    if not r.orphans:
        return None
    counts = Counter((parse_candidate(o) or ("?", 0))[0] for o in r.orphans)
    return ", ".join(f"{t}: {n}" for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
