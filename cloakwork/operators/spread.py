"""Propagation: what one place of a document proves, other places of it inherit."""

from __future__ import annotations

import re

from cloakwork.operators import morph
from cloakwork.operators.overlap import Span
from cloakwork.operators.precision import is_false_person

_LETTER = re.compile("[А-Яа-яЁёA-Za-z0-9]")


def occurrences(text: str, form: str) -> list[int]:
    """Where a form stands as a whole word."""
    out, at = [], text.find(form) if form else -1
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + len(form) : at + len(form) + 1]
        if not _LETTER.match(before or " ") and not _LETTER.match(after or " "):
            out.append(at)
        at = text.find(form, at + 1)
    return out


def _free(text: str, at: int, form: str, taken: list[tuple[int, int]]) -> bool:
    return all(at + len(form) <= s or e <= at for s, e in taken)


def _forms(name: morph.ParsedName, i: int) -> list[str]:
    return list(dict.fromkeys(morph.inflect_part(name, i, c) for c in morph.CASES))


def spread_identities(text: str, spans: list[Span]) -> list[Span]:
    """Parts of confirmed people (two parts or more, with patronymic or initials) in all cases, elsewhere in the text.

    A form is not used if it occurs in lower case in the text or belongs to two people, or is shorter than three letters.
    """
    owners: dict[str, set[str]] = {}
    for s in spans:
        if s.type != "PER":
            continue
        name = morph.lemma_of(s.raw)
        if len(name.parts) < 2 or (name.patronymic is None and not name.initials):
            continue
        identity = s.identity or " ".join(name.parts)
        for i, part in enumerate(name.parts):
            if i not in name.initials and len(part) > 2 and part.lower() not in morph.EASTERN:
                for form in _forms(name, i):
                    owners.setdefault(form, set()).add(identity)
    words = set(re.findall("[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*", text))
    taken = [(s.start, s.end) for s in spans]
    out = []
    for form, who in owners.items():
        if len(who) != 1 or form.lower() in words or form not in text:
            continue
        for at in occurrences(text, form):
            if _free(text, at, form, taken):
                out.append(Span("PER", at, at + len(form), form, "medium", "rule", next(iter(who))))
    return out


def spread_surfaces(text: str, spans: list[Span]) -> list[Span]:
    """Every span's own spelling, verbatim, wherever it stands as a whole word."""
    taken = [(s.start, s.end) for s in spans]
    out = []
    seen = set()
    for s in spans:
        raw = s.raw.strip()
        if len(raw) < 3 or (s.type, raw) in seen:
            continue
        seen.add((s.type, raw))
        for at in occurrences(text, raw):
            if _free(text, at, raw, taken) and not (s.type == "PER" and is_false_person(raw, text, at)):
                out.append(Span(s.type, at, at + len(raw), raw, s.confidence, s.source, s.identity))
                taken.append((at, at + len(raw)))
    return out


_STRONG = re.compile("участ|площад|месторожд|проявлен", re.I)
_TAIL = re.compile("(?:ого|ому|ыми|ими|ой|ей|ом|ем|ым|им|ую|ая|ое|ый|ий|а|я|у|ю|е|ы|и|ь|о)$")
MIN_STEM, MAX_TAIL, KEY_BACK, STEPS, WINDOW = 4, 4, 40, 6, 90


def stem(word: str) -> str:
    return _TAIL.sub("", word)


def spread_geo_names(text: str, spans: list[Span]) -> list[Span]:
    """Names seen with a strong key, by stem plus up to four letters; not if the stem occurs in lower case."""
    taken = [(s.start, s.end) for s in spans]
    out = []
    for s in spans:
        if s.type != "GEO_NAME" or not (_STRONG.search(s.raw) or _STRONG.search(text[max(0, s.start - KEY_BACK) : s.start])):
            continue
        word = re.search("[А-ЯЁ][а-яё-]+", s.raw)
        base = stem(word.group()) if word else ""
        if len(base) < MIN_STEM or re.search(rf"(?<![А-Яа-яЁё]){base.lower()}[а-яё]{{0,{MAX_TAIL}}}(?![А-Яа-яЁё])", text):
            continue
        for m in re.finditer(rf"(?<![А-Яа-яЁё]){base}[а-яё]{{0,{MAX_TAIL}}}(?![А-Яа-яЁё])", text):
            if _free(text, m.start(), m.group(), taken):
                out.append(Span("GEO_NAME", m.start(), m.end(), m.group(), "medium", "rule", s.identity))
                taken.append(m.span())
    return out


def enumerate_neighbours(text: str, s: Span) -> list[Span]:
    """Further names of an enumeration: to the right by comma, semicolon or "и", to the left by "и" only."""
    out = []
    at = s.end
    for _ in range(STEPS):
        m = re.match(r"(?:[ \t ]*\([^)\n]{1,40}\))?[ \t ]*(?:[,;]|и(?=[ \t ]))[ \t ]*([А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)(?![А-Яа-яЁё.])", text[at : at + WINDOW])
        if not m:
            break
        start = at + m.start(1)
        if len(m.group(1)) >= MIN_STEM:
            out.append(Span(s.type, start, start + len(m.group(1)), m.group(1), "medium", "rule"))
        at += m.end()
    left = re.search(r"(?<![А-Яа-яЁё])([А-ЯЁ][а-яё]{3,}(?:-[А-ЯЁ][а-яё]+)?)[ \t ]+и[ \t ]+$", text[max(0, s.start - WINDOW) : s.start])
    if left:
        start = max(0, s.start - WINDOW) + left.start(1)
        out.append(Span(s.type, start, start + len(left.group(1)), left.group(1), "medium", "rule"))
    return out
