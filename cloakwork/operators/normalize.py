"""Repairs of damaged Russian text before detection, with a map from repaired to source positions.

Positions are code points. Every repair is an edit list over the current text; the map follows it.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from cloakwork.functions.text import NARROW_SPACES, ZERO_WIDTH

# Latin and Greek letters that stand for Cyrillic ones of the same shape.
LOOKALIKES = dict(zip("ABCEHKMOPTXYaceopxykmtΑΒΕΗΙΚΜΝΟΡΤΧορ", "АВСЕНКМОРТХУасеорхукмтАВЕНІКМNОРТХор"))
# Digits that stand for letters inside a word.
DIGIT_LETTERS = {"0": "о", "3": "з", "6": "б", "9": "я"}
REAL_LATIN = 3
GLUED_LENGTH, GLUED_STEPS = 14, 2
SPACED_LETTERS = 4
CAPS_WORD, CAPS_NEXT = 5, 2

_WORD = re.compile(r"[0-9A-Za-zΑ-Ωα-ωА-Яа-яЁё]+")
_CYR = re.compile(r"[А-Яа-яЁё]")


class Normalized(NamedTuple):
    text: str
    map: list[int]
    unchanged: bool


class _Work:
    def __init__(self, text: str):
        self.text, self.map, self.size = text, list(range(len(text))), len(text)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Non-overlapping replacements, in order. An inserted character maps to the next source character."""
        if not edits:
            return
        text, at, out, places = self.text, 0, [], []
        for start, end, new in edits:
            out += [text[at:start], new]
            places += self.map[at:start]
            if len(new) == end - start:
                places += self.map[start:end]
            else:
                following = self.map[end] if end < len(self.map) else self.size
                kept = self.map[start:end]
                places += [kept[i] if i < len(kept) and kept else following for i in range(len(new))]
            at = end
        out.append(text[at:])
        places += self.map[at:]
        self.text, self.map = "".join(out), places


def _characters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for i, ch in enumerate(text):
        if ch in ZERO_WIDTH:
            edits.append((i, i + 1, ""))
        elif ch in NARROW_SPACES:
            edits.append((i, i + 1, " "))
        elif "！" <= ch <= "～" or ch == "　":
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1:
                edits.append((i, i + 1, plain))
    return edits


def _emphasis(text: str) -> list[tuple[int, int, str]]:
    """Runs of one or two * or exactly two _ that touch a non-space on exactly one side."""
    edits = []
    for m in re.finditer(r"\*+|_+", text):
        n = len(m.group())
        if (m.group()[0] == "*" and n > 2) or (m.group()[0] == "_" and n != 2):
            continue
        left = m.start() > 0 and not text[m.start() - 1].isspace()
        right = m.end() < len(text) and not text[m.end()].isspace()
        word_left = left and text[m.start() - 1].isalnum()
        word_right = right and text[m.end()].isalnum()
        if left != right or (word_left != word_right):
            edits.append((m.start(), m.end(), ""))
    return edits


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _WORD.finditer(text):
        word = m.group()
        cyrillic = len(_CYR.findall(word))
        if not cyrillic:
            continue
        real = set()
        for run in re.finditer(r"[A-Za-z]{%d,}" % REAL_LATIN, word):
            real.update(range(run.start(), run.end()))
        digits = {c for c in word if c.isdigit()}
        letters = cyrillic + sum(c in LOOKALIKES and i not in real for i, c in enumerate(word))
        new = []
        for i, c in enumerate(word):
            if c in LOOKALIKES and i not in real:
                new.append(LOOKALIKES[c])
            elif c in DIGIT_LETTERS and cyrillic >= 2 and letters >= 2 and digits <= set(DIGIT_LETTERS) and not real:
                new.append(DIGIT_LETTERS[c].upper() if i == 0 or word.isupper() else DIGIT_LETTERS[c])
            else:
                new.append(c)
        new = "".join(new)
        if new != word:
            edits.append((m.start(), m.end(), new))
    return edits


_HYPHENATED = re.compile(r"(?<=[А-Яа-яЁё])[-‐­][ \t]*\r?\n[ \t]*(?=[а-яё])")
_SPACED = re.compile(r"(?<![А-Яа-яЁё])[А-Яа-яЁё](?: [А-Яа-яЁё](?![А-Яа-яЁё])){%d,}" % (SPACED_LETTERS - 1))
_GLUED = re.compile(r"[А-Яа-яЁё]{%d,}" % GLUED_LENGTH)
_SEAM = re.compile(r"(?<=[А-Яа-яЁё]{3})(?=[A-Za-z]{3})|(?<=[A-Za-z]{3})(?=[А-Яа-яЁё]{3})")


def _spaced(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPACED.finditer(text):
        edits += [(m.start() + i, m.start() + i + 1, "") for i, c in enumerate(m.group()) if c == " "]
    # A gap of several spaces between letter-spaced words is one word boundary.
    return edits


def _glued(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _GLUED.finditer(text):
        steps = [i for i in range(1, len(m.group())) if m.group()[i - 1].islower() and m.group()[i].isupper()]
        if len(steps) >= GLUED_STEPS:
            edits += [(m.start() + i, m.start() + i, " ") for i in steps]
    return edits


def normalize(text: str) -> Normalized:
    work = _Work(text)
    for step in (_characters, _emphasis, _look_alikes):
        work.edit(step(work.text))
    work.edit([(m.start(), m.end(), "") for m in _HYPHENATED.finditer(work.text)])
    work.edit(_spaced(work.text))
    work.edit(_glued(work.text))
    work.edit([(m.start(), m.start(), " ") for m in _SEAM.finditer(work.text)])
    return Normalized(work.text, work.map, work.text == text)


def to_source(n: Normalized, start: int, end: int) -> tuple[int, int]:
    """A span of the repaired text in source positions."""
    if n.unchanged or end <= start:
        return start, end
    return n.map[start], n.map[end - 1] + 1


_CAPS = re.compile(r"(?<![A-Za-zА-Яа-яЁё])[А-ЯЁ]{%d,}(?:-[А-ЯЁ]+)*(?:[ \t]+[А-ЯЁ]{%d,}(?:-[А-ЯЁ]+)*)*(?![А-Яа-яЁё])" % (CAPS_WORD, CAPS_NEXT))


def soften_caps(text: str) -> str:
    """ALL-CAPS phrases to Title Case, length kept; lone short acronyms stay."""
    return _CAPS.sub(lambda m: re.sub(r"[А-ЯЁ]+", lambda w: w.group()[0] + w.group()[1:].lower(), m.group()), text)
