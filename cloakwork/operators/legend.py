"""Names from map legends: bullet items below a heading that promises names."""

from __future__ import annotations

import re

_HEADING = re.compile(r"(?:условные обозначения|названия|участки|площади|месторождения|объекты|водотоки|реки|ручьи)[^\n]{0,40}:?[ \t]*$", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-–—•*]|[0-9]{1,3}[.)])[ \t]+(?P<item>.+?)[ \t]*$")
# Own choice: generic words that a name may be joined with.
_GENERIC = frozenset("участок площадь месторождение рудопроявление проявление река ручей озеро гора хребет блок зона жила".split())
MAX_LENGTH, MAX_WORDS = 44, 3


def is_name(item: str) -> bool:
    """Up to three words: generic terms, numbers or capitalised, one of them capitalised; no other marks."""
    words = item.rstrip(";,.").split()
    if not 0 < len(item) <= MAX_LENGTH or not 0 < len(words) <= MAX_WORDS or re.search(r"[:()=/%\"]|[.,;].", item):
        return False
    capital = [bool(re.fullmatch(r"[А-ЯЁ][А-Яа-яЁё-]+", w)) for w in words]
    return any(capital) and all(c or w.lower() in _GENERIC or re.fullmatch(r"№?[0-9]+", w) for c, w in zip(capital, words))


def detect(text: str) -> list[tuple[int, str]]:
    """(position, name) of legend items."""
    found, at, open_ = [], 0, False
    for line in text.split("\n"):
        item = _ITEM.match(line)
        if item:
            if open_ and is_name(item.group("item")):
                found.append((at + item.start("item"), item.group("item").rstrip(";,.")))
        elif line.strip():
            open_ = bool(_HEADING.search(line)) and not re.fullmatch(r"[-=_ ]{3,}", line.strip())
        at += len(line) + 1
    return found
