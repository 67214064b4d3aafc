"""Russian names: parsing, declension by rule tables, lemmas by inflecting back, agreement with numbers.

Tables follow school grammar: endings by declension type. Cases: nom gen dat acc ins pre.
"""

from __future__ import annotations

import re
from typing import NamedTuple, Protocol

CASES = ("nom", "gen", "dat", "acc", "ins", "pre")
EASTERN = ("оглы", "кызы", "гызы", "улы", "углы")


class ParsedName(NamedTuple):
    parts: tuple[str, ...]
    surname: int | None
    initials: tuple[int, ...]
    patronymic: int | None
    gender: str | None


# Endings by type of declension, in the order of CASES; "" stands for the stem itself.
_SURNAME_M = {"ов": ("", "а", "у", "а", "ым", "е"), "ский": ("ий", "ого", "ому", "ого", "им", "ом"), "ый": ("ый", "ого", "ому", "ого", "ым", "ом"), "hard": ("", "а", "у", "а", "ом", "е"), "soft": ("ь", "я", "ю", "я", "ем", "е"), "й": ("й", "я", "ю", "я", "ем", "е")}
_SURNAME_F = {"ова": ("а", "ой", "ой", "у", "ой", "ой"), "ская": ("ая", "ой", "ой", "ую", "ой", "ой")}
_NAME = {"а": ("а", "ы", "е", "у", "ой", "е"), "я": ("я", "и", "е", "ю", "ей", "е"), "ия": ("ия", "ии", "ии", "ию", "ией", "ии"), "hard": ("", "а", "у", "а", "ом", "е"), "й": ("й", "я", "ю", "я", "ем", "е"), "ий": ("ий", "ия", "ию", "ия", "ием", "ии"), "ь": ("ь", "я", "ю", "я", "ем", "е"), "fь": ("ь", "и", "и", "ь", "ью", "и")}
_HUSH = "гкхжчшщ"
# Names with vowels that come and go.
_FLEETING = {"Пётр": "Петр", "Павел": "Павл", "Лев": "Льв"}


def _ends(word: str, *tails: str) -> bool:
    return word.lower().endswith(tails)


def gender_of_patronymic(word: str) -> str | None:
    if re.search("(?:вн|ичн)(?:а|ы|е|у|ой|ою)$", word, re.I):
        return "f"
    return "m" if re.search("ич(?:а|у|ем|ом|е)?$", word, re.I) else None


def parse_name(raw: str) -> ParsedName:
    """Parts of a name, which of them is the surname, and the gender: marker, patronymic, given name, surname."""
    parts = tuple(re.findall(r"[А-ЯЁ]\.|[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*", raw))
    initials = tuple(i for i, p in enumerate(parts) if p.endswith("."))
    patronymic = next((i for i, p in enumerate(parts) if len(p) > 5 and re.search("(?:[оеь]в|м|к|н|ь)ич(?:а|у|ем|ом|е)?$|(?:овн|евн|ичн)(?:а|ы|е|у|ой|ою)$", p, re.I)), None)
    marker = next((p.lower() for p in parts if p.lower() in EASTERN), None)
    words = [i for i, p in enumerate(parts) if i not in initials and i != patronymic and p.lower() not in EASTERN]
    surname = None
    if words:
        if initials:
            surname = words[0]
        elif patronymic is not None:
            surname = words[0] if words[0] == 0 and len(words) > 1 else (words[-1] if words[-1] > patronymic else None)
        else:
            surname = next((i for i in words if re.search("(?:ов|ев|ёв|ин|ын|ск|цк)(?:а|у|ым|ой|е|ого|ому|ий|ая|ую|им|ом)?$", parts[i])), words[0])
    gender = None
    if marker:
        gender = "f" if marker in ("кызы", "гызы") else "m"
    elif patronymic is not None:
        gender = gender_of_patronymic(parts[patronymic])
    given = [i for i in words if i != surname]
    if gender is None and given:
        gender = "f" if _ends(parts[given[0]], "а", "я") and parts[given[0]] not in ("Никита", "Илья", "Фома", "Лука", "Кузьма", "Савва") else "m"
    if gender is None and surname is not None:
        gender = "f" if _ends(parts[surname], "ова", "ева", "ёва", "ина", "ына", "ская", "цкая", "овой", "евой", "иной", "ской") else "m" if _ends(parts[surname], "ов", "ев", "ёв", "ин", "ын", "ский", "цкий") else None
    return ParsedName(parts, surname, initials, patronymic, gender)


def _by_hyphen(f):
    def each(word: str, *rest):
        return "-".join(f(p, *rest) if p[:1].isupper() else p for p in word.split("-"))

    return each


def _fix(stem: str, ending: str) -> str:
    """Spelling after hushing consonants and ц: ы becomes и, unstressed о becomes е."""
    if stem and stem[-1].lower() in _HUSH and ending.startswith("ы"):
        ending = "и" + ending[1:]
    if stem and stem[-1].lower() in "жчшщц" and ending in ("ом", "ой"):
        ending = "е" + ending[1:]
    return stem + ending


@_by_hyphen
def inflect_surname(surname: str, case: str, gender: str | None) -> str:
    at, low = CASES.index(case), surname.lower()
    if re.search("(?:ых|их|о|е|э|и|ы|у|ю|аго|яго|ово)$", low) or not low:
        return surname
    if gender == "f":
        if low.endswith(("ова", "ева", "ёва", "ина", "ына")):
            return surname[:-1] + _SURNAME_F["ова"][at]
        if low.endswith("ая"):
            return surname[:-2] + _SURNAME_F["ская"][at]
        if low.endswith(("а", "я")):
            return inflect_name(surname, case, "f")
        return surname
    if low.endswith(("ов", "ев", "ёв", "ин", "ын")):
        return surname + _SURNAME_M["ов"][at]
    if low.endswith(("ский", "цкий", "жний", "ший", "кий", "гий", "хий")):
        return surname[:-2] + _SURNAME_M["ский"][at]
    if low.endswith(("ый", "ой")):
        return surname[:-2] + (surname[-2:] if at == 0 else _SURNAME_M["ый"][at])
    if low.endswith("й"):
        return surname[:-1] + _SURNAME_M["й"][at]
    if low.endswith("ь"):
        return surname[:-1] + _SURNAME_M["soft"][at]
    if low.endswith(("а", "я")):
        return inflect_name(surname, case, "m")
    return _fix(surname, _SURNAME_M["hard"][at])


@_by_hyphen
def inflect_name(name: str, case: str, gender: str | None) -> str:
    at, low = CASES.index(case), name.lower()
    if low.endswith("ия"):
        return name[:-2] + _NAME["ия"][at]
    if low.endswith("а"):
        return _fix(name[:-1], _NAME["а"][at])
    if low.endswith("я"):
        return name[:-1] + _NAME["я"][at]
    if gender == "f":
        return name[:-1] + _NAME["fь"][at] if low.endswith("ь") else name
    if low.endswith("ий"):
        return name[:-2] + _NAME["ий"][at]
    if low.endswith("й"):
        return name[:-1] + _NAME["й"][at]
    if low.endswith("ь"):
        return name[:-1] + _NAME["ь"][at]
    if low[-1:] in "оеиуюыэ":
        return name
    stem = _FLEETING.get(name, name) if at else name
    return _fix(stem, _NAME["hard"][at])


@_by_hyphen
def inflect_patronymic(word: str, case: str, gender: str | None) -> str:
    at = CASES.index(case)
    if word.lower().endswith("а"):
        return word[:-1] + ("а", "ы", "е", "у", "ой", "е")[at]
    return word + ("", "а", "у", "а", "ем", "е")[at]


def inflect_part(name: ParsedName, i: int, case: str) -> str:
    part = name.parts[i]
    if i in name.initials or part.lower() in EASTERN:
        return part
    if i == name.patronymic:
        return inflect_patronymic(part, case, name.gender)
    return inflect_surname(part, case, name.gender) if i == name.surname else inflect_name(part, case, name.gender)


def inflect_full(value: str, case: str, gender: str | None = None) -> str:
    """A full name in a case, its separators kept."""
    name = parse_name(value)
    if gender:
        name = name._replace(gender=gender)
    out, at = [], 0
    for i, part in enumerate(name.parts):
        place = value.index(part, at)
        out += [value[at:place], inflect_part(name, i, case)]
        at = place + len(part)
    return "".join(out) + value[at:]


def full_forms(value: str, gender: str | None = None) -> list[str]:
    return list(dict.fromkeys(inflect_full(value, c, gender) for c in CASES))


def surname_forms(surname: str, gender: str | None) -> list[str]:
    return list(dict.fromkeys(inflect_surname(surname, c, gender) for c in CASES))


_ENDINGS = ("", "а", "у", "ым", "ом", "ем", "е", "ой", "ого", "ому", "им", "ую", "ю", "я", "ы", "и", "ей", "ии", "ию", "ией", "ием", "ью")
_RESTORED = ("", "а", "я", "ь", "й", "ий", "ый", "ой", "ая", "ия")


def _candidates(surface: str) -> list[str]:
    low = surface.lower()
    made = (surface[: len(surface) - len(e)] + r for e in _ENDINGS if low.endswith(e) and len(surface) - len(e) >= 2 for r in _RESTORED)
    return list(dict.fromkeys(c for c in made if not re.search("[аеёиоуыэюя]ь$|[^аеёиоуыэюя]й$", c, re.I)))


def _preference(word: str, gender: str | None) -> tuple:
    typical = ("ова", "ева", "ёва", "ина", "ская", "цкая") if gender == "f" else ("ов", "ев", "ёв", "ин", "ский", "цкий")
    return (not _ends(word, *typical), gender == "f" and not _ends(word, "а", "я"), len(word))


def lemmatize_surname(surface: str, gender: str | None) -> str:
    """The nominative that inflects back to the surface form; the surface itself if none does."""
    if "-" in surface:
        return "-".join(lemmatize_surname(p, gender) for p in surface.split("-"))
    good = [c for c in _candidates(surface) if any(inflect_surname(c, k, gender) == surface for k in CASES)]
    return min(good, key=lambda w: (_preference(w, gender), w != surface), default=surface)


def infer_surname_case(surface: str, gender: str | None) -> str:
    lemma = lemmatize_surname(surface, gender)
    return next((c for c in CASES if inflect_surname(lemma, c, gender) == surface), "nom")


def lemmatize_name(surface: str, gender: str | None, inflect=inflect_name) -> str:
    if inflect is inflect_patronymic:
        return re.sub("(?<=ич)(?:а|у|ем|ом|е)$", "", surface) if gender != "f" else re.sub("(?<=н)(?:ы|е|у|ой|ою)$", "а", surface)
    good = [c for c in _candidates(surface) if c[-1:] not in "оеуюы" and any(inflect(c, k, gender) == surface for k in CASES)]
    if gender == "f":
        return min(good, key=lambda w: (not _ends(w, "а", "я"), w != surface, len(w)), default=surface)
    if not _ends(surface, "ом", "ем", *"аеёиоуыэюя"):
        return surface
    return min(good, key=lambda w: (_ends(w, "а", "я", "ом", "ем"), len(w)), default=surface)


def lemma_of(raw: str) -> ParsedName:
    """A name with its parts in the nominative."""
    name = parse_name(raw)
    parts = []
    for i, p in enumerate(name.parts):
        if i in name.initials or p.lower() in EASTERN:
            parts.append(p)
        elif i == name.patronymic:
            parts.append(lemmatize_name(p, name.gender, inflect_patronymic))
        else:
            parts.append(lemmatize_surname(p, name.gender) if i == name.surname else lemmatize_name(p, name.gender))
    return name._replace(parts=tuple(parts))


def plural_index(n: int) -> int:
    n = abs(n)
    return 2 if 11 <= n % 100 <= 14 else 0 if n % 10 == 1 else 1 if 2 <= n % 10 <= 4 else 2


class MorphAdapter(Protocol):
    def analyze(self, raw: str, type_: str) -> dict | None: ...
    def inflect(self, value: str, form: dict, type_: str) -> str: ...
    def agree_with_number(self, forms: tuple[str, str, str], n: int) -> str: ...


class LocalMorph:
    """Names by the rules above; other types unchanged."""

    def analyze(self, raw: str, type_: str) -> dict | None:
        if type_ != "PER":
            return None
        name, lemma = parse_name(raw), lemma_of(raw)
        case = infer_surname_case(name.parts[name.surname], name.gender) if name.surname is not None else "nom"
        return {"lemma": " ".join(lemma.parts), "gender": name.gender, "case": case}

    def inflect(self, value: str, form: dict, type_: str) -> str:
        return inflect_full(value, form.get("case") or "nom", form.get("gender")) if type_ == "PER" else value

    def agree_with_number(self, forms: tuple[str, str, str], n: int) -> str:
        return forms[plural_index(n)]


class NoMorph(LocalMorph):
    """Leaves every value as it is."""

    def analyze(self, raw: str, type_: str) -> dict | None:
        return None

    def inflect(self, value: str, form: dict, type_: str) -> str:
        return value
