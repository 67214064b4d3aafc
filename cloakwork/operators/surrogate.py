"""Hiding operators: placeholders, and surrogates that look like the original.

Draws are seeded by an HMAC of a scope's salt, type and value, so a value has one surrogate in a scope.
"""

from __future__ import annotations

import hashlib
import hmac
import random
import re
from collections.abc import Callable
from datetime import date, timedelta

from cloakwork.operators import checks, morph

ATTEMPTS, TAIL_TRIES = 8, 100
# Own choice: invented people, companies, streets.
SURNAMES = "Берёзов Осинин Тополев Рябинин Вересков Лугов Озеров Полянский Ключевский Заречный".split()
NAMES_M, NAMES_F = "Андрей Борис Виктор Глеб Денис Егор Кирилл Максим".split(), "Алла Вера Галина Дарья Елена Жанна Инна Ксения".split()
COMPANIES = "Горизонт Меридиан Вектор Спектр Азимут Контур Квант Орион".split()
STREETS = "Садовая Луговая Речная Лесная Полевая Озёрная".split()


def salt_of(seed_key: bytes, scope: str) -> bytes:
    return hmac.new(seed_key, scope.encode(), hashlib.sha256).digest()


def seed_for(salt: bytes, type_: str, value: str) -> int:
    """First four bytes, big-endian."""
    return int.from_bytes(hmac.new(salt, f"{type_}\0{value}".encode(), hashlib.sha256).digest()[:4], "big")


def replace_digits(raw: str, seed: int) -> str:
    rng = random.Random(seed)
    return re.sub("[0-9]", lambda m: str(rng.randrange(10)), raw)


def valid_number(seed: int, length: int, valid: Callable[[str], bool], prefix: str = "") -> str | None:
    rng = random.Random(seed)
    body = prefix + "".join(str(rng.randrange(10)) for _ in range(length - len(prefix) - 2))
    start = rng.randrange(TAIL_TRIES)
    for i in range(TAIL_TRIES):
        if valid(v := body + f"{(start + i) % TAIL_TRIES:02d}"):
            return v
    return None


def shifted_date(raw: str, scope_seed: int) -> str | None:
    """D.M.Y, D/M/Y (two-digit years are 20YY) or ISO, moved by the scope's days (seed mod 731, less 365)."""
    m = re.fullmatch(r"([0-9]{1,2})([./])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})", raw)
    iso = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", raw)
    try:
        if m:
            year = int(m.group(4)) + (2000 if len(m.group(4)) == 2 else 0)
            day = date(year, int(m.group(3)), int(m.group(1)))
        elif iso:
            day = date(*map(int, iso.groups()))
        else:
            return None
        day += timedelta(days=scope_seed % 731 - 365)
    except (ValueError, OverflowError):
        return None
    return day.isoformat() if iso else f"{day.day:02d}{m.group(2)}{day.month:02d}{m.group(2)}{day.year:04d}"


def shifted_coord(raw: str, seed: int) -> str:
    """Degrees stay; minutes, seconds and fractions are drawn anew."""
    rng = random.Random(seed)
    state = {"n": 0}

    def one(m: re.Match) -> str:
        whole, fraction = m.group(1), m.group(2)
        state["n"] += 1
        degree = re.match(r"[  ]?[°ºo˚]", raw[m.end() :]) or (fraction and len(fraction) >= 5)
        whole = whole if degree else f"{rng.randrange(60):0{len(whole)}d}"
        return whole + (fraction[0] + "".join(str(rng.randrange(10)) for _ in fraction[1:]) if fraction else "")

    return re.sub(r"([0-9]+)([.,][0-9]+)?", one, raw)


def _person(raw: str, rng: random.Random) -> str:
    name = morph.parse_name(raw)
    gender = name.gender or "m"
    surname = rng.choice(SURNAMES)
    if gender == "f":
        surname = surname[:-2] + "ая" if surname.endswith(("ский", "ный")) else surname + "а"
    given = rng.choice(NAMES_F if gender == "f" else NAMES_M)
    return f"{surname} {given[0]}.{rng.choice('АВГДЕИКМНП')}." if name.initials else f"{surname} {given}"


def generated(type_: str, raw: str, seed: int, scope_seed: int) -> str | None:
    rng = random.Random(seed)
    if type_ == "PER":
        return _person(raw, rng)
    if type_ == "ORG":
        form = re.match(r"[А-ЯЁ]{2,4}(?=[ \t ]*[«\"“])", raw)
        return (form.group() + " " if form else "") + f"«{rng.choice(COMPANIES)}-{rng.randrange(10, 99)}»"
    if type_ == "EMAIL":
        return f"user{rng.randrange(1000, 9999)}@example.com"
    if type_ == "ADDR":
        return f"г. Новый, ул. {rng.choice(STREETS)}, д. {rng.randrange(1, 99)}"
    if type_ == "DATE":
        return shifted_date(raw, scope_seed)
    if type_ == "COORD":
        return shifted_coord(raw, seed)
    digits = re.sub("[^0-9]", "", raw)
    kinds = {"INN": (checks.inn, ""), "OGRN": (checks.ogrn, "1"), "OGRNIP": (checks.ogrnip, "3"), "SNILS": (checks.snils, ""), "CARD": (checks.card, "4")}
    if type_ in kinds and len(digits) >= 10:
        number = valid_number(seed, len(digits), *kinds[type_])
        if number is None:
            return None
        left = iter(number)
        return re.sub("[0-9]", lambda m: next(left), raw)
    return replace_digits(raw, seed) if digits else None


def placeholder(type_: str, token: str, raw: str, **_) -> str:
    return token


def surrogate(type_: str, token: str, raw: str, *, salt: bytes, taken: set[str] = frozenset(), source: str = "", identity: str | None = None) -> str:
    """Up to eight draws; one that is taken or stands in the source is no good, nor a person whose surname does. Else the token."""
    seed, scope_seed = seed_for(salt, type_, identity or raw), seed_for(salt, "DATE", "shift")
    for attempt in range(ATTEMPTS):
        made = generated(type_, raw, seed + attempt, scope_seed)
        if made and made not in taken and made not in source and not (type_ == "PER" and made.split()[0] in source):
            return made
    return token
