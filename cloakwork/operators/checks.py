"""Checksums as plain Python, for validators inside the detection function."""

from __future__ import annotations

from cloakwork.functions.checksums import INN10, INN11, INN12


def _dot(v: str, weights) -> int:
    return sum(int(c) * w for c, w in zip(v, weights))


def inn(v: str) -> bool:
    if not v.isdigit() or len(set(v)) == 1:
        return False
    if len(v) == 10:
        return _dot(v, INN10) % 11 % 10 == int(v[9])
    return len(v) == 12 and _dot(v, INN11) % 11 % 10 == int(v[10]) and _dot(v, INN12) % 11 % 10 == int(v[11])


def ogrn(v: str) -> bool:
    return len(v) == 13 and v.isdigit() and v[0] in "15" and int(v[:12]) % 11 % 10 == int(v[12])


def ogrnip(v: str) -> bool:
    return len(v) == 15 and v.isdigit() and v[0] == "3" and int(v[:14]) % 13 % 10 == int(v[14])


def snils(v: str) -> bool:
    if len(v) != 11 or not v.isdigit():
        return False
    total = _dot(v, range(9, 0, -1))
    check = total if total < 100 else 0 if total in (100, 101) else total % 101 % 100
    return check == int(v[9:])


def bik(v: str) -> bool:
    return len(v) == 9 and v.isdigit() and v[:2] in ("00", "01", "04") and len(set(v)) > 1


def account(v: str, bank: str) -> bool:
    if len(v) != 20 or not v.isdigit() or not bik(bank):
        return False
    weights = (7, 1, 3) * 8
    return any(_dot(head + v, weights) % 10 == 0 for head in (bank[6:], "0" + bank[4:6]))


def card(v: str) -> bool:
    v = v.replace(" ", "").replace("-", "")
    if not 13 <= len(v) <= 19 or not v.isdigit() or len(set(v)) == 1:
        return False
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(v))) % 10 == 0
