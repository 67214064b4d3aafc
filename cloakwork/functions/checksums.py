"""Checksums of identifiers as native column expressions (public formats; no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_digits(v: Column) -> Column:
    return v.rlike(r"^([0-9])\1*$")


def _digit(v: Column, position: int) -> Column:
    return F.substring(v, position, 1).try_cast("int")


def _weighted(v: Column, weights: tuple[int, ...], first: int = 1) -> Column:
    terms = [_digit(v, first + i) * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _valid(shape: Column, rule: Column) -> Column:
    return F.coalesce(F.when(shape, rule).otherwise(False), F.lit(False))


#: Weights of the taxpayer number's check digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def is_valid_inn(v: Column) -> Column:
    """Taxpayer number of 10 or 12 digits."""
    ten = v.rlike("^[0-9]{10}$") & (_weighted(v, INN10) % 11 % 10 == _digit(v, 10))
    twelve = v.rlike("^[0-9]{12}$") & (_weighted(v, INN11) % 11 % 10 == _digit(v, 11)) & (_weighted(v, INN12) % 11 % 10 == _digit(v, 12))
    return _valid(v.rlike("^([0-9]{10}|[0-9]{12})$") & ~_same_digits(v), F.coalesce(ten, F.lit(False)) | F.coalesce(twelve, F.lit(False)))


def is_valid_ogrn(v: Column) -> Column:
    """Company registration number: 13 digits, the first 1 or 5."""
    return _valid(v.rlike("^[15][0-9]{12}$"), F.substring(v, 1, 12).try_cast("bigint") % 11 % 10 == _digit(v, 13))


def is_valid_ogrnip(v: Column) -> Column:
    """Sole trader registration number: 15 digits, the first 3."""
    return _valid(v.rlike("^3[0-9]{14}$"), F.substring(v, 1, 14).try_cast("bigint") % 13 % 10 == _digit(v, 15))


def is_valid_snils(v: Column) -> Column:
    """Insurance number of 11 digits; the last two check the weighted sum of the first nine."""
    total = _weighted(v, (9, 8, 7, 6, 5, 4, 3, 2, 1))
    check = F.when(total < 100, total).when(total.isin(100, 101), 0).otherwise(F.when(total % 101 == 100, 0).otherwise(total % 101))
    return _valid(v.rlike("^[0-9]{11}$"), check == F.substring(v, 10, 2).try_cast("int"))


def is_valid_bik(v: Column) -> Column:
    """Bank code: 9 digits that start with 00, 01 or 04, not all the same."""
    return _valid(v.rlike("^0[014][0-9]{7}$"), ~_same_digits(v))


def is_valid_account(account: Column, bik: Column) -> Column:
    """Account of 20 digits, checked with its bank code by weights 7, 1, 3."""
    weights = (7, 1, 3) * 7 + (7, 1)
    own = _weighted(F.concat(F.substring(bik, 7, 3), account), weights) % 10 == 0
    central = _weighted(F.concat(F.lit("0"), F.substring(bik, 5, 2), account), weights) % 10 == 0
    return _valid(account.rlike("^[0-9]{20}$") & is_valid_bik(bik), own | central)


def is_valid_card(v: Column) -> Column:
    """Card of 13 to 19 digits, spaces and hyphens left out: Luhn, not all the same."""
    digits = F.regexp_replace(v, "[ -]", "")
    shaped = digits.rlike("^[0-9]{13,19}$") & ~_same_digits(digits)
    return _valid(shaped, F.call_function("luhn_check", F.when(shaped, digits)))
