"""Coordinate detectors: WGS84 pairs, single values, ranges, table cells and columns, and metric SK-42.

One scan reads every angle of a text with its place, axis and spelling. Pairs, ranges and cells are then what stands
between two neighbouring angles, so that the forms need no patterns of their own.
"""

from __future__ import annotations

import re
from itertools import pairwise
from typing import NamedTuple

# Signs of degrees, minutes and seconds, hemispheres, and words that announce coordinates.
DEG, MIN, SEC = "[°º˚∘]", "['′’‘´]", "(?:''|’’|´´|[″\"“”])"
ABBREVIATED = r"(?:[СЮсю]\s*\.\s*[Шш]\s*\.?|[ВЗвз]\s*\.\s*[Дд]\s*\.?)"
LETTER = "[NSEWnsewСЮВЗсювз]"
MARKER = re.compile(r"(?<![A-Za-zА-Яа-яЁё0-9])(?:координат[а-яё]*|широт[а-яё]*|долгот[а-яё]*|WGS[-\s]?84|latitude|longitude)(?![A-Za-zА-Яа-яЁё0-9])", re.I)
CRS = re.compile(r"(?<![A-Za-zА-Яа-яЁё0-9])(?:СК[-\s]?42|SK[-\s]?42|МСК-[0-9]{1,2}|Пулково[-\s]?1942|систем[а-яё]*\s+координат\s+1942\s+года)(?![A-Za-zА-Яа-яЁё0-9])", re.I)
BACK, AHEAD, CELL_BACK, CELL_AHEAD, CRS_NEAR, RUN, FRACTION = 400, 100, 2000, 300, 100, 500, 4

#: An angle: degrees with minutes (the sign may be read as a letter o or all signs as brackets), or a decimal.
ANGLE = re.compile(
    rf"(?<![0-9])(?<![0-9][.,])(?:"
    rf"(?P<d>[0-9]{{1,3}})(?:\s*{DEG}\s*|[оОoO][  ]?)(?P<m>[0-9]{{1,2}}(?:[.,][0-9]+)?)\s*{MIN}(?!{MIN})(?:\s*(?P<s>[0-9]{{1,2}}(?:[.,][0-9]+)?)\s*{SEC})?"
    r"|(?P<pd>[0-9]{1,3})\s*\(\s*(?P<pm>[0-9]{1,2}(?:[.,][0-9]+)?)\s*\(\s*(?P<ps>[0-9]{1,2}(?:[.,][0-9]+)?)\s*\(\("
    rf"|(?P<decimal>[-+−]?[0-9]{{1,3}}[.,][0-9]{{3,}})(?:\s*(?P<sign>{DEG}))?"
    rf")(?:\s*(?:(?P<abbr>{ABBREVIATED})|(?P<letter>{LETTER})(?![А-Яа-яЁёA-Za-z])))?"
)
_METRES = r"(?<![0-9])([0-9]{6,8}(?:[.,][0-9]+)?)(?![0-9])"
_LABELLED = re.compile(rf"(?<![A-Za-zА-Яа-яЁё0-9])[XxХх](?:\s*[=:]\s*|\s+){_METRES}\s*[,;]?\s+[YyУу](?:\s*[=:]\s*|\s+){_METRES}")
_METRIC = re.compile(rf"{_METRES}\s*[,;]\s*{_METRES}")
_BETWEEN, _DASH, _CELL = re.compile(r"\s*[,;]?\s+"), re.compile(r"\s*(?:[-–—−]|до(?=\s))\s*"), re.compile(r"\s*[|\t]\s*")

# Own choice: units that make a pair without any other sign a price or a share.
_MONEY = re.compile(r"\s*(?:руб|коп|₽|%)", re.I)


class Coord(NamedTuple):
    start: int
    end: int
    raw: str
    system: str
    lat: float | None = None
    lon: float | None = None
    x: float | None = None
    y: float | None = None


class Angle(NamedTuple):
    start: int
    end: int
    raw: str
    value: float
    axis: str | None
    negative: bool
    decimal: str | None
    signed: bool
    named: bool


def _number(s: str | None) -> float:
    return float(s.replace(",", ".").replace("−", "-")) if s else 0.0


def _angle(m: re.Match) -> Angle | None:
    """Nothing if minutes or seconds reach sixty."""
    side = (m.group("abbr") or m.group("letter") or "").upper()[:1]
    decimal = m.group("decimal")
    minutes, seconds = _number(m.group("m") or m.group("pm")), _number(m.group("s") or m.group("ps"))
    if minutes >= 60 or seconds >= 60:
        return None
    size = abs(_number(decimal)) if decimal else int(m.group("d") or m.group("pd")) + minutes / 60 + seconds / 3600
    negative = side in tuple("SWЮЗ") or (decimal or "").startswith(("-", "−"))
    axis = ("lat" if side in "NSСЮ" else "lon") if side else None
    return Angle(m.start(), m.end(), m.group(), -size if negative else size, axis, negative, decimal, not decimal or bool(m.group("sign")), bool(m.group("abbr")))


def angles(text: str) -> list[Angle]:
    return [a for m in ANGLE.finditer(text) if (a := _angle(m))]


def parse_component(s: str) -> tuple[float, str | None] | None:
    """Degrees, minutes and seconds in any of their spellings to (value, axis)."""
    m = ANGLE.fullmatch(s.strip())
    a = _angle(m) if m else None
    return (a.value, a.axis) if a else None


def _half(a: Angle, axis: str, value: float) -> list[Coord]:
    return [Coord(a.start, a.end, a.raw, "WGS84", **{axis: value})] if abs(value) <= (90 if axis == "lat" else 180) else []


def _placed(a: Angle, b: Angle) -> tuple[Angle, Angle] | None:
    """The two as latitude and longitude: by hemisphere, else in this order."""
    if a.axis and a.axis == b.axis:
        return None
    lat, lon = (b, a) if a.axis == "lon" or b.axis == "lat" else (a, b)
    return (lat, lon) if abs(lat.value) <= 90 and abs(lon.value) <= 180 else None


def _near(pattern: re.Pattern, text: str, start: int, end: int, back: int, ahead: int) -> bool:
    return bool(pattern.search(text[max(0, start - back) : end + ahead]))


def bare_pair_looks_real(a: str, b: str) -> bool:
    """Not month.year, both of at least 1, no column padded with zeros, no whole ratio, equal precision of 4 digits or more."""
    tails = [re.split("[.,]", v)[1] for v in (a, b)]
    x, y = abs(_number(a)), abs(_number(b))
    if any(re.fullmatch(r"0?[1-9][.,](?:19|20)[0-9]{2}|1[0-2][.,](?:19|20)[0-9]{2}", v) for v in (a, b)) or any(len(t) >= 5 and t.endswith("00") for t in tails):
        return False
    if min(x, y) < 1 or x == y or abs(len(tails[0]) - len(tails[1])) > 1 or min(map(len, tails)) < FRACTION:
        return False
    return round(y / x) < 2 or abs(y / x - round(y / x)) >= 1e-6


def _anchored(text: str, a: Angle, b: Angle) -> bool:
    """Whether something besides the two numbers says that they are coordinates."""
    if a.signed or b.signed or a.named or b.named:
        return True
    if a.axis or b.axis:
        return min(abs(a.value), abs(b.value)) >= 1
    if _near(MARKER, text, a.start, b.end, BACK, AHEAD):
        return True
    gap, dots = text[a.end : b.start], "." in a.decimal and "." in b.decimal
    by_author = ";" in gap or ("," in gap and dots) or a.decimal[0] in "+-−" or b.decimal[0] in "+-−"
    return by_author and not _MONEY.match(text, b.end) and bare_pair_looks_real(a.decimal, b.decimal)


def wgs84(text: str, found: list[Angle] | None = None) -> list[Coord]:
    """Pairs in running text; a comma alone parts two decimals that are written with dots."""
    out, used = [], -1
    for a, b in pairwise(angles(text) if found is None else found):
        if a.start < used:
            continue
        gap = text[a.end : b.start]
        dots = a.decimal and b.decimal and not a.axis and "." in a.decimal and "." in b.decimal
        if not (_BETWEEN.fullmatch(gap) or gap == "" and a.axis and b.decimal is None or (dots or ";" in gap) and re.fullmatch(r"\s*[,;]\s*", gap)):
            continue
        at = _placed(a, b)
        if at and _anchored(text, a, b):
            out.append(Coord(a.start, b.end, text[a.start : b.end], "WGS84", at[0].value, at[1].value))
        used = b.end
    return out


def solo(text: str, found: list[Angle] | None = None) -> list[Coord]:
    """Single angles with signs, where a hemisphere is named."""
    return [c for a in (angles(text) if found is None else found) if a.axis and a.decimal is None for c in _half(a, a.axis, a.value)]


def ranges(text: str, found: list[Angle] | None = None) -> list[Coord]:
    """The left bound of a range takes the hemisphere of the right one, which stands for itself."""
    return [c for a, b in pairwise(angles(text) if found is None else found) if a.decimal is None and b.decimal is None and b.axis and not a.axis and _DASH.fullmatch(text[a.end : b.start]) for c in _half(a, b.axis, -a.value if b.negative else a.value)]


def cell_pairs(text: str, found: list[Angle] | None = None) -> list[Coord]:
    """Two angles in neighbouring cells of a row, two spans. Decimals must look real as well."""
    out, used = [], -1
    for a, b in pairwise(angles(text) if found is None else found):
        if a.start < used or not _CELL.fullmatch(text[a.end : b.start]) or (a.decimal is None) != (b.decimal is None):
            continue
        used = b.end
        at = _placed(a, b)
        if at and (a.decimal is None or bare_pair_looks_real(a.decimal, b.decimal)) and _near(MARKER, text, a.start, b.end, CELL_BACK, CELL_AHEAD):
            out += [c for axis, half in zip(("lat", "lon"), at) for c in _half(half, axis, half.value)]
    return out


_GAP = "[^0-9A-Za-zА-Яа-яЁё]{1,25}"
_HEADER = re.compile(rf"(?<![А-Яа-яЁё])(?:град[а-яё]{{0,6}}|гр)\.?{_GAP}мин[а-яё]{{0,5}}\.?(?P<sec>{_GAP}сек[а-яё]{{0,5}}\.?)?{_GAP}(?:град[а-яё]{{0,6}}|гр)\.?{_GAP}мин[а-яё]{{0,5}}\.?(?(sec){_GAP}сек[а-яё]{{0,5}}\.?)", re.I)
_ROW_OF = re.compile(rf"(?:[^0-9A-Za-zА-Яа-яЁё]{{0,25}}(?<![0-9])[0-9]{{1,4}}(?:[.,][0-9]+)?(?![0-9])){{1,{RUN}}}")
_CELL_NUMBER = re.compile(r"[0-9]{1,4}(?:[.,][0-9]+)?")


def _row(cells: list[re.Match], per: int) -> tuple[float, float] | None:
    """A row's two angles; only the last place of each may have a fraction."""
    halves = []
    for part, most in ((cells[:per], 90), (cells[per:], 180)):
        numbers = [_number(c.group()) for c in part]
        if any(not c.group().isdigit() for c in part[:-1]) or numbers[0] > most or max(numbers[1:]) >= 60:
            return None
        halves.append(sum(v / 60**i for i, v in enumerate(numbers)))
    return halves[0], halves[1]


def column_tables(text: str) -> list[Coord]:
    """Tables with degrees, minutes and perhaps seconds in columns, two rows or more, with or without a rising number
    before each; accepted only if every row reads as an angle north and an angle east. Two spans a row."""
    out = []
    for header in _HEADER.finditer(text):
        block = _ROW_OF.match(text, header.end())
        cells = list(_CELL_NUMBER.finditer(text, header.end(), block.end())) if block else []
        per = 3 if header.group("sec") else 2
        for lead in (1, 0):
            width = 2 * per + lead
            if len(cells) < 2 * width or len(cells) % width:
                continue
            rows = [cells[i : i + width] for i in range(0, len(cells), width)]
            firsts = [_number(r[0].group()) for r in rows]
            if lead and (not all(r[0].group().isdigit() for r in rows) or any(x >= y for x, y in pairwise(firsts))):
                continue
            read = [_row(r[lead:], per) for r in rows]
            if None in read:
                continue
            for r, (lat, lon) in zip(rows, read):
                for part, axis in ((r[lead : lead + per], {"lat": lat}), (r[lead + per :], {"lon": lon})):
                    out.append(Coord(part[0].start(), part[-1].end(), text[part[0].start() : part[-1].end()], "WGS84", **axis))
            break
    return out


def sk42(text: str) -> list[Coord]:
    """Labelled pairs of metres, and bare ones near the name of a metric system."""
    pairs = [*_LABELLED.finditer(text), *(m for m in _METRIC.finditer(text) if _near(CRS, text, m.start(), m.end(), CRS_NEAR, CRS_NEAR))]
    return [Coord(m.start(), m.end(), m.group(), "SK-42", x=_number(m.group(1)), y=_number(m.group(2))) for m in pairs]


def drop_overlaps(found: list[Coord]) -> list[Coord]:
    """Earliest first, then longest."""
    out: list[Coord] = []
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if not out or c.start >= out[-1].end:
            out.append(c)
    return out


def detect(text: str) -> list[Coord]:
    if not re.search("[0-9]", text):
        return []
    found = angles(text)
    return drop_overlaps([*wgs84(text, found), *solo(text, found), *ranges(text, found), *cell_pairs(text, found), *column_tables(text), *sk42(text)])
