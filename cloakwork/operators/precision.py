"""What only looks like a person: nomenclature, memorial names, streets, bibliography, form fields."""

from __future__ import annotations

import re

from cloakwork.operators.overlap import Span, moved, span_key
from cloakwork.operators.rules import CAP, ROLES, is_role

# Own choice: contract nomenclature, by stem.
NOMENCLATURE = tuple("заказчик поставщик подрядчик исполнител покупател продавец товар услуг работ сторон договор контракт арендатор арендодател лицензиат лицензиар генподрядчик субподрядчик заявител участник бенефициар".split())
_SUFFIX = re.compile("(?:ов|ев|ёв|ин|ын|ск|цк)(?:а|у|ым|ой|е|ого|ому|ий|ая|ую|им|ом)?$|(?:енко|чук|юк|ук|ян|дзе|швили)(?:а|у|ом|е)?$|(?:ич|вн|ичн)(?:а|у|ем|е|ы|ой)?$")
SIGNING = re.compile(r"в лице|подпис|директор|действующ|расписк|поставил|паспорт|ИНН|родил|рожден|г\.р\.", re.I)
MEMORIAL = re.compile(r"(?<!от )(?:имени|им\.)[  ]+(?:(?:академик|профессор|геро|маршал|генерал|адмирал|святого|акад|проф)[а-яё.]*[  ]+)*(?:[А-ЯЁ]\.[  ]?){0,2}(?:[А-ЯЁ][а-яё]+[  ]+){0,2}$", re.I)
STREET_LEFT = re.compile(r"(?:ул(?:\.|иц[аеыу])|просп(?:\.|ект[а-я]*)|пер(?:\.|еул[а-я]+)|площад[ьи]|бульвар|набережн[а-я]+|шоссе)[  ]*$", re.I)
HOUSE_RIGHT = re.compile(r"^[, ]{0,3}(?:д(?:\.|ом)[  ]?)?[0-9]", re.I)
BOOK = re.compile(r"ISBN|учебник|издательств|изд\.|авторск|соавт|учеб\. пособ|под ред|—[  ]М\.:", re.I)
AUTHORS = re.compile(r"авторск[а-яё]+[  ]+коллектив", re.I)
BOOK_CUES, SIGN_NEAR, BOOK_NEAR = 10, 120, 160
_PLACEHOLDER = re.compile(r"^(?:Ф\.?[  ]?И\.?[  ]?О\.?|Фамилия(?:[  -]И\.?О\.?)?|Имя|Отчество|Фамилия[  -]+Имя(?:[  -]+Отчество)?)$", re.I)
_MARKS = re.compile(r"^(?:Г\.|М\.П\.?|Ц\.П\.?|Литера?[  ]+[А-Я]\.?|Г\.О\.[  ]*[А-ЯЁ][а-яё]+ск(?:ий|ого|ом))$")


def signed(text: str, start: int, end: int) -> bool:
    return bool(SIGNING.search(text[max(0, start - SIGN_NEAR) : start]) or SIGNING.search(text[end : end + 40]))


def bibliographic(text: str) -> bool:
    return len(BOOK.findall(text)) >= BOOK_CUES or bool(AUTHORS.search(text))


def memorial(text: str, at: int) -> bool:
    line = re.split(r"\n|(?<=[а-яё]{3})\.[  ]", text[max(0, at - 80) : at])[-1]
    return bool(MEMORIAL.search(line)) and "от имени" not in line.lower()


def is_false_person(raw: str, text: str, at: int) -> bool:
    words = re.findall("[А-Яа-яЁё]+", raw)
    end = at + len(raw)
    if not words or _PLACEHOLDER.match(raw.strip()) or _MARKS.match(raw.strip()):
        return True
    if all(w.lower().startswith(NOMENCLATURE) for w in words if len(w) > 2) and any(len(w) > 2 for w in words):
        return True
    if memorial(text, at) and not re.search(r"^[, ]*(?:г\.р\.|[0-9.]{8,10})", text[end : end + 14]):
        return not signed(text, at, end)
    if re.search(r"(?:ул\.|улиц|просп|шоссе|переул)", raw, re.I) or (STREET_LEFT.search(text[max(0, at - 24) : at]) and HOUSE_RIGHT.match(text[end : end + 12])):
        return True
    if text[end : end + 1] == "-" and re.match("-[а-яё]", text[end : end + 2]):
        return True
    near = BOOK.search(text[max(0, at - BOOK_NEAR) : end + BOOK_NEAR])
    return bool((near or bibliographic(text)) and not signed(text, at, end))


def filter_model_persons(text: str, spans: list[Span]) -> list[Span]:
    """Spans of people found by a model: blanks and those across column gaps go, edges are trimmed, nomenclature and
    names without a Russian suffix or a signing cue go. Rule spans stay as they are."""
    out = []
    for s in spans:
        if s.type != "PER" or s.source == "rule":
            out.append(s)
            continue
        start, end = s.start, s.end
        while start < end and not text[start].isalpha():
            start += 1
        while end > start and not (text[end - 1].isalpha() or text[end - 1] == "."):
            end -= 1
        body = text[start:end]
        if not body.strip() or re.search(r"[ \t ]{3,}|\t|\|", body) or is_false_person(body, text, start):
            continue
        if any(_SUFFIX.search(w) for w in re.findall(CAP, body)) or signed(text, start, end):
            out.append(moved(s, start, end, text))
    return out


def refine_persons(text: str, spans: list[Span], suppressed: set | None = None) -> list[Span]:
    """All spans of people: role words before initials are cut off, false people go (into `suppressed`), and a name
    broken by a line end takes up to two capitalised words on its left."""
    dropped = {s.raw for s in spans if s.type == "PER" and (memorial(text, s.start) or STREET_LEFT.search(text[max(0, s.start - 24) : s.start])) and not signed(text, s.start, s.end)}
    out = []
    for s in spans:
        if s.type != "PER":
            out.append(s)
            continue
        head = re.match(rf"({CAP})[  ]+(?=[А-ЯЁ]\.)", s.raw)
        if head and is_role(head.group(1)) and head.group(1).lower().startswith(ROLES):
            s = moved(s, s.start + head.end(), s.end, text)
        if is_false_person(s.raw, text, s.start) or (s.raw in dropped and not signed(text, s.start, s.end)):
            if suppressed is not None:
                suppressed.add(span_key(s))
            continue
        if re.fullmatch(r"[А-ЯЁ][а-яё]+(?:ич|вн|ичн)(?:а|у|ем|е|ы|ой)?", s.raw):
            left = re.search(rf"((?:{CAP}[  ]*){{1,2}})\n[ \t ]*$", text[max(0, s.start - 60) : s.start])
            if left:
                s = moved(s, max(0, s.start - 60) + left.start(1), s.end, text)
        out.append(s)
    return out
