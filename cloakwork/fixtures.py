"""Invented Russian texts for queries whose rules the driver tables cannot exercise, with the spans they must give."""

from __future__ import annotations

TEXTS = [
    (1, "Отчёт составил Берёзов И.П. лично 12.03.2020."),
    (2, "Согласовано с Тополевым Дмитрием Аркадьевичем. Позже Тополеву передали карты."),
    (3, "ООО «Горизонт» против АО «Меридиан», дело № А40-12345/2020."),
    (4, "Тел. +7 (495) 123-45-67, почта user@example.com, ИНН 7707083893."),
    (5, "Скважина № 12-П на участке Светлый, лицензия МАГ 04567 БР."),
    (6, "Точка наблюдения: координаты 55°45′21″ с.ш. 37°37′04″ в.д."),
    (7, "СНИЛС 112-233-445 95, полис ОМС 1234567890123456."),
    (8, "г. Новый, ул. Садовая, д. 5, кв. 3"),
    (9, "Раздел Г. Перечень оборудования"),
    (10, "В пункте 4.3.2.1 и версии 1.2.3.999 адресов нет."),
    (11, "Встреча 5 мая 2021 г. и 12 марта 2020 г."),
    (12, ""),
]
#: (doc_id, type, raw)
EXPECTED = [
    (1, "PER", "Берёзов И.П."), (1, "DATE", "12.03.2020"), (2, "PER", "Тополевым Дмитрием Аркадьевичем"), (3, "ORG", "ООО «Горизонт»"), (3, "ORG", "АО «Меридиан»"), (3, "CASE", "А40-12345/2020"),
    (4, "PHONE", "+7 (495) 123-45-67"), (4, "EMAIL", "user@example.com"), (4, "INN", "ИНН 7707083893"), (5, "WELL", "Скважина № 12-П"), (5, "GEO_NAME", "Светлый"), (5, "LICENSE_SUBSOIL", "МАГ 04567 БР"),
    (6, "COORD", "55°45′21″ с.ш. 37°37′04″ в.д."), (7, "SNILS", "СНИЛС 112-233-445 95"), (7, "POLICY_OMS", "полис ОМС 1234567890123456"), (8, "ADDR", "г. Новый, ул. Садовая, д. 5, кв. 3"), (10, "IP", "4.3.2.1"),
    (11, "DATE", "5 мая 2021 г."), (11, "DATE", "12 марта 2020 г."),
]
#: PER spans that propagation adds to the texts above.
SPREAD = [(2, "PER", "Тополеву")]


def values(rows: list[tuple], columns: str) -> str:
    """A list of rows as SQL that both engines read."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"
