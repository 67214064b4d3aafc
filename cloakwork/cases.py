"""Invented texts for single rules and steps, each with what it must give; written by hand from the rules' definitions.

Where a rule has two cases, the second is a neighbour that the rule must leave alone.
"""

from __future__ import annotations

#: (rule, text, what the rule finds, joined by " | ")
RULES = [
    ("C1", "Заказчик ПАО «Лесной край» принял работы", "ПАО «Лесной край»"), ("C1", "Заказчик «Лесной край» принял работы", ""),
    ("C2", "между обществом «Тихая заводь» и банком", "обществом «Тихая заводь»"), ("C2", "общество Тихая заводь", ""),
    ("C3", "постановление А56-7781/2019 вступило", "А56-7781/2019"), ("C3", "артикул ХА56-7781/2019", ""),
    ("C4", "по делу № 2-345/2019 решено", "№ 2-345/2019"), ("C4", "по заявке № 2-345/2019 решено", ""),
    ("C5", "определение 305-ЭС21-4567 и карта 12-ЭС20-88", "305-ЭС21-4567 | 12-ЭС20-88"), ("C5", "изделие 305-ЭС214567", ""),
    ("C6", "паспорт серия 45 06 № 123456 выдан", "паспорт серия 45 06 № 123456"), ("C6", "серия 45 06 № 123456 выдана", ""),
    ("C7", "ИНН: 7707083894 указан", "ИНН: 7707083894"), ("C7", "ИНН 77070838", ""),
    ("C8", "тел. 8 912 345 67 89", "8 912 345 67 89"), ("C8", "сумма 8 912 345 67 89", ""),
    ("C9", "пишите на lab.geo+1@mail.example.org.", "lab.geo+1@mail.example.org"), ("C9", "пишите на lab@geo", ""),
    ("C10", "190000, САНКТ-ПЕТЕРБУРГ, УЛ. МОРСКАЯ, 12", "190000, САНКТ-ПЕТЕРБУРГ, УЛ. МОРСКАЯ, 12"), ("C10", "190000 САНКТ-ПЕТЕРБУРГ МОРСКАЯ 12", ""),
    ("C11", "Склад: г. Заречный, ул. Полевая, д. 7", "г. Заречный, ул. Полевая, д. 7"), ("C11", "г. Заречный и ул. Полевая", ""),
    ("C12", "см. https://example.org/a?b=1 далее", "https://example.org/a?b=1"), ("C12", "см. www.example.org", ""),
    ("C13", "узел 10.20.30.40 доступен", "10.20.30.40"), ("C13", "раздел 10.20.300.4", ""),
    ("C14", "лицензия ПЕР 12345 действует", "ПЕР 12345"), ("C14", "шифр ПЕР 12345", ""),
    ("C15", "скв. 118-Б вскрыла пласт", "скв. 118-Б"), ("C15", "скважина 2015 года бурения", ""),
    ("C16", "скв. 12, 14, 17Б и пласт", "скв. 12, 14, 17Б"), ("C16", "скв. 12, 14 и пласт", ""),
    ("C17", "скважина разведочная глубокая № 45 пробурена", "скважина разведочная глубокая № 45"), ("C17", "скважина разведочная 45", ""),
    ("C18", "на участке «Верхний плёс» начаты", "участке «Верхний плёс»"), ("C18", "сдан объект «Школа»", ""),
    ("C19", "вдоль реки Тихой идёт дорога", "реки Тихой"), ("C19", "набережная реки Тихой", ""),
    ("C20", "ручей Берёзовый впадает", "ручей Берёзовый"), ("C20", "ручей берёзовый впадает", ""),
    ("C21", "севернее р. Чистая", "р. Чистая"), ("C21", "стоит 500 р. Оплата сразу", ""),
    ("C22", "объект — Каменный лог; срок месяц", "Каменный лог"), ("C22", "объект: Каменный лог", ""),
    ("C23", "изучено Светлинское месторождение", "Светлинское"), ("C23", "изучено Данное месторождение", ""),
    ("C24", "видна гора Высокая", "Высокая"), ("C24", "район Тверской области", ""),
    ("C25", "площадь Южная изучена", "Южная"), ("C25", "участок Работ изучен", ""),
    ("C26", "участки Дальний, Ближний и Средний", "Дальний, Ближний и Средний"), ("C26", "участки Дальний и прочие", ""),
    ("C27", "участок Первомайский участок Октябрьский", "Октябрьский"), ("C27", "участок Первомайский, Октябрьский", ""),
    ("C28", "Каменка: геологическое строение", "Каменка"), ("C28", "Каменка: состав комиссии", ""),
    ("C29", "на площади работ (Верхняя, Нижняя) пройдены", "Верхняя, Нижняя"), ("C29", "в смете (Верхняя, Нижняя)", ""),
    ("C30", "долина пр. пр. Каменка", "Каменка"), ("C30", "долина пр. пр. каменка", ""),
    ("C31", "надел 50:20:0010203:145", "50:20:0010203:145"), ("C31", "время 10:20:30", ""),
    ("C32", "ОГРНИП 304500116000157", "ОГРНИП 304500116000157"), ("C32", "ОГРНИП 304500116000158", ""),
    ("C33", "ОГРН 1027700132195", "ОГРН 1027700132195"), ("C33", "ОГРН 1027700132196", ""),
    ("C34", "КПП 770701001", "КПП 770701001"), ("C34", "КПП 77070100", ""),
    ("C35", "по договору подряда от 12.03.2020 г. № 15/2020-П", "договору подряда от 12.03.2020 г. № 15/2020-П"), ("C35", "по приказу № 15/2020-П", ""),
    ("C36", "запись 77/123-н/77-2020-3-456", "77/123-н/77-2020-3-456"), ("C36", "запись 77/123-н/77-2020", ""),
    ("C37", "зарегистрировано, реестровый № 5-123", "реестровый № 5-123"), ("C37", "реестр 5-123", ""),
    ("C38", "БИК 044525225", "БИК 044525225"), ("C38", "БИК 144525225", ""),
    ("C39", "БИК 044525225, счёт № 40702810900000000013", "счёт № 40702810900000000013"), ("C39", "счёт № 40702810900000000013 без банка", ""),
    ("C40", "карта 5555 5555 5555 4444", "карта 5555 5555 5555 4444"), ("C40", "карта 5555 5555 5555 4445", ""),
    ("C41", "к оплате 12 500,00 руб.", "12 500,00 руб."), ("C41", "12 500 рублёвых", ""),
    ("C42", "страховой номер 112-233-445 95", "страховой номер 112-233-445 95"), ("C42", "страховой номер 112-233-445 94", ""),
    ("C43", "полис ОМС 1234 5678 9012 3456", "полис ОМС 1234 5678 9012 3456"), ("C43", "полис ОМС 123456789012345", ""),
    ("C44", "медицинская карта пациента № 1234/21", "медицинская карта пациента № 1234/21"), ("C44", "карта № 1234/21", ""),
    ("C45", "диагноз J45.0 снят", "диагноз J45.0"), ("C45", "кабинет J45.0", ""),
    ("C46", "табельный номер 00417", "табельный номер 00417"), ("C46", "номер 00417", ""),
    ("C47", "трудовая книжка серия ТК № 1234567", "трудовая книжка серия ТК № 1234567"), ("C47", "трудовая книжка серия ТК № 123456", ""),
    ("C48", "водительское удостоверение 77 14 123456", "водительское удостоверение 77 14 123456"), ("C48", "удостоверение 77 14 123456", ""),
    ("C49", "автомобиль А123ВС77", "А123ВС77"), ("C49", "автомобиль А123ЖЩ77", ""),
    ("C50", "от 05.07.2021 и 5/7/21", "05.07.2021 | 5/7/21"), ("C50", "пункт 5.7", ""),
    ("C51", "с 2021-07-05 по сей день", "2021-07-05"), ("C51", "с 2021-7-5", ""),
    ("C52", "подписано «05» июля 2021 г.", "«05» июля 2021 г."), ("C52", "5 июль 2021", ""),
    ("C53", "принял Ветров С.А. лично", "Ветров С.А."), ("C53", "подписал Директор С.А.", ""),
    ("C54", "утвердил С.А. Ветров", "С.А. Ветров"), ("C54", "принял С.А. Директор", ""),
    ("C55", "пришла Ветрова Анна Сергеевна", "Ветрова Анна Сергеевна"), ("C55", "пришла Ветрова Анна", ""),
    ("C56", "пришла Анна Сергеевна Ветрова", "Анна Сергеевна Ветрова"), ("C56", "Анна Сергеевна пришла", ""),
    ("C57", "пришла Анна Сергеевна.", "Анна Сергеевна"), ("C57", "пришла Ветрова Анна Сергеевна", ""),
    ("C58", "передал Сергеевичу.", "Сергеевичу"), ("C58", "передал Сергею.", ""),
    ("C59", "прибыл Алиев Рашид Гусейн оглы", "Алиев Рашид Гусейн оглы"), ("C59", "прибыл Алиев Рашид Гусейн", ""),
    ("C60", "поручено Ветрову С. с утра", "Ветрову С."), ("C60", "приведена Таблица Б. ниже", ""),
]

#: (step, text, the repaired text, the source text of its last word)
NORMAL = [
    ("A1", "дого​вор под​ряда", "договор подряда", "под​ряда"), ("A2", "код ＡＢ№½", "код AB№½", "ＡＢ№½"),
    ("A3", "**важно** и __срочно__", "важно и срочно", "срочно"), ("A3", "сумма *** рублей", "сумма *** рублей", "рублей"),
    ("A4", "акт дoгoвoр", "акт договор", "дoгoвoр"), ("A4", "завод Луoil", "завод Луoil", "Луoil"),
    ("A5", "акт дог0вор", "акт договор", "дог0вор"), ("A5", "шифр К1023", "шифр К1023", "К1023"),
    ("A6", "это заклю-\n  чённый", "это заключённый", "заклю-\n  чённый"), ("A6", "это Северо-\nЗапад", "это Северо-\nЗапад", "Северо-\nЗапад"),
    ("A7", "принял В е т р о в", "принял Ветров", "В е т р о в"), ("A7", "а и б", "а и б", "б"),
    ("A8", "ВетровСергейПавлович", "Ветров Сергей Павлович", "Павлович"), ("A8", "ВетровСергей", "ВетровСергей", "ВетровСергей"),
    ("A9", "ДоговорABC", "Договор ABC", "ABC"), ("A9", "ДоABC", "ДоABC", "ДоABC"),
    ("A10", "рост цен", "рост цен", "цен"), ("A11", "обычный текст", "обычный текст", "текст"),
]

#: (text, with phrases of capitals softened)
CAPS = [("ДИРЕКТОР ВЕТРОВ ООО", "Директор Ветров Ооо"), ("ООО и ПАО", "ООО и ПАО"), ("отдел КАДРОВ", "отдел Кадров")]

#: (step, text, spelling, degrees of latitude, degrees of longitude, metres north, metres east)
COORDS = [
    ("D2", "точка 55°30′00″ с.ш. 37°15′00″ в.д.", "55°30′00″ с.ш. 37°15′00″ в.д.", 55.5, 37.25, None, None),
    ("D2", "point 10°30′ S 20°15′ W", "10°30′ S 20°15′ W", -10.5, -20.25, None, None), ("D2", "отметка 20.2500 E, 10.5000 N", "20.2500 E, 10.5000 N", 10.5, 20.25, None, None),
    ("D2", "снято 61°12´ 30´´ 73°24´ 36´´ вчера", "61°12´ 30´´ 73°24´ 36´´", 61 + 12.5 / 60, 73.41, None, None), ("D2", "веха 64о 06' 121о 45'", "64о 06' 121о 45'", 64.1, 121.75, None, None),
    ("D2", "буй 12° 30.600'N 33° 45.300'W", "12° 30.600'N 33° 45.300'W", 12.51, -33.755, None, None),
    ("D3", "координаты 55.7512, 37.6184", "55.7512, 37.6184", 55.7512, 37.6184, None, None), ("D3", "координаты 61,250 73,500 центра", "61,250 73,500", 61.25, 73.5, None, None),
    ("D3", "колонка 61,250 73,500 сметы", None, None, None, None, None), ("D3", "метка 0.0512 0.0217 в породе", None, None, None, None, None),
    ("D4", "веха 61.25371, 73.51428", "61.25371, 73.51428", 61.25371, 73.51428, None, None), ("D4", "веха 61,25371; 73,51428", "61,25371; 73,51428", 61.25371, 73.51428, None, None),
    ("D4", "веха 12.5000, 25.0000", None, None, None, None, None), ("D4", "веха 61.25300, 73.51700", None, None, None, None, None),
    ("D4", "веха 14,250417 -45,316208", "14,250417 -45,316208", 14.250417, -45.316208, None, None), ("D4", "веха 0.2537, 0.5142", None, None, None, None, None),
    ("D5", "широта 48°30′ с.ш.", "48°30′ с.ш.", 48.5, None, None, None), ("D5", "склон 48°30′ на север", None, None, None, None, None),
    ("D6", "лист 55°12′ – 55°30′ с.ш.", "55°12′", 55.2, None, None, None), ("D6", "лист 55°12′ – 55°30′ с.ш.", "55°30′ с.ш.", 55.5, None, None, None),
    ("D7", "широта и долгота |55°30′ |37°15′ |", "55°30′", 55.5, None, None, None), ("D7", "широта и долгота |55°30′ |37°15′ |", "37°15′", None, 37.25, None, None),
    ("D7", "углы |55°30′ |37°15′ |", None, None, None, None, None),
    ("D8", "град. мин. сек. град. мин. сек.\n1 55 30 00 37 15 00\n2 56 15 00 38 45 00\n", "55 30 00", 55.5, None, None, None),
    ("D8", "град. мин. сек. град. мин. сек.\n1 55 30 00 37 15 00\n2 56 15 00 38 45 00\n", "37 15 00", None, 37.25, None, None),
    ("D8", "град. мин. сек. град. мин. сек.\n1 55 30 00 37 15 00\n2 56 15 00 38 45 00\n", "56 15 00", 56.25, None, None, None),
    ("D8", "град. мин. сек. град. мин. сек.\n1 55 30 00 37 15 00\n2 56 15 00 38 45 00\n", "38 45 00", None, 38.75, None, None),
    ("D8", "градусы минуты градусы минуты 55 30 37 15 56 70 38 45", None, None, None, None, None),
    ("D9", "СК-42: X=6123456 Y=7412345", "X=6123456 Y=7412345", None, None, 6123456.0, 7412345.0), ("D9", "в МСК-50 веха 6123456.50, 7412345.25", "6123456.50, 7412345.25", None, None, 6123456.5, 7412345.25),
    ("D9", "смета 6123456, 7412345 рублей", None, None, None, None, None),
    ("D10", "веха 55°30′ с.ш. 37°15′ в.д.; X=6123456 Y=7412345", "55°30′ с.ш. 37°15′ в.д.", 55.5, 37.25, None, None), ("D10", "веха 55°30′ с.ш. 37°15′ в.д.; X=6123456 Y=7412345", "X=6123456 Y=7412345", None, None, 6123456.0, 7412345.0),
]

#: (rule, who found it, text, the person given at each place of that spelling, what stays, joined by " | ")
PERSONS = [
    ("F1", "rule", "Заказчик и Поставщик согласны", "Заказчик", ""), ("F2", "model", "встретил Ветрова утром", "Ветрова", "Ветрова"),
    ("F2", "model", "встретил Гром утром", "Гром", ""), ("F2", "model", "в лице директора Гром утром", "Гром", "Гром"),
    ("F3", "rule", "встретил Гром утром", "Гром", "Гром"), ("F4", "model", "граф.  Ветров, ", " Ветров, ", "Ветров"),
    ("F4", "model", "Ветров\tЛугов", "Ветров\tЛугов", ""), ("F5", "rule", "институт имени Ветрова открыт", "Ветрова", ""),
    ("F5", "rule", "говорил от имени Ветрова вчера", "Ветрова", "Ветрова"), ("F6", "rule", "подписал Директор Лугов И.И.", "Директор Лугов И.И.", "Директор Лугов И.И."),
    ("F6", "rule", "принял Директор И.И. Лугов", "Директор И.И. Лугов", "И.И. Лугов"), ("F7", "rule", "графа Ф.И.О. пуста", "Ф.И.О.", ""),
    ("F7", "rule", "графа Фамилия И.О. пуста", "Фамилия И.О.", ""), ("F8", "rule", "живёт на ул. Ветрова, д. 5", "Ветрова", ""),
    ("F8", "rule", "сказал Ветрова, д. 5", "Ветрова", "Ветрова"), ("F9", "rule", "школа имени Ветрова; Ветрова знают все", "Ветрова", ""),
    ("F10", "rule", "учебник, Ветров С.А., 2010", "Ветров С.А.", ""), ("F10", "rule", "расписка, Ветров С.А., учебник", "Ветров С.А.", "Ветров С.А."),
    ("F11", "rule", "печать М.П. здесь", "М.П.", ""), ("F12", "rule", "Ветров Сергей\nПавлович прибыл", "Павлович", "Ветров Сергей\nПавлович"),
]

#: (step, text, type and spelling of the proven span, spellings that follow from it)
SPREAD = [
    ("G1", "Ветров Сергей Павлович прибыл. Ветрову выдали карту.", "PER", "Ветров Сергей Павлович", "Ветрову"),
    ("G1", "Ветров Сергей Павлович прибыл. Дом ветрову не мешал, Ветрову тоже.", "PER", "Ветров Сергей Павлович", ""),
    ("G2", "ООО «Лес» и снова ООО «Лес» там", "ORG", "ООО «Лес»", "ООО «Лес»"), ("G2", "АО и снова АО там", "ORG", "АО", ""),
    ("G4", "участок Каменский начат, за Каменским лес", "GEO_NAME", "Каменский", "Каменским"), ("G4", "участок Каменский и каменский лес, Каменским", "GEO_NAME", "Каменский", ""),
    ("G4", "ручей Каменский начат, за Каменским лес", "GEO_NAME", "Каменский", ""), ("G5", "участки Дальний, Ближний и Средний", "GEO_NAME", "Дальний", "Ближний | Средний"),
    ("G5", "участки Дальний и Ближний", "GEO_NAME", "Ближний", "Дальний"),
]

#: (step, name, gender, what is asked, answer)
MORPH = [
    ("H1", "Ветрова Анна Сергеевна", None, "gender", "f"), ("H1", "Алиев Рашид Гусейн оглы", None, "gender", "m"), ("H1", "Ветров С.А.", None, "surname", "Ветров"),
    ("H2", "Ветров Сергей Павлович", "m", "dat", "Ветрову Сергею Павловичу"), ("H2", "Ветров Сергей Павлович", "m", "ins", "Ветровым Сергеем Павловичем"), ("H2", "Лугова Анна Сергеевна", "f", "gen", "Луговой Анны Сергеевны"),
    ("H2", "Озерский", "m", "pre", "Озерском"), ("H2", "Шевченко", "m", "ins", "Шевченко"), ("H3", "Ветрову", "m", "lemma", "Ветров"), ("H3", "Луговой", "f", "lemma", "Лугова"),
    ("H4", "Ветровым", "m", "case", "ins"), ("H4", "Ветрове", "m", "case", "pre"), ("H5", "Ветрову Сергею Павловичу", None, "analyze", "Ветров Сергей Павлович/m/dat"),
    ("H6", "Сергею", "m", "given", "Сергей"), ("H6", "Анной", "f", "given", "Анна"), ("H6", "Сергеевной", "f", "patronymic", "Сергеевна"),
    ("H7", "1", None, "plural", "0"), ("H7", "3", None, "plural", "1"), ("H7", "11", None, "plural", "2"), ("H7", "22", None, "plural", "1"),
]
