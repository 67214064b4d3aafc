"""Rule detectors. A rule is a type, a pattern, a confidence and perhaps a check of its match in context.

Classes are spelled out ([0-9], not \\d), look-behinds have fixed width, and what lies further back is
checked in the validator. Names stay on one line: gaps are spaces, tabs and no-break spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from cloakwork.operators import checks

U, L = "[А-ЯЁ]", "[а-яё]"
G, I1 = "[ \\t\u00a0]{1,4}", "[ \\t\u00a0]?"
CAP = rf"{U}{L}+(?:-{U}?{L}+)*"
NOT_IN_WORD = "(?<![А-Яа-яЁёA-Za-z0-9_])"
END = "(?![А-Яа-яЁёA-Za-z])"
PATRONYMIC = rf"{U}{L}*(?:(?:ов|ев|ь|м|к|н|ф)ич(?:а|у|ем|ом|е)?|(?:ов|ев|ич|инич)н(?:а|ы|е|у|ой|ою))"
INITIALS = rf"{U}\.{I1}{U}\."


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    pattern: re.Pattern
    confidence: str = "high"
    check: Callable[[re.Match, str], bool] | None = None
    group: int = 0


RULES: list[Rule] = []


def rule(id_: str, type_: str, pattern: str, confidence: str = "high", check=None, group: int = 0, flags: int = 0) -> None:
    RULES.append(Rule(id_, type_, re.compile(pattern, flags), confidence, check, group))


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


# --- predicates --------------------------------------------------------------------------------------

#: Own choice: stems of role words that stand before initials and are no surnames.
ROLES = tuple("директор инженер геолог начальник заказчик поставщик исполнитель подрядчик генеральн главн утвердил утвержда согласов проверил составил принял подпись председател секретар врач судь истец ответчик покупател продавец замечан срок задание приложение таблиц рисунок раздел глава пункт стать см. литер лист форма схема разрез".split())
#: Own choice: words that a letter with a dot numbers.
RUBRICS = tuple("приложени таблиц рисун раздел глав пункт стать литер лист форм схем разрез част том вариант участ блок корпус строени зона".split())


def is_role(word: str) -> bool:
    return word.lower().startswith(ROLES)


def capital_is_forced(text: str, at: int) -> bool:
    """The capital at this place says nothing: start of a line, list item or sentence."""
    left = text[max(0, at - 12) : at]
    return at == 0 or bool(re.search(r"(?:^|\n)[ \t\u00a0]*(?:[0-9]{1,3}[.)]|[-–•*])?[ \t\u00a0]*$|[.!?:;][»\")]?[ \t\u00a0]+$", left if at <= 12 else "x" + left)) or not text[:at].strip()


def _word_left(text: str, at: int) -> tuple[str, int]:
    m = re.search(rf"([А-Яа-яЁё-]+){G}$", text[max(0, at - 48) : at])
    return (m.group(1), at - len(m.group())) if m else ("", at)


def surname_precedes(text: str, at: int) -> bool:
    """A capitalised word that may be a surname stands left of initials at this place."""
    word, place = _word_left(text, at)
    return bool(re.fullmatch(CAP, word)) and not is_role(word) and not (capital_is_forced(text, place) and not re.search("(?:ов|ев|ёв|ин|ын|ский|цкий|ова|ева|ина|ко|ук|юк|ян)(?:а|у|ым|ой|е|ого|ому)?$", word))


def surname_binds_left(raw: str, text: str, at: int) -> bool:
    """Surname И.О.: whether the initials belong to it rather than to a surname on their right."""
    right = re.match(rf"{I1}({CAP}){END}", text[at + len(raw) :])
    return not (right and capital_is_forced(text, at) and not is_role(right.group(1)) and is_role(raw.split()[0]))


def name_word_precedes(text: str, at: int) -> bool:
    word, place = _word_left(text, at)
    return bool(re.fullmatch(CAP, word)) and not is_role(word) and not capital_is_forced(text, place)


def name_word_touches(text: str, at: int, length: int) -> bool:
    right = re.match(rf"{G}({CAP}){END}", text[at + length :])
    return name_word_precedes(text, at) or bool(right and not is_role(right.group(1)))


def cuts_decimal(text: str, start: int, end: int) -> bool:
    """The number is one half of a decimal measurement."""
    return bool(re.match(r",[0-9]|[.][0-9]+[ \u00a0]?(?:м|км|га|т)(?![а-яё])", text[end : end + 8])) or bool(re.search(r"[0-9],$", text[max(0, start - 3) : start]))


def in_table_cell(text: str, start: int, end: int) -> bool:
    line = text[text.rfind("\n", 0, start) + 1 : (text + "\n").find("\n", end)]
    return line.count("|") >= 2 or "\t" in line


def is_well_number(token: str, text: str = "", start: int = 0) -> bool:
    """A token with a digit that numbers a well: no decimal, year, section, zero or count."""
    end = start + len(token)
    after = text[end : end + 20]
    bare = token.rstrip(".")
    if not re.search("[0-9]", bare) or re.fullmatch("0+", bare):
        return False
    if re.fullmatch("(?:19|20)[0-9]{2}г?", bare) and (bare.endswith("г") or re.match(r"[ \u00a0]?(?:г\.|год)", after)) or re.match(r"\.[А-Яа-яЁё]", after):
        return False
    if re.fullmatch(r"[0-9]+,[0-9]+", bare) or bare.count(".") >= 2:
        return False
    if re.match(r"[ \u00a0]?(?:м|км|шт|скв|штук|п|т)\.?(?![А-Яа-яЁё0-9])", after) and not token.startswith("№"):
        return False
    if text and cuts_decimal(text, start, end):
        return False
    if re.match(r"[ \u00a0]+(?:скважин|буров)", after):
        return False
    return True


# Region codes of subsoil licences.
LICENCE_REGIONS = frozenset("""
АДГ АЛТ АМУ АНД АРХ АСТ БАШ БЕЛ БЛГ БРО БРЯ ВЛГ ВЛВ ВЛЖ ВОЛ ВОР ГОР ДАГ ЕКБ ИВА ИНГ ИРК КАМ КБР КЕМ КЛГ КЛМ КМН КПЯ КРД КРР КРС КРЯ
КУР КЧР КЗЛ ЛЕН ЛИП МАГ МАР МОР МОС МСК МУР НЕН НЖГ НВС НОВ ОМС ОРБ ОРЛ ПЕН ПЕР ПРМ ПСК РОС РЯЗ САМ САР САХ СВЕ СЕВ СКЛ СМО СТА СТВ
СЫК ТАЛ ТАМ ТВЕ ТОМ ТУВ ТУЛ ТЮМ УДМ УДЭ УЛЬ УФА ХАБ ХАК ХАН ЧЕЛ ЧЕР ЧИТ ЧУК ЧУВ ШОМ ЭВЕ ЮГК ЮСХ ЯКУ ЯНЦ ЯРО
""".split())
# A licence's kind is one letter for what is mined and one for the purpose.
LICENCE_KINDS = frozenset(mined + purpose for mined in "БТВНЭК" for purpose in "РПЭТ")


def is_subsoil_licence(m: re.Match, text: str) -> bool:
    kind = m.group("kind")
    if m.group("region") not in LICENCE_REGIONS:
        return False
    if kind:
        return kind in LICENCE_KINDS
    return "лицензи" in text[max(0, m.start() - 60) : m.start()].lower()


_NOMINATIVE = re.compile(r"(?:ое|ый|ий|ая|ск|ка|на|ха|ма|ра|та|ла|ль|нь|ан|ин|он|ун|ор|ар|ай|уй|ей|ой|ек|ок|ик|ак|ин[оа]|ово|ево|ый|ье)$", re.I)
_OBLIQUE = re.compile(r"(?:ого|его|ому|ему|ым|им|ом|ем|ой|ей|ую|юю|ого)$", re.I)
_VERBAL = re.compile(r"(?:ани|ени|ци|ировк|ност)(?:е|я|ю|ем|и|й|а)?$", re.I)
#: Own choice: words that stand beside a geological key but name nothing.
GEO_COMMON = tuple("данн указанн настоящ лицензионн разведочн поисков перспективн рудн нефтян газов угольн золот площад участ месторожд проявлен объект работ российск федерац республик област край район общ весь сам так нов стар перв втор трет".split())
ADMIN_TAIL = re.compile(r"^[ \t\u00a0]{1,4}(?:район|област|кра[йяю]|округ|республик|федерац|сельсовет|поселени)", re.I)


def looks_like_geo_name(word: str, nominative_only: bool = False) -> bool:
    if len(word) < 3 or word.lower().startswith(GEO_COMMON) or _VERBAL.search(word):
        return False
    if nominative_only:
        return bool(_NOMINATIVE.search(word)) and not _OBLIQUE.search(word)
    return True


def enum_list_has_name(raw: str) -> bool:
    return any(looks_like_geo_name(w) for w in re.findall(CAP, raw))


# --- organisations, cases, documents -----------------------------------------------------------------

# Legal forms.
FORMS = "ООО|ОАО|ПАО|ЗАО|НАО|АО|ИП|ФГУП|ФГБУ|ГУП|МУП|АНО|НКО|ГБУ"
QUOTED = "(?:«[^»\\n]{1,90}»|\"[^\"\\n]{1,90}\"|“[^”\\n]{1,90}”)"
rule("C1", "ORG", rf"{NOT_IN_WORD}(?:{FORMS})[ \t\u00a0]{{0,4}}{QUOTED}(?:[ \t\u00a0]им(?:\.|ени)[ \t\u00a0]?(?:{INITIALS}[ \t\u00a0]?)?{CAP})?")
rule("C2", "ORG", rf"{NOT_IN_WORD}(?:обществ|компани|организаци|учреждени|предприяти|фирм)[а-яё]{{0,5}}{G}{QUOTED}", flags=re.I)
rule("C3", "CASE", r"(?<![A-Za-zА-Яа-яЁё0-9])[АA]?[0-9]{2}[А-ЯA-Z]?-[0-9]{1,6}/[0-9]{4}(?![A-Za-zА-Яа-яЁё0-9])")
rule("C4", "CASE", r"(?:[Дд]ел[оауе]м?)[ \t\u00a0]+(№[ \t\u00a0]?[0-9]+-[0-9]+(?:/[0-9]{2,4})?)", group=1)
rule("C5", "CASE", r"(?<![A-Za-zА-Яа-яЁё0-9])(?:[0-9]{1,3}-[А-Я]{2,3}[0-9]{2}-[0-9]{1,6}|[0-9]{1,4}-ЭС[0-9]{2}-[0-9]{1,6})(?![0-9])")
rule("C6", "PASSPORT", r"паспорт[а-яё]{0,4}(?:[ \t\u00a0:,]+[а-яё№.]{1,12}){0,3}[ \t\u00a0:,]*(?:сери[яи][ \t\u00a0:]*)?[0-9]{2}[ \t\u00a0]?[0-9]{2}[ \t\u00a0,]*(?:№|номер|N)?[ \t\u00a0]*[0-9]{6}(?![0-9])", flags=re.I)
rule("C7", "INN", r"ИНН(?:/[А-ЯA-Z]{2,4})?[^0-9A-Za-zА-Яа-яЁё]{0,4}(?:[0-9]{12}|[0-9]{10})(?![0-9])", flags=re.I)


def _phone(m: re.Match, text: str) -> bool:
    d = digits(m.group())
    if len(d) != 11 or d[0] not in "78":
        return False
    label = re.search(r"тел|моб|факс|phone|tel", text[max(0, m.start() - 40) : m.start()], re.I)
    return bool(set("()-") & set(m.group())) or m.group().startswith("+7") or bool(label)


rule("C8", "PHONE", r"(?<![0-9+])(?:\+7|8|7)[ \t\u00a0-]?\(?[0-9]{3,5}\)?[ \t\u00a0-]?[0-9]{1,3}(?:[ \t\u00a0-]?[0-9]{2}){1,2}(?:[ \t\u00a0-]?[0-9]{1,2})?(?![0-9])", check=_phone)
rule("C9", "EMAIL", r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
rule("C10", "ADDR", rf"(?<![0-9])[0-9]{{6}},?[ \t\u00a0]+(?:Г\.?[ \t\u00a0]?)?[А-ЯЁ][А-ЯЁ-]{{2,}},[ \t\u00a0]*(?:УЛ|ПР|ПЕР|НАБ|Ш)\.?[ \t\u00a0]?[А-ЯЁ0-9 -]{{2,40}},[ \t\u00a0]*(?:Д\.?[ \t\u00a0]?)?[0-9]+[А-Я]?(?:/[0-9]+)?(?:,[ \t\u00a0]*(?:КВ|ОФ|КОРП|СТР)\.?[ \t\u00a0]?[0-9]+)?")
rule("C11", "ADDR", rf"{NOT_IN_WORD}г\.[ \t\u00a0]?{CAP},[ \t\u00a0]*(?:ул|пр|пер|наб|ш)[а-яё-]*\.?[ \t\u00a0]?[А-ЯЁ0-9][А-Яа-яЁё0-9 .-]{{1,40}}?,[ \t\u00a0]*(?:д|дом)\.?[ \t\u00a0]?[0-9]+[а-яА-Я]?(?:/[0-9]+)?(?:,[ \t\u00a0]*(?:кв|оф|корп|стр)\.?[ \t\u00a0]?[0-9]+)?")
rule("C12", "URL", r"https?://[^\s\"'<>«»]+")
rule("C13", "IP", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", check=lambda m, t: all(int(p) <= 255 for p in m.group().split(".")))

# --- geology -----------------------------------------------------------------------------------------

rule("C14", "LICENSE_SUBSOIL", r"(?<![А-ЯЁA-Z])(?P<region>[А-ЯЁ]{3})[ \t\u00a0-]?(?:№[ \t\u00a0]?)?[0-9]{5,6}(?:[ \t\u00a0-]?(?P<kind>[А-Я]{2})(?![А-Яа-яЁё]))?", "medium", is_subsoil_licence)
WELL_KEY = r"(?:скважин[а-яё]{0,3}|скв\.?|буров(?:ая|ой|ую))"
WELL_TOKEN = r"[А-ЯA-Z]{0,4}-?[0-9][0-9А-Яа-яA-Za-z/-]{0,10}"
rule("C15", "WELL", rf"(?<![А-Яа-яЁё]){WELL_KEY}:?[ \t\u00a0]*((?:№[ \t\u00a0]?)?{WELL_TOKEN})", "medium", lambda m, t: is_well_number(m.group(1), t, m.start(1)), 0, re.I)
rule("C16", "WELL", rf"(?:скважин(?:ы|ам|ах|ами)?|скв\.)[ \t\u00a0]*(?:\((?:например,[ \t\u00a0]*)?)?(?:№+[ \t\u00a0]?)?({WELL_TOKEN}(?:,[ \t\u00a0]*{WELL_TOKEN}){{2,}})(?![ \t\u00a0]?(?:м|км|шт)(?![а-яё]))", "medium", None, 0, re.I)
rule("C17", "WELL", rf"(?<![А-Яа-яЁё]){WELL_KEY}(?:[ \t\u00a0]+[а-яё]+){{1,3}}[ \t\u00a0]+(№[ \t\u00a0]?{WELL_TOKEN})", "medium", None)
STRONG = r"(?:участ(?:ок|ка|ке|ку|ком)|площад(?:ь|и|ью)|месторождени(?:е|я|и|ю|ем)|рудопроявлени(?:е|я|и)|проявлени(?:е|я|и))"
_GEOLOGY = re.compile("геолог|недр|скважин|месторожд|разведк|бурен|руд|горн", re.I)
rule("C18", "GEO_NAME", rf"(?<![А-Яа-яЁё])(?P<key>{STRONG}|объект[а-яё]{{0,2}})[ \t\u00a0]+(?:недр[ \t\u00a0]+)?(?P<name>«[А-ЯЁ0-9][^»\n]{{1,58}}»|\"[А-ЯЁ0-9][^\"\n]{{1,38}}\")", "medium", lambda m, t: not m.group("key").lower().startswith("объект") or bool(_GEOLOGY.search(t[max(0, m.start() - 120) : m.start()])), 0, re.I)
# Own choice: proper names that follow "river" but are countries' or streets' words.
rule("C19", "GEO_NAME", rf"(?<![А-Яа-яЁё])(?:рек(?:а|и|е|у|ой)|речк(?:а|и|е|у|ой))[ \t\u00a0]+({CAP})", "medium", lambda m, t: "набережн" not in t[max(0, m.start() - 16) : m.start()].lower() and not m.group(1).startswith(("Росси", "Кита")))
rule("C20", "GEO_NAME", rf"(?<![А-Яа-яЁё])(?:руч\.|руче(?:й|я|ю|ём|е))[ \t\u00a0]*((?:[А-Я][а-яё]?\.[ \t\u00a0]?)?{CAP})", "medium", None)
rule("C21", "GEO_NAME", rf"(?<![А-Яа-яЁё0-9])р\.[ \t\u00a0]?({CAP})(?:,[ \t\u00a0]приток[а-яё]*[ \t\u00a0]реки[ \t\u00a0]{CAP})?", "medium", lambda m, t: not re.search(r"[0-9][ \t\u00a0]?$", t[max(0, m.start() - 3) : m.start()]))
rule("C22", "GEO_NAME", rf"(?:^|\n)[ \t\u00a0]*объект[ \t\u00a0]*[—–-][ \t\u00a0]*({CAP}[^;/\n]{{0,60}})", "medium", None, 1, re.I)
rule("C23", "GEO_NAME", rf"{NOT_IN_WORD}({CAP}(?:[ \t\u00a0-]+[а-яёА-ЯЁ][а-яё]+){{0,3}})[ \t\u00a0]+{STRONG}", "medium", lambda m, t: looks_like_geo_name(m.group(1).split()[0]) and not (capital_is_forced(t, m.start()) and not re.search("ск(?:ое|ий|ая|ого|ой|ом)$", m.group(1).split()[0])), 1)
rule("C24", "GEO_NAME", rf"(?<![А-Яа-яЁё])(?:район|урочищ[еа]|хребет|гора|озеро|остров|перевал)[ \t\u00a0]+({CAP}){END}", "medium", lambda m, t: looks_like_geo_name(m.group(1), True) and not ADMIN_TAIL.search(t[m.end() : m.end() + 40]), 1)
rule("C25", "GEO_NAME", rf"(?<![А-Яа-яЁё]){STRONG}[ \t\u00a0]+({CAP}(?:[ \t\u00a0-][А-ЯЁ][а-яё]+)?){END}(?!\.)", "medium", lambda m, t: looks_like_geo_name(m.group(1).split()[0]), 1)
rule("C26", "GEO_NAME", rf"(?:участк(?:и|ов|ам|ах)|площад(?:ей|ям|ях)|месторождени(?:я|й|ям|ях))[ \t\u00a0]*:?[ \t\u00a0]*({CAP}(?:,[ \t\u00a0]*{CAP}){{1,7}}(?:[ \t\u00a0]и[ \t\u00a0]{CAP})?)", "medium", lambda m, t: enum_list_has_name(m.group(1)), 1)
rule("C27", "GEO_NAME", rf"участок[ \t\u00a0]+{CAP}[ \t\u00a0]+участок[ \t\u00a0]+({CAP})", "medium", None, 1, re.I)
rule("C28", "GEO_NAME", rf"(?:^|\n|\|)[ \t\u00a0]*({CAP}(?:,[ \t\u00a0]*{CAP})?):", "medium", lambda m, t: looks_like_geo_name(m.group(1).split(",")[0]) and bool(_GEOLOGY.search(t[m.end() : m.end() + 90])), 1)
rule("C29", "GEO_NAME", rf"\(({CAP}(?:,[ \t\u00a0]*{CAP})+)\)", "medium", lambda m, t: bool(re.search(STRONG, t[max(0, m.start() - 60) : m.start()], re.I)) and enum_list_has_name(m.group(1)), 1)
rule("C30", "GEO_NAME", rf"(?<![А-Яа-яЁё])(?:л|п)?\.?[ \t\u00a0]?пр\.[ \t\u00a0]?(?:пр\.[ \t\u00a0]?)?(?:р\.[ \t\u00a0]?)?({CAP})", "medium", None, 1)

# --- registries and finance --------------------------------------------------------------------------

rule("C31", "CADASTRE", r"(?<![0-9:])[0-9]{2}:[0-9]{2}:(?:[0-9]{6,7}:[0-9]+|[0-9]{4}:[0-9]{3}(?::[0-9]+)?)(?![0-9:])", "medium")
rule("C32", "OGRNIP", r"ОГРНИП[^0-9A-Za-zА-Яа-яЁё]{0,4}([0-9]{15})(?![0-9])", check=lambda m, t: checks.ogrnip(m.group(1)), flags=re.I)
rule("C33", "OGRN", r"ОГРН[^0-9A-Za-zА-Яа-яЁё]{0,4}([0-9]{13})(?![0-9])", check=lambda m, t: checks.ogrn(m.group(1)), flags=re.I)
rule("C34", "KPP", r"КПП[^0-9A-Za-zА-Яа-яЁё]{0,4}([0-9]{9})(?![0-9])", "medium", None, 0, re.I)
rule("C35", "CONTRACT_NO", r"(?:договор|контракт|соглашени)[а-яё]{0,4}(?:[ \t\u00a0]+[а-яё]+){0,3}(?:[ \t\u00a0]+от[ \t\u00a0]+[0-9.]{8,10}(?:[ \t\u00a0]?г\.)?)?[ \t\u00a0]*(№[ \t\u00a0]?[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё/._-]{0,30}[0-9A-Za-zА-Яа-яЁё]|№[ \t\u00a0]?[0-9]+)", flags=re.I)
rule("C36", "NOTARY_REG", r"(?<![0-9])[0-9]{2}/[0-9]{1,4}-н/[0-9]{2}-[0-9]{4}-[0-9]{1,2}-[0-9]{1,5}(?![0-9])")
rule("C37", "NOTARY_REG", r"реестров[а-яё]{2,3}[ \t\u00a0]*(?:номер[ \t\u00a0]*)?(№[ \t\u00a0]?[0-9][0-9А-Яа-я/-]*)", "medium", None, 0, re.I)
rule("C38", "BIK", r"БИК[^0-9A-Za-zА-Яа-яЁё]{0,4}([0-9]{9})(?![0-9])", check=lambda m, t: checks.bik(m.group(1)), flags=re.I)


def _account(m: re.Match, text: str) -> bool:
    """Any bank code of the whole document may validate an account."""
    found = digits(m.group(1))
    return any(checks.account(found, b) for b in re.findall(r"(?<![0-9])0[014][0-9]{7}(?![0-9])", text))


rule("C39", "ACCOUNT", r"(?:сч[её]т[а-яё]{0,3}|р/с[ч]?|к/с[ч]?)[^0-9\n]{0,12}([0-9]{20})(?![0-9])", check=_account, flags=re.I)
rule("C40", "CARD", r"(?:карт[аыуео][а-яё]{0,2})[^0-9\n]{0,12}([0-9](?:[ \u00a0-]?[0-9]){12,18})(?![0-9])", check=lambda m, t: checks.card(m.group(1).replace("\u00a0", " ")), flags=re.I)
rule("C41", "AMOUNT", r"(?<![0-9])[0-9]{1,3}(?:[ \u00a0][0-9]{3})*(?:,[0-9]{2})?[ \t\u00a0]?(?:₽|руб(?:\.|лей|ля|ль)?)(?![а-яё])")
rule("C42", "SNILS", r"(?:СНИЛС|страхов[а-яё]+[ \t\u00a0]+(?:номер|свидетельств)[а-яё]*)[^0-9A-Za-zА-Яа-яЁё]{0,6}([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{2})(?![0-9])", check=lambda m, t: checks.snils(digits(m.group(1))), flags=re.I)
rule("C43", "POLICY_OMS", r"полис[а-яё]{0,3}(?:[ \t\u00a0]+ОМС)?[^0-9A-Za-zА-Яа-яЁё]{0,4}([0-9]{16}|[0-9]{4}[ ][0-9]{4}[ ][0-9]{4}[ ][0-9]{4})(?![0-9])", "medium", None, 0, re.I)
rule("C44", "MRN", r"(?:медицинск[а-яё]{2,3}[ \t\u00a0]+карт[а-яё]{1,2}|истори[яи][ \t\u00a0]+болезни)[ \t\u00a0]*(?:пациента[ \t\u00a0]*)?(№[ \t\u00a0]?[0-9][0-9A-Za-zА-Яа-я/-]*)", "medium", None, 0, re.I)
rule("C45", "ICD", r"(?:МКБ(?:-10)?|диагноз|код)[^0-9A-Za-zА-Яа-яЁё]{0,4}([A-ZА-Я][0-9]{2}(?:\.[0-9]{1,2})?)(?![0-9A-Za-zА-Яа-я])", flags=re.I)
rule("C46", "PERSONNEL_NO", r"табельн[а-яё]{2,3}[ \t\u00a0]*(?:номер|№)?[ \t\u00a0:№]*([0-9]{1,10})(?![0-9])", "medium", None, 0, re.I)
rule("C47", "LABOUR_BOOK", r"трудов[а-яё]{2,3}[ \t\u00a0]+книжк[а-яё]{1,2}[ \t\u00a0:]*(?:сери[яи][ \t\u00a0]*)?([А-ЯA-Z]{2}(?:-[IVX]+)?[ \t\u00a0]*(?:№[ \t\u00a0]?)?[0-9]{7})(?![0-9])", "medium", None, 0, re.I)
rule("C48", "DL", r"(?:водительск[а-яё]{2,3}[ \t\u00a0]+удостоверени[а-яё]{1,2}|ВУ)[ \t\u00a0:№]*([0-9]{2}[ ]?[0-9A-ZА-Я]{2}[ ]?(?:№[ ]?)?[0-9]{6})(?![0-9])", "medium", None, 0, re.I)
# The twelve letters that number plates use.
PLATE_LETTERS = "АВЕКМНОРСТУХ"
rule("C49", "PLATE", rf"(?<![А-ЯЁа-яё0-9])[{PLATE_LETTERS}][ ]?[0-9]{{3}}[ ]?[{PLATE_LETTERS}]{{2}}[ ]?[0-9]{{2,3}}(?![0-9А-ЯЁа-яё])")

# --- dates -------------------------------------------------------------------------------------------

rule("C50", "DATE", r"(?<![0-9.])[0-9]{1,2}[./][0-9]{1,2}[./](?:[0-9]{4}|[0-9]{2})(?![0-9]|\.[0-9])")
rule("C51", "DATE", r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])")
# Genitive month names.
MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
rule("C52", "DATE", rf"(?<![0-9])[«\"]?[0-9]{{1,2}}[»\"]?[ \t\u00a0]+(?:{MONTHS})[ \t\u00a0]+[0-9]{{4}}(?:[ \t\u00a0]?г(?:\.|ода))?", flags=re.I)

# --- people ------------------------------------------------------------------------------------------


def _surname_initials(m: re.Match, text: str) -> bool:
    word = m.group("s")
    return not is_role(word) and surname_binds_left(m.group(), text, m.start())


rule("C53", "PER", rf"{NOT_IN_WORD}(?P<s>{CAP}){G}{U}\.{I1}{U}(?:\.|(?![А-Яа-яЁё.]))", check=_surname_initials)
rule("C54", "PER", rf"{NOT_IN_WORD}{INITIALS}{I1}(?P<s>{CAP}){END}", check=lambda m, t: not surname_precedes(t, m.start()) and not is_role(m.group("s")))
rule("C55", "PER", rf"{NOT_IN_WORD}(?P<s>{CAP}){G}{CAP}{G}{PATRONYMIC}{END}", "medium", lambda m, t: not is_role(m.group("s")))
rule("C56", "PER", rf"{NOT_IN_WORD}(?P<n>{CAP}){G}{PATRONYMIC}{G}(?P<s>{CAP}){END}", "medium", lambda m, t: not is_role(m.group("n")) and not is_role(m.group("s")) and not name_word_precedes(t, m.start()))
rule("C57", "PER", rf"{NOT_IN_WORD}(?P<n>{CAP}){G}{PATRONYMIC}{END}", "medium", lambda m, t: not is_role(m.group("n")) and not name_word_touches(t, m.start(), len(m.group())))


def _lone(m: re.Match, text: str) -> bool:
    if name_word_touches(text, m.start(), len(m.group())):
        return False
    adjective = re.search("(?:ной|ною|ны|не|ну)$", m.group())
    return not (adjective and capital_is_forced(text, m.start()))


rule("C58", "PER", rf"{NOT_IN_WORD}{U}{L}+(?:(?:ов|ев)ич(?:а|у|ем|ом|е)?|(?:ов|ев)н(?:а|ы|е|у|ой|ою)){END}", "medium", _lone)
rule("C59", "PER", rf"{NOT_IN_WORD}{CAP}{G}{CAP}{G}{CAP}{G}(?:оглы|кызы|гызы|улы|углы){END}")
rule("C60", "PER", rf"{NOT_IN_WORD}(?P<s>{CAP}){G}{U}\.(?![А-ЯЁ]|[ \t\u00a0]?[А-ЯЁ]\.)", "medium", lambda m, t: not m.group("s").lower().startswith(RUBRICS) and not is_role(m.group("s")) and not capital_is_forced(t, m.start()) or (not m.group("s").lower().startswith(RUBRICS) and not is_role(m.group("s")) and re.search("(?:ов|ев|ин|ук|юк|ко|ян|ский)$", m.group("s")) is not None))
