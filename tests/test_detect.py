import pytest

from cloakwork import fixtures
from cloakwork.operators import coords, legend
from cloakwork.operators.detect import detect
from cloakwork.operators.normalize import normalize, soften_caps, to_source
from cloakwork.operators.overlap import Span, mask, resolve
from cloakwork.operators.registry import TYPES, entities_for_vertical, gate_types, read_types

ALL = [t for t in TYPES if t != "AMOUNT"]


def raws(text, *types):
    return [s.raw for s in detect(text, types or ALL)]


@pytest.mark.parametrize("doc_id,text", fixtures.TEXTS)
def test_fixture_spans(doc_id, text):
    found = {(doc_id, s.type, s.raw.strip()) for s in detect(text, ALL)}
    assert found == {e for e in fixtures.EXPECTED if e[0] == doc_id}
    assert all(text[s.start : s.end] == s.raw for s in detect(text, ALL))


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Утвердил А.С. Осинин", ["А.С. Осинин"]),
        ("М.П.\nПОСТАВЩИК", []),
        ("Директор Лугов И.И. Главный инженер Озеров П.П.", ["Лугов И.И.", "Озеров П.П."]),
        ("Съёмку вёл Самедов Рауф Тофик оглы", ["Самедов Рауф Тофик оглы"]),
        ("Рисунок В. Разрез по линии пять", []),
        ("Обращение к Глебу Аркадьевичу", ["Глебу Аркадьевичу"]),
    ],
)
def test_people(text, expected):
    assert raws(text, "PER") == expected


def test_wells_and_their_neighbours():
    assert raws("Опробована скважина 3047-К, рядом скв. 518б", "WELL") == ["скважина 3047-К", "скв. 518б"]
    for text in ("глубина скважины 86,5", "скважина 2019 года бурения", "скважины 0", "скважин 14 шт."):
        assert raws(text, "WELL") == [], text


def test_subsoil_licences_have_a_known_region_and_kind():
    assert raws("по лицензии ЧУК 15823 БР работы ведутся", "LICENSE_SUBSOIL") == ["ЧУК 15823 БР"]
    assert raws("ТОМ 70214 КЭ", "LICENSE_SUBSOIL") == ["ТОМ 70214 КЭ"]
    for text in ("ЪЫЬ 15823 БР", "ЧУК 15823 МД", "ЧУК 158 БР"):
        assert raws(text, "LICENSE_SUBSOIL") == [], text


def test_geo_names():
    assert raws("участок Северный", "GEO_NAME") == ["Северный"]
    assert raws("в 5 км от р. Урал", "GEO_NAME") == ["р. Урал"]
    assert raws("месторождения Российской Федерации учтены", "GEO_NAME") == []
    assert [n for _, n in legend.detect("Участки:\n- Южный блок\n- глина, песок\n\nПрочее:\n- Дальний\n")] == ["Южный блок"]


def test_checked_numbers():
    assert raws("СНИЛС 112-233-445 96", "SNILS") == []
    assert raws("карта 4111 1111 1111 1111", "CARD") == ["карта 4111 1111 1111 1111"]
    assert raws("Итого 125 000,50 руб.", "AMOUNT") == ["125 000,50 руб."]
    assert "IP" not in entities_for_vertical("geo") and "AMOUNT" not in entities_for_vertical("finance")
    # The bank code that proves an account may stand anywhere in the document.
    account = next(f"4070281{n:013d}" for n in range(10**6) if detect(f"р/с 4070281{n:013d}\nБИК 044525225", ["ACCOUNT"]))
    assert raws(f"р/с {account}", "ACCOUNT") == []


def test_coordinates():
    assert coords.parse_component("55°45′21″ с.ш.") == (pytest.approx(55.755833, abs=1e-6), "lat")
    assert [c.system for c in coords.detect("СК-42: X=6123456 Y=7412345")] == ["SK-42"]
    assert coords.detect("цена 12.5000, 13.2500 руб") == []
    assert len(coords.detect("координаты 55.7512, 37.6184")) == 1
    cells = coords.detect("координаты |55.75123|37.61842|")
    assert len(cells) == 2 and cells[0].lat and cells[1].lon
    assert len(coords.ranges("от 55°10′ до 55°20′ с.ш.")) == 1


def test_normalisation_maps_back():
    for source, repaired in (
        ("догово​р", "договор"), ("дог0вор", "договор"), ("дoгoвoр", "договор"), ("заклю-\nчённый", "заключённый"), ("И в а н о в", "Иванов"), ("**жирный** текст", "жирный текст"), ("ДоговорABC", "Договор ABC"), ("ＡＢＣ №½", "ABC №½"),
    ):
        n = normalize(source)
        assert n.text == repaired
        assert len(n.map) == len(n.text)
    n = normalize("от Ив​анов")
    at = n.text.index("Иванов")
    assert to_source(n, at, at + 6) == (3, 10)
    assert normalize("обычный текст").unchanged
    assert soften_caps("ДИРЕКТОР ИВАНОВ ООО") == "Директор Иванов Ооо" and soften_caps("ООО") == "ООО"


def test_resolution_is_greedy():
    spans = [Span("A", 0, 5, "x", "high", "ner"), Span("B", 4, 8, "x", "medium", "rule"), Span("C", 8, 9, "x", "high", None)]
    assert [s.type for s in resolve(spans)] == ["B", "C"]
    assert mask("abcdefghi", [Span("T", 2, 4, "cd")]) == "ab[T]efghi"


def test_types_and_gate():
    assert read_types({}) == ["PER", "ORG", "DATE", "CASE"]
    assert read_types({"types": ["INN", "nonsense"]}) == ["INN"]
    for profile in ("base", "finance"):
        with pytest.raises(PermissionError):
            gate_types(profile)
    assert gate_types("base", pass_through=True) == []


def test_empty_and_strange_texts():
    for text in (None, "", "\n\n", "😀" * 50, "(" * 5000, "1." * 5000, "А" * 5000):
        detect(text, ALL)
