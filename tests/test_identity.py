import pytest

from cloakwork.operators import morph, precision, restore, spread, surrogate
from cloakwork.operators.detect import detect
from cloakwork.operators.overlap import Span, rewrite


def test_declension():
    assert morph.full_forms("Берёзов Глеб Ильич") == ["Берёзов Глеб Ильич", "Берёзова Глеба Ильича", "Берёзову Глебу Ильичу", "Берёзовым Глебом Ильичем", "Берёзове Глебе Ильиче"]
    assert morph.inflect_full("Полянская Мария Глебовна", "dat") == "Полянской Марии Глебовне"
    assert morph.inflect_surname("Шевченко", "ins", "m") == "Шевченко"
    assert morph.lemmatize_surname("Ковалёвым", "m") == "Ковалёв" and morph.infer_surname_case("Ковалёвым", "m") == "ins"
    assert morph.lemma_of("Тополевым Дмитрием Аркадьевичем").parts == ("Тополев", "Дмитрий", "Аркадьевич")
    assert [morph.plural_index(n) for n in (1, 2, 5, 11, 21, 112)] == [0, 1, 2, 2, 0, 2]


def test_spread():
    text = "Составил Тополев Дмитрий Аркадьевич. Тополеву передали карты."
    found = detect(text, ["PER"])
    assert [(s.raw, s.identity) for s in spread.spread_identities(text, found)] == [("Тополеву", "Тополев Дмитрий Аркадьевич")]
    # A word that also occurs in lower case is no name.
    text = "Составил Лугов Дмитрий Аркадьевич. Среди лугов. Лугов нет."
    assert spread.spread_identities(text, detect(text, ["PER"])) == []
    text = "на участке Светлый бурили. В пределах Светлого и Дальнего найдено."
    found = detect(text, ["GEO_NAME"])
    assert [s.raw for s in spread.spread_geo_names(text, found)] == ["Светлого"]
    assert [s.raw for s in spread.enumerate_neighbours("участки Светлый, Дальний и Нижний", Span("GEO_NAME", 8, 15, "Светлый"))] == ["Дальний", "Нижний"]


@pytest.mark.parametrize("text,raw,false", [("Институт имени Вернадского", "Вернадского", True), ("от имени Берёзова", "Берёзова", False), ("Ф.И.О.", "Ф.И.О.", True), ("Заказчик", "Заказчик", True), ("ул. Гагарина, д. 5", "Гагарина", True), ("в лице директора Осинина", "Осинина", False)])
def test_precision(text, raw, false):
    assert precision.is_false_person(raw, text, text.index(raw)) is false


def test_model_spans_are_trimmed():
    text = " — Осинин, "
    assert [s.raw for s in precision.filter_model_persons(text, [Span("PER", 0, len(text), text, "high", "ner")])] == ["Осинин"]


def _vault():
    return [restore.Entry("[PER_01]", "PER", "Берёзов Глеб Ильич"), restore.Entry("[ORG_01]", "ORG", "ООО «Вектор»")]


@pytest.mark.parametrize(
    "bent,tier",
    [("[PER_01]", "exact"), ("[per_01]", "loose"), ("[PER_1]", "loose"), ("PER_01", "loose"), ("**PER_01**", "loose"), ("[ PER_01 ]", "loose"), ("[PER-01]", "loose"), ("[PFR_01]", "fuzzy"), ("[PERR_01]", "fuzzy")],
)
def test_restore_tiers(bent, tier):
    r = restore.restore(f"Вот {bent} здесь", _vault())
    assert r.by_tier == {tier: 1} and "Берёзов Глеб Ильич" in r.text


def test_restore_is_careful():
    r = restore.restore("нет [PER_07] и [XYZ_01]", _vault())
    assert r.restored == 0 and len(r.orphans) == 2 and restore.describe_orphans(r)
    ambiguous = [restore.Entry("[AB_01]", "AB", "x"), restore.Entry("[AC_01]", "AC", "y")]
    assert restore.restore("[AD_01]", ambiguous).restored == 0
    assert restore.restore("письмо от [PER_01]", _vault()).text == "письмо от Берёзова Глеба Ильича"


def test_round_trip():
    text = "Берёзов И.П. писал 12.03.2020, Берёзову И.П. ответили."
    spans = detect(text, ["PER", "DATE"])
    vault, out = [], []
    for i, s in enumerate(spans, 1):
        vault.append(restore.Entry(f"[{s.type}_{i:02d}]", s.type, s.raw))
        out.append((s.start, s.end, vault[-1].token))
    assert restore.restore(rewrite(text, out), vault).text == text


def test_levenshtein():
    assert restore.levenshtein_within("kitten", "sitting", 3) == 3
    assert restore.levenshtein_within("kitten", "sitting", 2) is None


def test_surrogates():
    salt = surrogate.salt_of(b"key", "scope")
    made = surrogate.surrogate("INN", "[INN_01]", "7707083893", salt=salt)
    from cloakwork.operators import checks

    assert checks.inn(made) and made == surrogate.surrogate("INN", "[INN_01]", "7707083893", salt=salt)
    assert surrogate.shifted_date("31.12.2020", 366) == "01.01.2021" and surrogate.shifted_date("2020-02-29", 365) == "2020-02-29"
    assert surrogate.shifted_date("30.02.2020", 1) is None
    assert surrogate.shifted_coord("55°45′21″", 5).startswith("55°")
    assert surrogate.surrogate("CASE", "[CASE_01]", "без цифр", salt=salt) == "[CASE_01]"
    assert surrogate.surrogate("PER", "[PER_01]", "Берёзова Анна", salt=salt).split()[0].endswith(("а", "ая"))
