import json

import pytest

from cloakwork import Gate, deidentify_outbound, deidentify_responses, mask_coordinates
from cloakwork.plans.pipeline import run_egress, run_response

ROWS = [(1, "u", "Осинин И.П. и ООО «Вектор», ИНН 7707083893"), (2, "v", "пусто"), (3, "u", "координаты 55°45′21″ с.ш. 37°37′04″ в.д.")]


def test_outbound(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, scope string, text string")
    redacted, new, receipts = deidentify_outbound(docs, "standard")
    got = {r.doc_id: r.text for r in redacted.collect()}
    assert got[1] == "[PER_01] и [ORG_01], [INN_01]" and got[2] == "пусто"
    assert {r.doc_id: r.entities for r in receipts.collect()} == {1: 3, 2: 0, 3: 0}
    assert new.count() == 3
    with pytest.raises(PermissionError):
        deidentify_outbound(docs, "finance")


def test_responses(spark):
    rows = spark.createDataFrame([(json.dumps({"a": ["a@x.org", 1, {"b": "b@x.org"}]}),), ("no json a@x.org",), (None,)], "response string")
    got = [(r.redacted, r.entities) for r in deidentify_responses(rows, ["EMAIL"]).collect()]
    assert got == [('{"a": ["[EMAIL]", 1, {"b": "[EMAIL]"}]}', 2), ("no json [EMAIL]", 1), (None, 0)]


def test_components_and_back(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, scope string, text string")
    masked, _ = mask_coordinates(docs)
    assert "[GEO_01]" in {r.doc_id: r.text for r in masked.collect()}[3]
    gate = Gate("geo")
    assert gate.skipped == []
    out = run_egress(gate.registry, docs)
    text = {r.doc_id: r.text for r in out.collect()}
    assert "[GEO_01]" in text[3] and "[PER_01]" in text[1]
    assert {r.doc_id: r.text for r in run_response(gate.registry, out).collect()} == {d: t for d, _, t in ROWS}
