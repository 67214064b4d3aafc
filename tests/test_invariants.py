"""Texts without entities stay as they are; gaps between spans stay byte for byte; restoring gives the source."""

import duckdb
import pytest

from cloakwork import fixtures
from cloakwork.operators import restore
from cloakwork.operators.detect import detect
from cloakwork.operators.overlap import rewrite
from cloakwork.operators.registry import TYPES
from cloakwork.operators.scoring import gaps_preserved

SF = "/root/testdata/sf0.001"
SOURCES = {
    "documents": "SELECT text FROM '{}/documents.parquet' WHERE length(text) < 6000",
    "conversations": "SELECT text FROM '{}/conversations.parquet'",
}


@pytest.mark.parametrize("name", [*SOURCES, "fixture"])
def test_invariants(name):
    texts = [t for _, t in fixtures.TEXTS] if name == "fixture" else [r[0] for r in duckdb.sql(SOURCES[name].format(SF)).fetchall()]
    types = [t for t in TYPES if t != "AMOUNT"]
    for text in texts:
        spans = detect(text, types)
        vault = [restore.Entry(f"[{s.type}_{i:02d}]", s.type, s.raw) for i, s in enumerate(spans, 1)]
        redacted = rewrite(text, [(s.start, s.end, e.token) for s, e in zip(spans, vault)])
        assert gaps_preserved(text, [(s.start, s.end) for s in spans], redacted, [e.token for e in vault])
        assert spans or redacted == text
        exact = [restore.Entry(e.token, "RAW", e.raw) for e in vault]
        assert restore.restore(redacted, exact, fuzzy=False).text == text
