"""Spark operators: tokens, plans, audit, crypto, sources, streaming."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import audit, crypto, scoring, tokens
from cloakwork.plans.deid import DeidPlan, pseudonymize
from cloakwork.plans.pipeline import PROFILES, Component, ConfigStore, Registry, apply_profile, degrade, provision, run_at_rest, run_egress, run_response
from cloakwork.sources import containers, tables
from cloakwork.streaming.gate import gate


def test_pseudonymize_and_restore(spark):
    docs = spark.createDataFrame([(1, "a@x.org and b@x.org"), (2, "b@x.org again"), (3, "none"), (4, None)], "doc_id bigint, text string")
    plan = DeidPlan(("EMAIL",))
    spans = plan.spans(docs)
    redacted, vault = pseudonymize(docs, spans)
    got = {r.doc_id: r.text for r in redacted.collect()}
    assert got == {1: "[EMAIL_02] and [EMAIL_01]", 2: "[EMAIL_01] again", 3: "none", 4: None}
    back = tokens.restore_exact(redacted.withColumn("scope", F.lit("default")), vault)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "a@x.org and b@x.org", 2: "b@x.org again", 3: "none", 4: None}
    more = spark.createDataFrame([(9, "c@x.org b@x.org")], "doc_id bigint, text string")
    again, new = pseudonymize(more, plan.spans(more), vault)
    assert again.first().text == "[EMAIL_03] [EMAIL_01]" and [r.token for r in new.collect()] == ["[EMAIL_03]"]


def test_fuzzy_match(spark):
    vault = spark.createDataFrame([("s", "[PER_01]", "x"), ("s", "[ORG_01]", "y")], "scope string, token string, raw string")
    c = spark.createDataFrame([("[per 1]", "PER_1"), ("[PET_1]", "PET_1"), ("[XX_1]", "XX_1")], "candidate string, key string")
    assert {r.candidate: (r.token, r.tier) for r in tokens.fuzzy_match(c, vault).collect()} == {"[per 1]": ("[PER_01]", "loose"), "[PET_1]": ("[PER_01]", "fuzzy")}


def test_chain_and_checkpoint(spark):
    records, before = [], audit.GENESIS
    for i in range(3):
        records.append(audit.build_record({"b": 1, "a": i}, i, before, 100 + i))
        before = records[-1]["hash"]
    assert audit.verify_chain(records) == (True, None)
    records[1]["entry"] = {"a": 9}
    assert audit.verify_chain(records) == (False, 1)
    keys = audit.ed25519_keys()
    signature = audit.sign_checkpoint({"seq": 2}, keys)
    assert audit.verify_checkpoint({"seq": 2}, signature, keys) and not audit.verify_checkpoint({"seq": 3}, signature, keys)
    assert audit.canonicalize({"b": [1, {"d": 2, "c": 3}], "a": "я"}) == '{"a":"я","b":[1,{"c":3,"d":2}]}'


def test_nested_values_and_scans(spark):
    value, n = audit.walk_strings({"a": ["x", {"b": "x"}], "n": 1}, lambda s: ("y", 1))
    assert value == {"a": ["y", {"b": "y"}], "n": 1} and n == 2
    deep = "secret"
    for _ in range(12):
        deep = [deep]
    assert "secret" not in str(audit.walk_strings(deep, lambda s: (s, 0))[0])
    rows = spark.createDataFrame([("text", "a", None), ("image", "a", None), ("pdf", None, b"1")], "kind string, text string, bytes binary")
    ok, held = audit.split_scans(rows)
    assert (ok.count(), held.count()) == (1, 2)
    with pytest.raises(Exception, match="scan"):
        audit.block_scans(rows).collect()
    assert audit.check_shell("curl https://evil.test/x", ["good.test"])["blocked_host"] == "evil.test"
    assert audit.check_shell("curl https://a.good.test/x", ["good.test"])["allowed"] and audit.check_shell("ls /tmp", ["good.test"])["allowed"]


def test_crypto(spark):
    kek = crypto.generate_kek()
    assert crypto.decrypt_bytes(crypto.encrypt_bytes("тайна".encode(), kek), kek).decode() == "тайна"
    with pytest.raises(Exception):
        crypto.decrypt_bytes(crypto.encrypt_bytes(b"x", kek), crypto.generate_kek())
    assert crypto.unwrap_with_passphrase(crypto.wrap_with_passphrase(kek, "pw"), "pw") == kek
    kms = crypto.LocalKms(crypto.generate_kek())
    assert crypto.open_kek(crypto.seal_kek(kms, kek), {"local": kms}) == kek
    with pytest.raises(KeyError):
        crypto.open_kek("other:v1:aaaa", {"local": kms})
    with pytest.raises(PermissionError):
        crypto.get_kek()
    vault = spark.createDataFrame([("s", "[PER_01]", "PER", "a"), ("s", "[PER_02]", "PER", "b")], "scope string, token string, type string, raw string")
    sealed = crypto.seal_rows(vault, kek)
    assert crypto.open_rows(sealed, kek, "raw string").orderBy("token").collect()[1].raw == "b"
    moved = sealed.withColumn("token", F.lit("[PER_09]"))
    with pytest.raises(Exception):
        crypto.open_rows(moved, kek, "raw string").collect()


def test_keyfile_and_stores(spark, tmp_path):
    blob = crypto.protect_with_keyfile(b"k" * 32, str(tmp_path / "key"))
    assert crypto.get_kek(keyfile=(blob, str(tmp_path / "key"))) == b"k" * 32
    heard = []
    store = ConfigStore(str(tmp_path / "c.json"))
    store.on_change(lambda k, v: heard.append(k))
    store.set("a", {"x": 1})
    assert ConfigStore(str(tmp_path / "c.json")).get("a") == {"x": 1} and heard == ["a"]
    env = tmp_path / ".env"
    env.write_text("KEEP=1\n")
    provision(str(env), {"A": "1"})
    provision(str(env), {"A": "2"})
    assert env.read_text().count("cloakwork") == 2 and "KEEP=1" in env.read_text() and "A=2" in env.read_text()
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "text": "a"}\nbroken\n')
    assert tables.read_jsonl(spark, str(tmp_path / "c.jsonl")).filter("doc_id IS NOT NULL").count() == 1
    vault = spark.createDataFrame([("s", "[PER_01]", "PER", "a")], "scope string, token string, type string, raw string")
    tables.write_vault(crypto.seal_rows(vault, b"0" * 32), str(tmp_path / "vault"))
    assert crypto.open_rows(tables.read_vault(spark, str(tmp_path / "vault"), "s"), b"0" * 32, "raw string").first().raw == "a"


def test_registry_order(spark):
    r = Registry()
    df = spark.range(1)
    r.add(Component("b", depends=("a",), egress=lambda d: d.withColumn("b", F.col("a")), response=lambda d: d.drop("b")))
    r.add(Component("a", egress=lambda d: d.withColumn("a", F.lit(1)), at_rest=lambda x: x + b"!"))
    assert [c.id for c in r.order()] == ["a", "b"]
    assert run_egress(r, df).columns == ["id", "a", "b"] and run_response(r, run_egress(r, df)).columns == ["id", "a"] and run_at_rest(r, b"x") == b"x!"
    assert set(apply_profile(r, PROFILES["geo"])) == set(PROFILES["geo"])
    loop = Registry()
    loop.add(Component("x", depends=("y",)))
    with pytest.raises(LookupError):
        loop.order()
    loop.add(Component("y", depends=("x",)))
    with pytest.raises(LookupError, match="cycle"):
        loop.order()
    assert (degrade(None, True), degrade("m", True), degrade("m", False), degrade("m", True, True)) == ("rules", "model", "block", "block")


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _find(text):
    return [(i, i + 6, "[PER_01]") for i in range(len(text)) if text.startswith("Осинин", i)]


def test_containers(spark, tmp_path):
    docx = _zip({"word/document.xml": '<w:p><w:r><w:t>Это Оси</w:t></w:r><w:r><w:t>нин &amp; Ко</w:t></w:r></w:p><w:ins w:author="Осинин"/>', "docProps/core.xml": "<dc:title>Осинин</dc:title><dc:creator>Осинин</dc:creator>"})
    new = containers.rewrite_docx(docx, _find)
    assert containers.docx_text(new) == "Это [PER_01] & Ко"
    containers.assert_contains_none(new, ["Осинин"])
    with pytest.raises(ValueError):
        containers.assert_contains_none(docx, ["Осинин"])
    xlsx = _zip({"xl/sharedStrings.xml": "<sst><si><t>Осинин</t></si><si><r><t>Оси</t></r><r><t>нин</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<c t="str"><f>A1</f><v>Осинин</v></c>'})
    assert containers.xlsx_text(containers.rewrite_xlsx(xlsx, _find)).count("[PER_01]") == 3
    pdf = b"1 0 obj\nstream\n" + zlib.compress("(Осинин [PER_02]) Tj".encode("cp1251")) + b"\nendstream"
    assert "Осинин" in containers.pdf_text(pdf) and containers.pdf_placeholders(pdf) == ["[PER_02]"]
    with pytest.raises(ValueError):
        containers.assert_pdf_contains_none(pdf, ["Осинин"])
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.pdf").write_bytes(pdf)
    assert {r.kind: "Осинин" in r.text for r in tables.read_containers(spark, str(tmp_path)).collect()} == {"docx": True, "pdf": True}


def test_scoring():
    text = "«Осинин» пришёл"
    assert scoring.sensitive_coverage(text, [("PER", 0, 8)], [("PER", 1, 7)]) == (1, 0, 0)
    assert scoring.sensitive_coverage(text, [("PER", 0, 8)], [("ORG", 1, 7)]) == (0, 1, 1)
    assert scoring.token_counts("a b c", [("T", 0, 3)], [("T", 2, 5)]) == (1, 1, 1)
    assert scoring.two_annotators([("T", 0, 3), ("T", 5, 9)], [("T", 0, 3), ("T", 6, 8)]) == {"pairs": 2, "exact": 1, "jaccard": 1.0, "bounds": 0.5}
    assert scoring.align("x  Светлый\nучасток Светлый", [("GEO", "Светлый", "Светлый участок"), ("GEO", "нет", "нет")]) == ([("GEO", 3, 10), ("GEO", 19, 26)], 1)
    assert scoring.gaps_preserved("ab cd ef", [(3, 5)], "ab [T] ef", ["[T]"]) and not scoring.gaps_preserved("ab cd ef", [(3, 5)], "ab[T] ef", ["[T]"])
    parts = scoring.chunks("строка\n" * 2000)
    assert "".join(t for _, t in parts) + "строка\n" * 0 == ("строка\n" * 2000)[: sum(len(t) for _, t in parts)] and all(len(t) <= 3000 for _, t in parts)


def test_stream_numbers_by_scope(spark, tmp_path):
    schema = "scope string, message_id bigint, text string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("u", 1, "a@x.org"), ("v", 1, "z@x.org")], schema).coalesce(1).write.parquet(source)
    q = gate(spark.readStream.schema(schema).parquet(source), ["EMAIL"]).writeStream.format("memory").queryName("gate_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    spark.createDataFrame([("u", 2, "b@x.org a@x.org")], schema).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert {(r.scope, r.message_id): r.text for r in spark.table("gate_out").collect()} == {("u", 1): "[EMAIL_01]", ("v", 1): "[EMAIL_01]", ("u", 2): "[EMAIL_02] [EMAIL_01]"}
