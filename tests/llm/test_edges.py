"""Each operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import ann, langid, licenses, linededup, minhash, mixing, packing, pii, quality, substring

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i + seed * 7 + i // 3) % 20] + str((i * 31 + seed) % 97) for i in range(n))


ROWS = [
    (1, prose(60), "en", "a"),
    (1, prose(60), "en", "a"),
    (2, prose(60), "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", None),
    (None, prose(80, 3), "de", "c"),
    (6, prose(20000, 5), "de", "c"),
    (7, "x", "en", "a"),
    (8, "😀 é ß\n\n" + prose(40, 9), "fr", "d"),
    (9, prose(60) + " end", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "key node size root taken target _k1 _row _x _w d k".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], SCHEMA)
    for c in CLASHES:
        rows = rows.withColumn(c, F.lit("clash"))
    return rows.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


PER_ROW = {"packing": packing.pack, "minhash": minhash.classes, "langid": langid.identify, "licenses": licenses.report, "pii": pii.digest, "mixing": mixing.plan, "lines": linededup.summary, "quality": quality.score, "substring": substring.repeats}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_edges(docs, nothing, name):
    got = PER_ROW[name](docs).collect()
    if name not in ("packing", "substring"):
        assert len(got) == len(ROWS)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id == 3) == 1 and sum(r.doc_id == 1 for r in got) == 2
    if name == "minhash":
        by = {r.doc_id: r.class_id for r in got}
        assert by[2] == by[9] == 1 and by[3] == 3 and by[8] == 8
    if name == "langid":
        assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    if name == "mixing":
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        per = {}
        for r in got:
            per.setdefault(r.source, [0, r.target])[0] += r.taken
        assert all(abs(t - g) <= 1 for t, g in per.values())
        assert abs(sum(t for t, _ in per.values()) - 1.5 * sum(r.size for r in got)) < 6
    if name == "lines":
        assert {r.doc_id: r.n_removed for r in got if r.doc_id in (1, 2, 9)} == {1: 0, 2: 1, 9: 1}
    if name == "quality":
        assert {r.doc_id for r in got if r.base_failed} >= {3, 4, 5, 7}
    if name == "substring":
        assert {r.doc_id for r in got} == {1, 2, 9}
    assert PER_ROW[name](nothing).count() == 0


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, "")
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert {"quality rules": {1, 2, 8, 9, None}, "line dedup": {1, 3, 4, 5, 6, 7, 8, None}, "near dedup": {1, 3, 4, 5, 6, 7, 8, None}, "mixing": {1, 2, 6, 7, 8, 9, None}}[name] == ids
        assert {r.key for r in out.select("key").collect()} == {"clash"}
    assert stage(spark, nothing, "").count() == 0


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [1.0]), (None, [1.0, 1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    for q in (0, 20, 40):
        v = dict(rows)
        scores = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(60) if i != q))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in scores]
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
