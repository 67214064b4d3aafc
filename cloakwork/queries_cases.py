"""Queries that apply single rules and steps to invented texts, so that each of them fires; their twins hold the rows by hand.

The texts need no driver table. Every step runs as it does in a plan, in Arrow batches over a column.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from cloakwork import cases
from cloakwork.fixtures import values
from cloakwork.operators import coords, morph, precision, spread
from cloakwork.operators.detect import rule_hits
from cloakwork.operators.normalize import normalize, soften_caps, to_source
from cloakwork.operators.overlap import Span
from cloakwork.queries import query


def _numbered(rows: list[tuple], keep) -> list[tuple]:
    return [(i, *keep(r)) for i, r in enumerate(rows)]


@query(values(_numbered(cases.RULES, lambda r: (r[0], r[2])), "id, rule, found"))
def rule_cases(spark, sf_dir):
    """C1-C60, CV1-CV9: every rule by itself, on a text that it must find and on one that it must leave alone."""
    given = spark.createDataFrame(_numbered(cases.RULES, lambda r: r[:2]), "id int, rule string, text string")
    return given.select("id", "rule", F.array_join(rule_hits(F.col("text"), F.col("rule")), " | ").alias("found"))


@query(values(_numbered(cases.NORMAL, lambda r: (r[0], r[2], r[3], r[1] == r[2])), "id, step, repaired, last_source, unchanged"))
def normal_cases(spark, sf_dir):
    """The repaired text, and the source of its last word by the map of positions."""

    @F.pandas_udf("repaired string, last_source string, unchanged boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            n = normalize(t)
            start, end = to_source(n, len(n.text) - len(n.text.split(" ")[-1]), len(n.text))
            out.append((n.text, t[start:end], n.unchanged))
        return pd.DataFrame(out, columns=["repaired", "last_source", "unchanged"])

    given = spark.createDataFrame(_numbered(cases.NORMAL, lambda r: r[:2]), "id int, step string, text string")
    return given.select("id", "step", run("text").alias("n")).select("id", "step", "n.*")


@query(values(_numbered(cases.CAPS, lambda r: r), "id, text, softened"))
def softened_caps(spark, sf_dir):
    """A13."""
    soften = F.pandas_udf(lambda text: text.map(soften_caps), "string")
    return spark.createDataFrame(_numbered(cases.CAPS, lambda r: r[:1]), "id int, text string").select("id", "text", soften("text").alias("softened"))


_PLACES = list(dict.fromkeys((step, text) for step, text, *_ in cases.COORDS))


@query(values([(_PLACES.index((r[0], r[1])), r[0], r[2], *(v and round(v, 6) for v in r[3:])) for r in cases.COORDS if r[2]], "id, step, raw, lat, lon, x, y"))
def coord_cases(spark, sf_dir):
    """Coordinates of every form, read; pairs that are none give no row."""

    @F.pandas_udf("array<struct<raw:string,lat:double,lon:double,x:double,y:double>>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"raw": c.raw, "lat": c.lat, "lon": c.lon, "x": c.x, "y": c.y} for c in coords.detect(t)])

    given = spark.createDataFrame([(i, *p) for i, p in enumerate(_PLACES)], "id int, step string, text string")
    return given.select("id", "step", F.explode(run("text")).alias("c")).select("id", "step", "c.raw", *(F.round(f"c.{v}", 6).alias(v) for v in ("lat", "lon", "x", "y")))


@query(values(_numbered(cases.PERSONS, lambda r: (r[0], r[4])), "id, rule, kept"))
def person_cases(spark, sf_dir):
    """What only looks like a person goes, role words and blanks are cut, broken names are joined."""

    @F.pandas_udf("string")
    def run(source: pd.Series, text: pd.Series, raw: pd.Series) -> pd.Series:
        out = []
        for who, t, r in zip(source, text, raw):
            given = [Span("PER", m.start(), m.end(), r, "medium", "rule" if who == "rule" else "ner") for m in re.finditer(re.escape(r), t)]
            out.append(" | ".join(s.raw for s in precision.refine_persons(t, precision.filter_model_persons(t, given))))
        return pd.Series(out, dtype=object)

    given = spark.createDataFrame(_numbered(cases.PERSONS, lambda r: r[:4]), "id int, rule string, source string, text string, raw string")
    return given.select("id", "rule", run("source", "text", "raw").alias("kept"))


_STEPS = {"G1": spread.spread_identities, "G2": spread.spread_surfaces, "G4": spread.spread_geo_names, "G5": lambda text, spans: spread.enumerate_neighbours(text, spans[0])}


@query(values(_numbered(cases.SPREAD, lambda r: (r[0], r[4])), "id, step, found"))
def spread_cases(spark, sf_dir):
    """What one proven span proves elsewhere in its text."""

    @F.pandas_udf("string")
    def run(step: pd.Series, text: pd.Series, type_: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([" | ".join(s.raw for s in _STEPS[g](t, [Span(k, t.index(r), t.index(r) + len(r), r)])) for g, t, k, r in zip(step, text, type_, raw)])

    given = spark.createDataFrame(_numbered(cases.SPREAD, lambda r: r[:4]), "id int, step string, text string, type string, raw string")
    return given.select("id", "step", run("step", "text", "type", "raw").alias("found"))


def _asked(name: str, gender: str | None, what: str) -> str | None:
    parsed = morph.parse_name(name)
    if what == "gender":
        return parsed.gender
    if what == "surname":
        return parsed.parts[parsed.surname]
    if what in morph.CASES:
        return morph.inflect_full(name, what, gender)
    if what == "lemma":
        return morph.lemmatize_surname(name, gender)
    if what == "case":
        return morph.infer_surname_case(name, gender)
    if what == "analyze":
        found = morph.LocalMorph().analyze(name, "PER")
        return f"{found['lemma']}/{found['gender']}/{found['case']}"
    if what == "plural":
        return str(morph.plural_index(int(name)))
    return morph.lemmatize_name(name, gender, morph.inflect_patronymic if what == "patronymic" else morph.inflect_name)


@query(values(_numbered(cases.MORPH, lambda r: r), "id, step, name, gender, asked, answer"))
def morph_cases(spark, sf_dir):
    """H1-H7: parsing, declension, lemmas, cases, agreement."""

    @F.pandas_udf("string")
    def run(name: pd.Series, gender: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([_asked(n, g if isinstance(g, str) else None, a) for n, g, a in zip(name, gender, asked)], dtype=object)

    given = spark.createDataFrame(_numbered(cases.MORPH, lambda r: r[:4]), "id int, step string, name string, gender string, asked string")
    return given.select("id", "step", "name", "gender", "asked", run("name", "gender", "asked").alias("answer"))
