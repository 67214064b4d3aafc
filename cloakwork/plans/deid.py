"""The de-identification plan: presets of stages, one Arrow function per text, and the scope-wide table work around it.

Presets: component (rules, model spans, precision, propagation), gate and cell (rules only), paragraph
(rules only, no cues), geo_eval (rules, geographic and surface propagation).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.operators import precision, spread, tokens
from cloakwork.operators.detect import SPANS, as_rows, detect
from cloakwork.operators.overlap import Span, resolve, without
from cloakwork.operators.registry import TYPES

PRESETS = {
    "component": ("rules", "model", "precision", "identities", "geo", "surfaces"),
    "gate": ("rules",),
    "cell": ("rules",),
    "paragraph": ("rules",),
    "geo_eval": ("rules", "geo", "surfaces"),
}


@dataclass(frozen=True)
class DeidPlan:
    types: tuple[str, ...]
    preset: str = "gate"
    model: Callable[[str], list[Span]] | None = None

    @property
    def stages(self) -> tuple[str, ...]:
        return PRESETS[self.preset]

    def spans_of(self, text: str | None) -> list[Span]:
        if not text:
            return []
        found = detect(text, [t for t in self.types if t in TYPES])
        suppressed: set = set()
        if "model" in self.stages and self.model is not None:
            found = resolve([*found, *precision.filter_model_persons(text, self.model(text))])
        if "precision" in self.stages and "PER" in self.types:
            found = precision.refine_persons(text, found, suppressed)
        if "identities" in self.stages:
            found = found + spread.spread_identities(text, found)
        if "geo" in self.stages:
            found = found + spread.spread_geo_names(text, found)
            found += [n for s in found if s.type == "GEO_NAME" for n in spread.enumerate_neighbours(text, s)]
        if "surfaces" in self.stages:
            found = found + spread.spread_surfaces(text, found)
        return without(resolve(found), suppressed)

    def column(self, text: Column) -> Column:
        plan = self

        @F.pandas_udf(SPANS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda t: as_rows(plan.spans_of(t)))

        return run(text)

    def spans(self, docs: DataFrame, key: str = "doc_id", scope: Column | None = None) -> DataFrame:
        """One row per span: key, scope, type, start, end, raw, confidence, source, identity. The text stays behind."""
        rows = docs.select(key, (scope if scope is not None else F.lit("default")).alias("scope"), self.column(F.col("text")).alias("_s"))
        return rows.select(key, "scope", F.explode("_s").alias("s")).select(key, "scope", "s.*")


def pseudonymize(docs: DataFrame, found: DataFrame, vault: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Redacted docs and the vault rows that are new. found: a written table of spans, read twice."""
    position = F.col(key).cast("decimal(20,0)") * 100000000 + F.col("start")
    new = tokens.number_tokens(found.withColumn("pos", position), vault)
    every = new if vault is None else vault.select(*new.columns).unionByName(new)
    named = found.withColumn("_key", F.coalesce("identity", "raw")).join(every.select("scope", "type", F.coalesce("identity", "raw").alias("_key"), "token"), ["scope", "type", "_key"])
    return tokens.rewrite(docs, named.select(key, "start", "end", "token"), key), new
