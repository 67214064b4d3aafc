"""The public gate: outbound texts, tool responses, coordinates, and the assembly of all components."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators import audit, tokens
from cloakwork.operators.detect import detect
from cloakwork.operators.overlap import mask
from cloakwork.operators.registry import gate_types, read_types
from cloakwork.plans.deid import DeidPlan, pseudonymize
from cloakwork.plans.pipeline import PROFILES, Component, Registry, apply_profile


def deidentify_outbound(docs: DataFrame, profile: str = "standard", vault: DataFrame | None = None, pass_through: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, scope, text) to (redacted, new vault rows, receipts). A profile that hides nothing raises before any plan is built."""
    types = gate_types(profile, pass_through)
    if not types:
        return docs, docs.limit(0).select("scope"), tokens.receipts(docs)
    spans = DeidPlan(tuple(types), "gate").spans(docs, scope=F.col("scope")).persist(StorageLevel.DISK_ONLY)
    redacted, new = pseudonymize(docs, spans, vault)
    return redacted, new, tokens.receipts(redacted)


def deidentify_responses(rows: DataFrame, types: list[str], column: str = "response") -> DataFrame:
    """Nested JSON responses with every string masked, and how many entities that took. What is no JSON is masked as text."""
    wanted = frozenset(types)

    def change(s: str) -> tuple[str, int]:
        found = detect(s, wanted)
        return mask(s, found), len(found)

    @F.pandas_udf("struct<value:string,entities:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch:
                if raw is None:
                    out.append((None, 0))
                    continue
                try:
                    value, n = audit.walk_strings(json.loads(raw), change)
                    out.append((json.dumps(value, ensure_ascii=False), n))
                except ValueError:
                    out.append(change(raw))
            yield pd.DataFrame(out, columns=["value", "entities"])

    return rows.withColumn("_r", run(column)).select("*", F.col("_r.value").alias("redacted"), F.col("_r.entities").alias("entities")).drop("_r")


def mask_coordinates(docs: DataFrame, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, scope, text) with coordinates as [GEO_NN], and the new vault rows."""
    spans = DeidPlan(("COORD",), "gate").spans(docs, scope=F.col("scope")).withColumn("type", F.lit("GEO")).persist(StorageLevel.DISK_ONLY)
    return pseudonymize(docs, spans, vault)


class Gate:
    """Components assembled in order, with the vault rows that their passes add."""

    def __init__(self, profile: str):
        self.registry, self.vault = Registry(), None
        for name in ("keys", "envelope", "audit"):
            self.registry.add(Component(name))
        self.registry.add(Component("geo-mask", egress=lambda d: self._take(*mask_coordinates(d, self.vault))))
        self.registry.add(Component("text-deid", depends=("audit",), egress=self._hide, response=lambda d: tokens.restore_exact(d, self.vault) if self.vault is not None else d))
        self.registry.add(Component("scan-redact", egress=lambda d: audit.block_scans(d) if {"kind", "bytes"} <= set(d.columns) else d))
        self.skipped = apply_profile(self.registry, PROFILES[profile])

    def _take(self, redacted: DataFrame, new: DataFrame) -> DataFrame:
        self.vault = new if self.vault is None else self.vault.unionByName(new)
        return redacted

    def _hide(self, docs: DataFrame) -> DataFrame:
        types = read_types(self.registry.get("text-deid").config)
        spans = DeidPlan(tuple(types), "component").spans(docs, scope=F.col("scope")).persist(StorageLevel.DISK_ONLY)
        return self._take(*pseudonymize(docs, spans, self.vault))
