"""Canonical JSON, hash chains, checkpoints, nested responses, scan barrier, shell egress."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = hashlib.sha256(b"cloakwork audit chain").hexdigest()
MAX_DEPTH = 8


def canonicalize(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def build_record(entry, seq: int, prev_hash: str, ts: int) -> dict:
    body = {"seq": seq, "prevHash": prev_hash, "ts": ts, "entry": entry}
    return body | {"hash": hashlib.sha256(canonicalize(body).encode()).hexdigest()}


def verify_chain(records: list[dict]) -> tuple[bool, int | None]:
    before = GENESIS
    for i, r in enumerate(records):
        fresh = build_record(r["entry"], r["seq"], r["prevHash"], r["ts"])
        if r["seq"] != i or r["prevHash"] != before or fresh["hash"] != r["hash"]:
            return False, i
        before = r["hash"]
    return True, None


def build_chains(events: DataFrame) -> DataFrame:
    """events (chain, ts, entry) to records (chain, seq, prev_hash, ts, entry, hash), each chain in order of ts, entry.

    A chain is sequential by nature; chains are the unit of parallel work, and rows stream through one at a time.
    """
    schema = "chain string, seq bigint, prev_hash string, ts bigint, entry string, hash string"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, seq, before = None, 0, GENESIS
        for frame in frames:
            out = []
            for c, ts, entry in frame[["chain", "ts", "entry"]].itertuples(index=False):
                if c != chain:
                    chain, seq, before = c, 0, GENESIS
                r = build_record(entry, seq, before, int(ts))
                out.append((c, seq, before, int(ts), entry, r["hash"]))
                seq, before = seq + 1, r["hash"]
            yield pd.DataFrame(out, columns=["chain", "seq", "prev_hash", "ts", "entry", "hash"])

    return events.repartition("chain").sortWithinPartitions("chain", "ts", "entry").mapInPandas(fold, schema)


def ed25519_keys():
    """A fresh key pair of the JVM (driver only)."""
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()


def sign_checkpoint(checkpoint: dict, keys) -> bytes:
    from pyspark import SparkContext

    s = SparkContext._active_spark_context._jvm.java.security.Signature.getInstance("Ed25519")
    s.initSign(keys.getPrivate())
    s.update(canonicalize(checkpoint).encode())
    return bytes(s.sign())


def verify_checkpoint(checkpoint: dict, signature: bytes, keys) -> bool:
    from pyspark import SparkContext

    s = SparkContext._active_spark_context._jvm.java.security.Signature.getInstance("Ed25519")
    s.initVerify(keys.getPublic())
    s.update(canonicalize(checkpoint).encode())
    return bool(s.verify(signature))


def walk_strings(value, change: Callable[[str], tuple[str, int]], depth: int = 0):
    """A nested value with every string changed, and how many entities that took. Deeper than MAX_DEPTH is redacted whole."""
    if depth > MAX_DEPTH:
        return ("[TOO_DEEP]", 1) if isinstance(value, (str, list, dict)) else (value, 0)
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        parts = [walk_strings(v, change, depth + 1) for v in value]
        return [p for p, _ in parts], sum(n for _, n in parts)
    if isinstance(value, dict):
        parts = {k: walk_strings(v, change, depth + 1) for k, v in value.items()}
        return {k: p for k, (p, _) in parts.items()}, sum(n for _, n in parts.values())
    return value, 0


def is_scan(kind: Column, text: Column, content: Column) -> Column:
    """Images, and bytes without a text, hold what no text detector sees."""
    return F.coalesce(F.lower(kind).isin("image", "scan", "pdf-scan"), F.lit(False)) | (content.isNotNull() & (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0))


def split_scans(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads that may pass, payloads in quarantine)."""
    scan = is_scan(F.col("kind"), F.col("text"), F.col("bytes"))
    return payloads.filter(~scan), payloads.filter(scan)


def block_scans(payloads: DataFrame) -> DataFrame:
    """Fails the job at the first scan."""
    scan = is_scan(F.col("kind"), F.col("text"), F.col("bytes"))
    return payloads.filter(F.when(scan, F.raise_error(F.lit("a scan may not leave"))).otherwise(True).cast("boolean"))


# Commands that reach out.
EGRESS_VERBS = ("curl", "wget", "ssh", "scp", "rsync", "nc", "ncat", "telnet", "ftp", "sftp", "git", "http", "https")
_VERB = re.compile(r"(?:^|[;&|`(\s])(?:" + "|".join(EGRESS_VERBS) + r")\b")
_HOST = re.compile(r"(?:[a-z][a-z0-9+.-]*://(?:[^@\s/]*@)?|[A-Za-z0-9_.-]+@)([A-Za-z0-9.-]+)|(?<=\s)((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?=[\s:/]|$)")


def check_shell(command: str, allowed: list[str] | None, mode: str = "enforce") -> dict:
    """{blocked_host, allowed}: the first host of a command that the list (exact or by suffix) does not hold."""
    if mode == "off" or not allowed or not _VERB.search(command):
        return {"blocked_host": None, "allowed": True}
    for m in _HOST.finditer(command):
        host = (m.group(1) or m.group(2)).lower().rstrip(".")
        if not any(host == a or host.endswith("." + a) for a in allowed):
            return {"blocked_host": host, "allowed": mode == "shadow"}
    return {"blocked_host": None, "allowed": True}


def blocked_hosts(commands: DataFrame, allowed: list[str]) -> DataFrame:
    """The same over a column, in native expressions: command, blocked_host (first not allowed, else null)."""
    from cloakwork.functions.text import host_allowed

    reaches = F.col("command").rlike(r"(?:^|[;&|`(\s])(?:" + "|".join(EGRESS_VERBS) + r")\b")
    hosts = F.regexp_extract_all("command", F.lit(r"(?:[a-z][a-z0-9+.-]*://(?:[^@\s/]*@)?|[A-Za-z0-9_.-]+@)([A-Za-z0-9.-]+)"), F.lit(1))
    bad = F.filter(F.transform(hosts, F.lower), lambda h: ~host_allowed(h, allowed))
    return commands.select("command", F.when(reaches & (F.size(bad) > 0), F.element_at(bad, 1)).alias("blocked_host"))
