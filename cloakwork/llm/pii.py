r"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them come from regexp_extract_all
and split with the same pattern; cumulative lengths give positions, in code points. Patterns are written
so that matching is linear: runs are possessive, and a match may start only where a run starts or where
the last match ended, which leaves the leftmost matches as they are.

Base kinds (fixed definitions): email, ip, card, phone. Added kinds, kept if their score reaches KEEP:
iban (mod 97), secret (a key word, = or :, a quoted or bare value), national_id (3-2-4 digits) and
local_phone (3-3-4 digits); context words within NEAR code points before a span raise its score. Added spans that overlap a fixed one go.

Cases: null text is empty; a text without matches has zero counts and empty lists of spans; repeated rows
give repeated results; an empty table gives no rows; clashing columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
KEEP = 0.6
#: The first BASE kinds have fixed definitions.
BASE = 4
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "national_id", "local_phone")

#: kind -> (cheap test that a match is possible, pattern)
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z][0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "secret": (r"(?i)token|secret|passw|api", r"(?i)(?<![a-z0-9])(?:access[_-]?token|token|client[_-]?secret|secret[_-]?key|secret|password|passwd|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'|[A-Za-z0-9_/+=.-]{16,}+)"),
    "national_id": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (r"[0-9]{3}[-.\x20][0-9]{4}", r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[-.\x20]{1,2}[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])"),
}
#: kind -> (score of a confirmed match, context words, what they add)
SCORES = {
    "email": (1.0, None, 0.0),
    "ip": (0.9, r"(?i)\b(?:ip|host|server|address)\b", 0.1),
    "card": (0.9, r"(?i)\b(?:card|visa|mastercard|amex|credit|pay)", 0.1),
    "phone": (0.9, r"(?i)\b(?:phone|tel|call|mobile|fax)", 0.1),
    "iban": (0.9, r"(?i)\b(?:iban|account|bank)", 0.1),
    "secret": (0.9, None, 0.0),
    "national_id": (0.5, r"(?i)\b(?:ssn|social security|national id|tax id)", 0.4),
    "local_phone": (0.5, r"(?i)\b(?:phone|tel|call|mobile|fax)", 0.3),
}


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(raw: Column) -> Column:
    compact = F.regexp_replace(raw, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _confirmed(kind: str, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(raw, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & F.coalesce(_luhn(F.when(n <= 19, digits)), F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(raw)
    if kind == "national_id":
        return ~raw.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _proposed(kind: str) -> Column:
    """Array of (start, end, raw) of a kind's matches in _x."""
    hint, pattern = PATTERNS[kind]
    matches, between = F.regexp_extract_all("_x", F.lit(pattern), F.lit(0)), F.split("_x", pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(between.alias("b"), matches.alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["b"]) + F.coalesce(F.char_length(p["m"]), F.lit(0))).alias("at"),
            F.when(p["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.char_length(p["b"])).alias("start"), (a["at"] + F.char_length(p["b"]) + F.char_length(p["m"])).alias("end"), p["m"].alias("raw"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.col("_x").rlike(hint), walk)


def _scored(number: int, kind: str) -> Column:
    """Confirmed spans of a kind with their scores; those of added kinds only if the score suffices."""
    base, words, more = SCORES[kind]

    def span(s: Column) -> Column:
        before = F.substring(F.col("_x"), F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        score = F.lit(base) + F.when(before.rlike(words), more).otherwise(0.0) if words else F.lit(base)
        named = (s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["raw"].alias("raw"))
        return F.struct(*named, score.alias("score"))

    spans = F.transform(F.filter(f"_{kind}", lambda s: _confirmed(kind, s["raw"])), span)
    if number >= BASE:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP)
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,raw:string,score:double>>"))


def find(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns (doc_id unless named), and spans: array of (start, kind_no, end, kind, raw, score), by start then kind."""
    carried = carried or ("doc_id",)
    rows = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_x"))
    rows = rows.select(*carried, "_x", *[_proposed(k).alias(f"_{k}") for k in KINDS])
    found = [_scored(number, kind) for number, kind in enumerate(KINDS)]
    rows = rows.select(*carried, F.concat(*found[:BASE]).alias("_base"), F.concat(*found[BASE:]).alias("_added"))
    apart = F.filter("_added", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select(*carried, F.array_sort(F.concat("_base", apart)).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, SHA-256 of the list of base spans, and the list of all spans."""
    rows = find(docs)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    return rows.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by [KIND]; overlapping spans become one, named after the first."""
    key = [c for c in docs.columns if c != "text"]
    rows = find(docs, *docs.columns)
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.greatest(F.char_length("text") - a["at"], F.lit(0)))),
    )
    return rows.select(*key, F.when(F.size("spans") > 0, walk).otherwise(F.col("text")).alias("text")).select(*docs.columns)
