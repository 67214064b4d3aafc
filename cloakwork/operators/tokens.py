"""Token numbering, rewriting and restoring as relational algebra over spans and a vault table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_tokens(spans: DataFrame, vault: DataFrame | None = None, order: str = "last") -> DataFrame:
    """New vault rows (scope, token, type, raw, identity) for spans (scope, type, raw, identity, pos).

    One token per scope, type and identity (raw where there is none), numbered densely within scope and
    type: by last occurrence, the latest first, or with order="reading" by first occurrence. Identities in
    the vault keep their tokens; new ones count on from its largest number. Distinct identities are
    aggregated before numbering, so a repeated value costs one row.
    """
    key = F.coalesce("identity", "raw")
    last = F.max(F.struct("pos", "raw"))
    ids = spans.withColumn("_key", key).groupBy("scope", "type", "_key").agg(F.min("pos").alias("first"), last.alias("l"), F.first("identity", ignorenulls=True).alias("identity"))
    start = F.lit(0)
    if vault is not None:
        known = vault.select("scope", "type", F.coalesce("identity", "raw").alias("_key"))
        ids = ids.join(known, ["scope", "type", "_key"], "left_anti")
        used = vault.groupBy("scope", "type").agg(F.max(F.regexp_extract("token", "_([0-9]+)\\]$", 1).try_cast("int")).alias("_used"))
        ids = ids.join(used, ["scope", "type"], "left")
        start = F.coalesce("_used", F.lit(0))
    by = F.col("l.pos").desc() if order == "last" else F.col("first").asc()
    n = F.row_number().over(Window.partitionBy("scope", "type").orderBy(by, "_key")) + start
    number = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return ids.select("scope", F.concat(F.lit("["), "type", F.lit("_"), number, F.lit("]")).alias("token"), "type", F.col("l.raw").alias("raw"), "identity")


def rewrite(texts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """texts with spans (key, start, end, token) replaced. Spans must not overlap; order is settled within a document."""
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "end", "token")))
    per = spans.groupBy(key).agg(sorted_.alias("_s"))
    walk = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"].cast("int") - a["at"]), s["token"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))),
    )
    return texts.join(per, key, "left").withColumn("text", F.when(F.col("_s").isNull(), F.col("text")).otherwise(walk)).drop("_s")


def restore_exact(texts: DataFrame, vault: DataFrame, key: str = "doc_id") -> DataFrame:
    """Placeholders of a text replaced by their originals; unknown ones stay. vault: scope = key's scope column, token, raw."""
    pattern = r"\[[A-Z][A-Z_]*_[0-9]+\]"
    pieces, tokens = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    wanted = texts.select(key, "scope", F.explode(F.array_distinct(tokens)).alias("token"))
    known = wanted.join(vault.select("scope", "token", "raw"), ["scope", "token"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "raw"))).alias("_m"))
    found = F.transform(tokens, lambda t: F.coalesce(F.element_at("_m", t), t))
    joined = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), found.alias("t")), lambda x: F.array(x["p"], F.coalesce(x["t"], F.lit(""))))))
    return texts.join(known, key, "left").withColumn("text", F.when(F.col("_m").isNull(), F.col("text")).otherwise(joined)).drop("_m")


def use_forms(uses: DataFrame, cap: int = 64) -> DataFrame:
    """The first form seen after each cue of a token, for the first `cap` cues. uses: scope, token, pos, cue, form."""
    first = uses.filter(F.col("cue").isNotNull()).groupBy("scope", "token", "cue").agg(F.min_by("form", "pos").alias("form"), F.min("pos").alias("pos"))
    n = F.row_number().over(Window.partitionBy("scope", "token").orderBy("pos", "cue"))
    return first.withColumn("_n", n).filter(F.col("_n") <= cap).drop("_n")


def occurrences(uses: DataFrame, cap: int = 512) -> DataFrame:
    """nth occurrence of each token, from 1, for the first `cap`."""
    n = F.row_number().over(Window.partitionBy("scope", "token").orderBy("pos"))
    return uses.withColumn("nth", n).filter(F.col("nth") <= cap)


def originals(vault: DataFrame, uses: DataFrame) -> DataFrame:
    """Every spelling that must not leave: raw values and observed forms."""
    return vault.select("scope", F.col("raw").alias("spelling")).union(uses.select("scope", F.col("form").alias("spelling"))).distinct()


def fuzzy_match(candidates: DataFrame, vault: DataFrame) -> DataFrame:
    """Bent placeholders to vault tokens: equal number, type within one edit, only if no other type is as near.

    Joined on the number, so only tokens with that number are compared.
    """
    c = candidates.select("candidate", F.regexp_extract("key", "^(.*)_([0-9]+)$", 1).alias("ct"), F.regexp_extract("key", "^(.*)_([0-9]+)$", 2).alias("n"))
    v = vault.select("token", "raw", F.regexp_extract("token", r"\[(.*)_0*([0-9]+)\]", 1).alias("vt"), F.regexp_extract("token", r"\[(.*)_0*([0-9]+)\]", 2).alias("n"))
    near = c.join(v, "n").withColumn("d", F.levenshtein("ct", "vt", 1)).filter("d >= 0")
    ranked = near.withColumn("_best", F.min("d").over(Window.partitionBy("candidate"))).filter("d = _best").withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy("candidate"))).filter("_ties = 1")
    return ranked.select("candidate", "token", "raw", F.when(F.col("d") == 0, "loose").otherwise("fuzzy").alias("tier"))


def orphans(counted: DataFrame) -> DataFrame:
    """Unresolved placeholders per type, the commonest first."""
    return counted.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def receipts(texts: DataFrame) -> DataFrame:
    """What leaves, as counts and a digest of the redacted text, never the text: doc_id, entities, hash_post_redaction."""
    return texts.select("doc_id", F.regexp_count("text", F.lit(r"\[[A-Z][A-Z_]*(?:_[0-9]+)?\]")).cast("long").alias("entities"), F.sha2(F.col("text").cast("binary"), 256).alias("hash_post_redaction"))
