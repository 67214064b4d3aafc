"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (md5 of doc_id), gone through up to
`repeats` times. A document's virtual finish time is the source's cumulative size up to its end, divided
by the source's target. The mix is all documents in order of finish time, range-sorted over the cluster,
truncated where the total budget is spent: at time 1, where each queue has given its target. The document
on that border is cut.

Cumulative sums are two-level (a source's hash buckets, then documents within a bucket), so a hot source
spreads over tasks, and the number of buckets changes nothing in the result.

Cases: null texts have size 0 and are not taken; the null source is a source, ordered last; repeated rows
are separate documents whose order among themselves does not matter; an empty table gives no rows; other
columns pass through `mix` and are left out by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.scratch import body, rest, restored, stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("_key"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("_text_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source: source_size and target. A level L is sought with sum(min(L * weight, cap)) = budget.

    With sources in order of cap / weight, the first k whose level lies below the next ratio gives L. This
    is the result of resharing the excess by weight until no target is above its cap. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rows = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("double"))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
    rank = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    earlier = F.coalesce(F.sum("_cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("_w").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (budget - earlier) / weight_left).withColumn("_budget", budget)
    rows = rows.withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(everything))
    level = F.coalesce(F.col("_found.level"), F.lit(float("inf")))
    return rows.select("source", "source_size", F.least(level * F.col("_w"), F.col("_cap")).alias("target"))


def queued(sizes: DataFrame, goals: DataFrame, buckets: int = 4096) -> DataFrame:
    """Adds source_size, target and `_before`: the source's cumulative size ahead of a document."""
    digits = 3 if buckets == 4096 else 2
    cut = sizes.withColumn("_bucket", F.substring("_key", 1, digits))
    per = cut.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).drop("_sum")
    goals, per = goals.withColumnRenamed("source", "_s"), per.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    offsets = per.join(goals.withColumnRenamed("_s", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    inner = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "_text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return rows.withColumn("_before", F.col("_ahead") + F.col("_within")).drop("_s", "_b", "_bucket", "_ahead", "_within")


def _taken(repeats: int):
    room = F.floor(F.col("target"))
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), room - F.col("source_size") * e - F.col("_before"))) for e in range(repeats)]
    return parts


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and first_finish: finish time of the first time round."""
    sizes = stash(sized(docs), "sizes")
    rows = queued(sizes, targets(sizes, weights, share, repeats))
    taken = sum(_taken(repeats)[1:], _taken(repeats)[0])
    finish = F.when(F.col("target") > 0, (F.col("_before") + F.col("size")) / F.col("target"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("first_finish"), "source", "_key", "_text_key")


def _row_key(doc_id, source, text_key) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in (doc_id, source, text_key)]).cast("binary")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: the columns of docs, a row each time a document is taken, in order of finish time.

    A document cut at the border keeps its first words and, where there is a column n_chars, its new length.
    Rows with equal doc_id, source and text follow each other in their queue; which of them comes first is
    decided by their other columns.
    """
    rows = plan(docs, weights, share, repeats)
    turns = F.struct("first_finish", "taken", F.col("size").alias("size"), "source_size", "target")
    # One plan row for each set of equal rows, with what each of them gives, so that texts are dealt by one key, once.
    chosen = rows.withColumn("_k", _row_key(F.col("doc_id"), F.col("source"), F.col("_text_key"))).groupBy("_k").agg(F.array_sort(F.collect_list(turns)).alias("_turns")).filter(F.exists("_turns", lambda x: x["taken"] > 0))
    text_key = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    keyed = docs.select(rest(docs), body(docs), F.col("doc_id").cast("long").alias("_id"), _row_key(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_key).alias("_key"))
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.to_json("_rest"))))
    joined = keyed.join(chosen, F.col("_key") == F.col("_k")).withColumn("_turn", F.element_at("_turns", F.col("_nth"))).filter("_turn.taken > 0")
    joined = joined.select("_rest", "_text", "_id", "_nth", "_turn.*")
    each = joined.withColumn("_round", F.explode(F.expr("sequence(0, int(ceil(taken / size)) - 1)")))
    finish = F.col("first_finish") + F.col("_round") * F.col("source_size") / F.col("target")
    each = each.withColumn("_words", F.least(F.col("size"), F.col("taken") - F.col("_round") * F.col("size"))).withColumn("_cut", F.col("_words") < F.col("size"))
    each = each.withColumn("_finish", finish).orderBy("_finish", "_id", "_nth", "_round")
    head = F.expr(r"regexp_extract(_text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', cast(_words as string), '}+'), 0)")
    text = F.when(F.col("_cut"), head).otherwise(F.col("_text"))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_cut"), F.char_length(text).cast("long")).otherwise(F.col("_rest.n_chars"))
    return each.select(*restored(docs, text, **changed))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS key, coalesce(md5(text), '') AS text_key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
levels AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
found AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
goals AS (SELECT source, source_size, least(coalesce((SELECT level FROM found), 'inf'::DOUBLE) * w, cap) AS target FROM named),
queued AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)))::BIGINT AS taken
FROM queued
"""
