"""Corpus analytics over spans, chunks and annotations: declarative DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 1 where the whole is empty."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and f2 to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = lambda b: F.when((p * b + r) == 0, 0.0).otherwise((1 + b) * p * r / (p * b + r))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f(1).alias("f1"), f(4).alias("f2"))


def strict_counts(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn per `by`, of rows equal on keys; each side is made distinct first."""
    g, p = gold.select(*keys).distinct().withColumn("_g", F.lit(1)), found.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g_, p_ = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return both.groupBy(*by).agg(one(g_ & p_).alias("tp"), one(~g_ & p_).alias("fp"), one(g_ & ~p_).alias("fn"))


def overlaps(a: DataFrame, b: DataFrame, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """Interval join within a document: rows of a (start, end) and b (start2, end2) that intersect."""
    b = b.withColumnRenamed(key, "_key2")
    return a.join(b, (F.col(key) == F.col("_key2")) & (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")), how).drop("_key2")


def span_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per type of gold: spans, those met by a span of the same type, those met only by another type."""
    met = overlaps(gold, found.select("doc_id", F.col("type").alias("type2"), F.col("start").alias("start2"), F.col("end").alias("end2")), how="left")
    per = met.groupBy("doc_id", "type", "start", "end").agg(F.max(F.coalesce(F.col("type2") == F.col("type"), F.lit(False))).alias("same"), F.max(F.col("type2").isNotNull()).alias("any"))
    n = lambda c: F.sum(c.cast("long"))
    return per.groupBy("type").agg(F.count(F.lit(1)).alias("gold"), n(F.col("same")).alias("found"), n(F.col("any") & ~F.col("same")).alias("found_other"))


def unconfirmed(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Found spans that no gold span of the document intersects."""
    g = gold.select(F.col("doc_id"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    return overlaps(found, g, how="left_anti")


def in_context(spans: DataFrame, radius: int = 40) -> DataFrame:
    """Adds context: the text around each span, the span between double brackets. Needs text, start, end."""
    left = F.expr(f"substring(text, greatest(start - {radius}, 0) + 1, least(start, {radius}))")
    inside = F.expr("substring(text, start + 1, end - start)")
    right = F.expr(f"substring(text, end + 1, {radius})")
    return spans.withColumn("context", F.concat(left, F.lit("⟦"), inside, F.lit("⟧"), right))


def quasi_risk(rows: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """Rows and those whose combination of quasi-identifiers occurs fewer than k times."""
    sized = rows.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"))
    return sized.agg(F.sum("n").cast("long").alias("rows"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).cast("long").alias("at_risk"), F.count(F.lit(1)).alias("classes"))


def linkage_risk(rows: DataFrame, public: DataFrame, signature: list[str], public_id: str) -> DataFrame:
    """Rows and those whose signature belongs to exactly one public identity."""
    single = public.groupBy(*signature).agg(F.count_distinct(public_id).alias("n")).filter("n = 1").select(*signature, F.lit(1).alias("_one"))
    return rows.join(single, signature, "left").agg(F.count(F.lit(1)).alias("rows"), F.count("_one").alias("linked"))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows only in new (appeared) or only in old (vanished), as multisets."""
    appeared = new.select(*keys).exceptAll(old.select(*keys)).withColumn("change", F.lit("appeared"))
    return appeared.unionByName(old.select(*keys).exceptAll(new.select(*keys)).withColumn("change", F.lit("vanished")))


def multiset_agreement(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: values on either side, and how many pair up as multisets."""
    ca = a.groupBy(*key, value).agg(F.count(F.lit(1)).alias("na"))
    cb = b.groupBy(*key, value).agg(F.count(F.lit(1)).alias("nb"))
    both = ca.join(cb, [*key, value], "full").na.fill(0, ["na", "nb"])
    total = both.groupBy(*key).agg(F.sum("na").cast("long").alias("left"), F.sum("nb").cast("long").alias("right"), F.sum(F.least("na", "nb")).cast("long").alias("shared"))
    return total.withColumn("jaccard", F.col("shared") / F.greatest(F.col("left") + F.col("right") - F.col("shared"), F.lit(1)))


def per_group_sample(rows: DataFrame, group: str, ident: list[str], cap: int, seed: str) -> DataFrame:
    """At most `cap` rows of each group, in an order fixed by the seed (md5 of identity and seed)."""
    order = F.md5(F.concat_ws(":", *ident, F.lit(seed)).cast("binary"))
    numbered = rows.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_o", *ident)))
    return numbered.filter(F.col("_n") <= cap).drop("_o", "_n")


def stratified_weights(rows: DataFrame, likely: Column, ident: str, n: int, seed: str) -> DataFrame:
    """All likely rows with weight 1, and n of the others with weight (others / n), drawn by the seed."""
    marked = rows.withColumn("_likely", F.coalesce(likely, F.lit(False)))
    others = marked.filter(~F.col("_likely"))
    drawn = others.withColumn("_o", F.md5(F.concat_ws(":", ident, F.lit(seed)).cast("binary"))).orderBy("_o", ident).limit(n).drop("_o")
    count = others.agg(F.count(F.lit(1)).alias("_all"))
    drawn = drawn.crossJoin(F.broadcast(count)).withColumn("weight", F.col("_all") / F.least(F.lit(n), F.col("_all"))).drop("_all")
    return marked.filter("_likely").withColumn("weight", F.lit(1.0)).unionByName(drawn).withColumn("stratum", F.when(F.col("_likely"), "K").otherwise("O")).drop("_likely")


def consensus(readings: DataFrame, item: str, value: str, reader: str, k: int) -> DataFrame:
    """Values that at least k readers gave for an item."""
    return readings.groupBy(item, value).agg(F.count_distinct(reader).alias("votes")).filter(F.col("votes") >= k)


def curve(rows: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: accepted rows, the correct ones among them, precision and coverage. One pass, no join."""
    aggs = [F.count(F.lit(1)).alias("_all")]
    for i, t in enumerate(thresholds):
        ok = F.col(score) >= t
        aggs += [F.sum(ok.cast("long")).alias(f"_a{i}"), F.sum((ok & F.col(correct)).cast("long")).alias(f"_c{i}")]
    wide = rows.agg(*aggs)
    rows_ = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_a{i}").alias("accepted"), F.col(f"_c{i}").alias("correct")) for i, t in enumerate(thresholds)])).alias("r")
    out = wide.select("_all", rows_).select("r.*", "_all")
    return out.select("threshold", "accepted", "correct", ratio(F.col("correct"), F.col("accepted")).alias("precision"), ratio(F.col("accepted"), F.col("_all")).alias("coverage"))


def boilerplate(pages: DataFrame, page: str, values: str, at_least: int = 3) -> DataFrame:
    """Values of an array column that occur on `at_least` pages or more."""
    return pages.select(page, F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count_distinct(page).alias("pages")).filter(F.col("pages") >= at_least)


def classify(value: Column, reference: Column) -> Column:
    """How a reading relates to the values that were there: correct, form, fragment, distortion or invention."""
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return (
        F.when(F.array_contains(reference, value), "correct")
        .when(F.exists(reference, lambda r: bare(r) == bare(value)), "form")
        .when(F.exists(reference, lambda r: F.contains(r, value)), "fragment")
        .when(F.exists(reference, lambda r: F.levenshtein(r, value) <= F.greatest(F.lit(1), F.floor(F.length(r) / 3))), "distortion")
        .otherwise("invention")
    )


def chain_breaks(records: DataFrame, genesis: str) -> DataFrame:
    """First seq whose hash, or link to the record before it, is wrong. records: seq, prev_hash, payload, hash; chain: groups them."""
    before = F.lag("hash", 1).over(Window.partitionBy("chain").orderBy("seq"))
    bad = (F.col("prev_hash") != F.coalesce(before, F.lit(genesis))) | (F.col("hash") != F.sha2(F.concat_ws("|", "seq", "prev_hash", "payload").cast("binary"), 256))
    marked = records.withColumn("_bad", bad)
    return marked.groupBy("chain").agg(F.count(F.lit(1)).alias("records"), F.min(F.when(F.col("_bad"), F.col("seq"))).alias("broken_at"))


def top_forms(hits: DataFrame, form: str, context: str, n: int, contexts: int = 2) -> DataFrame:
    """The n commonest forms (lower-cased) with their count and a few contexts."""
    numbered = hits.withColumn("_form", F.lower(form))
    counted = numbered.groupBy("_form").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_form").limit(n)
    shown = numbered.join(counted, "_form").withColumn("_r", F.row_number().over(Window.partitionBy("_form").orderBy(context))).filter(F.col("_r") <= contexts)
    return shown.groupBy("_form").agg(F.max("n").alias("n"), F.concat_ws(" / ", F.array_sort(F.collect_list(context))).alias("contexts")).withColumnRenamed("_form", "form")


def balanced_parts(rows: DataFrame, ident: str, size: str, parts: int) -> DataFrame:
    """Longest-first assignment to parts in a snake over the sorted sizes; ranks come from ranges, not one task's list."""
    ordered = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(size), ident)) - 1)
    lap, seat = F.floor(F.col("_r") / parts), F.col("_r") % parts
    return ordered.withColumn("part", F.when(lap % 2 == 0, seat).otherwise(parts - 1 - seat).cast("int")).drop("_r")


def whole_documents(chunks: DataFrame, used: DataFrame, budget: int) -> DataFrame:
    """Unused documents, shortest first, whose chunks fit the budget together (in order of size, each that still fits)."""
    sizes = chunks.join(used.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.orderBy("n", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Ascending sizes: once one does not fit, no later one does, so the greedy choice is a prefix.
    return sizes.withColumn("total", total).filter(F.col("total") <= budget)


def gold_variants(templates: DataFrame, values: DataFrame) -> DataFrame:
    """A gold corpus: every template (vertical, row, text with {value}) with every value of its vertical, spans included."""
    both = templates.join(values, "vertical")
    start = F.instr("template", "{value}") - 1
    return both.select(
        F.concat_ws("-", "vertical", "row", "batch").alias("id"), "vertical", F.replace("template", F.lit("{value}"), F.col("value")).alias("text"), "type", start.alias("start"), (start + F.length("value")).alias("end"), "value"
    )


def net_recall(texts: DataFrame, masked: str, patterns: dict[str, str]) -> DataFrame:
    """Per type: matches of an independent net before and after masking, and the recall that this shows at least."""
    counts = [F.sum(F.regexp_count(c, F.lit(p))).cast("long").alias(f"{kind}_{c}") for kind, p in patterns.items() for c in ("text", masked)]
    wide = texts.agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_text").alias("before"), F.col(f"{k}_{masked}").alias("after")) for k in patterns])).alias("r")
    return wide.select(rows).select("r.*", ratio(F.col("r.before") - F.col("r.after"), F.col("r.before")).alias("recall"))
