r"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per text: words are runs of other than space and \t \n \v \f \r. Fixed base rules (too few words, too
many words in repeated 8-word windows) are one half of the verdict. The other half adapts: for each
language and source, a mergeable quantile sketch (percentile_approx) of every measure gives median and
upper (or lower) quartile; a text fails a measure that lies further from the median than `reach` times
that spread plus a slack, which keeps a group whose spread is zero from failing on its first variation.

The measures are written once as a narrow table; thresholds are joined to it, not to the texts.

Cases: null or empty text has no words and fails the base rule; null lang and source are groups of their
own; repeated rows give repeated results; an empty table gives no rows; clashing columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.scratch import body, rest, restored, stash

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
REACH = 6.0
#: measure -> (side that fails, slack)
MEASURES = {
    "symbol_ratio": ("above", 0.10),
    "caps_ratio": ("above", 0.35),
    "dup_line_ratio": ("above", 0.30),
    "repeat_ratio": ("above", 0.30),
    "word_length": ("above", 3.0),
    "word_length_low": ("below", 1.5),
}
ACCURACY = 1000


def measured(docs: DataFrame, *carried: str) -> DataFrame:
    """Base counts and measures of each text, beside the carried columns."""
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    rows = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_x"))
    rows = rows.select(*carried, "_x", F.filter(F.split("_x", space, -1), lambda w: w != "").alias("_w"), F.filter(F.split("_x", "\n", -1), lambda x: x.rlike(word)).alias("_l"))
    n = F.size("_w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.struct(F.xxhash64(F.slice(F.col("_w"), i, WINDOW)).alias("h"), i.alias("i"))))
    rows = rows.select(
        *carried,
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_x", space, "")).cast("long").alias("word_chars"),
        F.regexp_count("_x", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_x", F.lit(r"\p{Lu}")).cast("long").alias("_caps"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").alias("_lines"),
        F.array_sort(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))).alias("_s"),
    )
    tail = F.slice(F.col("_s"), 2, F.greatest(F.size("_s"), F.lit(1)))
    same = F.zip_with("_s", tail, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    rows = rows.withColumn("_same", F.when(F.size("_s") > 1, same))
    flagged = F.zip_with("_s", F.arrays_zip(F.col("_same").alias("a"), F.concat(F.array(F.lit(False)), F.col("_same")).alias("b")), lambda s, f: F.when(F.coalesce(f["a"], F.lit(False)) | F.coalesce(f["b"], F.lit(False)), s["i"]))
    hits = F.when(F.exists("_same", lambda x: x), F.array_sort(F.filter(flagged, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.col("_hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    rows = rows.withColumn("_hits", hits).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    count = F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / count).alias("symbol_ratio"),
        (F.col("_caps") / F.greatest(F.col("word_chars"), F.lit(1))).alias("caps_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / count).alias("repeat_ratio"),
        (F.col("word_chars") / count).alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)).alias("base_failed"),
    )


def thresholds(rows: DataFrame, reach: float = REACH) -> DataFrame:
    """Per language and source: a fence for each measure, from texts that pass the base rules."""
    sketches = []
    for name, (side, _) in MEASURES.items():
        column = F.when(~F.col("base_failed"), F.col(name.removesuffix("_low")))
        sketches.append(F.percentile_approx(column, F.array(F.lit(0.5), F.lit(0.75 if side == "above" else 0.25)), ACCURACY).alias(f"_q_{name}"))
    found = rows.groupBy("lang", "source").agg(*sketches)
    fences = []
    for name, (side, slack) in MEASURES.items():
        mid, far = F.col(f"_q_{name}")[0], F.col(f"_q_{name}")[1]
        fence = mid + reach * (far - mid) + slack if side == "above" else mid + reach * (far - mid) - slack
        fences.append(fence.alias(f"fence_{name}"))
    return found.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *fences)


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = F.col("base_failed")
    for name, (side, _) in MEASURES.items():
        value, fence = F.col(name.removesuffix("_low")), F.col(f"fence_{name}")
        failed = failed | F.coalesce(value > fence if side == "above" else value < fence, F.lit(False))
    return joined.withColumn("kept", ~failed).drop("_lang", "_source")


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, base counts, measures, fences and the verdict `kept`."""
    rows = stash(measured(docs, "doc_id", "lang", "source"), "measures")
    return judged(rows, thresholds(rows))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns. Equal rows share one verdict."""
    key = [F.xxhash64(F.lit(salt), "doc_id", "text", "lang", "source").alias(name) for salt, name in ((1, "_k1"), (2, "_k2"))]
    rows = stash(measured(docs.select("text", "lang", "source", *key), "_k1", "_k2", "lang", "source"), "measures")
    rejected = judged(rows, thresholds(rows)).filter(~F.col("kept")).select("_k1", "_k2").distinct()
    return docs.select(rest(docs), body(docs), *key).join(rejected, ["_k1", "_k2"], "left_anti").select(*restored(docs))
