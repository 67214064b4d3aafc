"""Table-shaped operators of reading evaluation: votes, field grammars, labels, layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.operators.dealing import tasks_for

#: Own choice: fields, their shape and range.
FIELDS = {"depth": (r"^[0-9]{1,4}([.,][0-9]{1,2})?$", 0.0, 5000.0), "percent": (r"^[0-9]{1,3}([.,][0-9]{1,2})?$", 0.0, 100.0), "year": (r"^[0-9]{4}$", 1900.0, 2100.0), "count": (r"^[0-9]{1,4}$", 0.0, 9999.0)}
#: Letters that recognisers read for digits, and those digits.
CONFUSED = ("OОoоlI|ЗзБбS", "000011133665")


def number_of(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def check_field(name: Column, value: Column, seen: Column | None = None) -> Column:
    """ok, format, range, rare (not among the values seen for the field) or unknown."""
    out = F.lit("unknown")
    for field, (shape, low, high) in FIELDS.items():
        rare = ~F.array_contains(seen, value) if seen is not None else F.lit(False)
        verdict = F.when(~value.rlike(shape), "format").when(~number_of(value).between(low, high), "range").when(F.coalesce(rare, F.lit(False)), "rare").otherwise("ok")
        out = F.when(name == field, verdict).otherwise(out)
    return out


def observed_sets(rows: DataFrame, at_least: int = 2) -> DataFrame:
    """Per field, the values read `at_least` times."""
    counted = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return counted.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("seen"))


def check_documents(rows: DataFrame) -> DataFrame:
    """Per page, fields side by side, and whether they agree: top above bottom, parts within the whole."""
    wide = rows.groupBy("page").pivot("field", ["top", "bottom", "part", "whole"]).agg(F.max("value"))
    ok = F.coalesce(number_of(F.col("top")) <= number_of(F.col("bottom")), F.lit(True)) & F.coalesce(number_of(F.col("part")) <= number_of(F.col("whole")), F.lit(True))
    return wide.withColumn("consistent", ok)


def name_fields(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values (id, head, tail) named by the first rule (prio, field, tail_like, head_not) whose pattern the tail holds and whose other pattern the head does not. The rule table is a constant of the code."""
    hit = values.join(F.broadcast(rules), F.expr("rlike(tail, tail_like) AND (head_not IS NULL OR NOT rlike(head, head_not))"), "left")
    return hit.groupBy("id").agg(F.min_by("field", "prio").alias("field"))


def fix_unit(value: Column) -> Column:
    return F.regexp_replace(value, r"[  ]*(?:м|мм|см|км|т|кг|%|шт)\.?$", "")


def fix_confused(value: Column) -> Column:
    return F.translate(value, *CONFUSED)


def fix_separator(value: Column, field: Column) -> Column:
    """A missing decimal point, only in depths read as exactly two digits."""
    return F.when((field == "depth") & value.rlike("^[0-9]{2}$"), F.concat(F.substring(value, 1, 1), F.lit("."), F.substring(value, 2, 1))).otherwise(value)


def why_silent(text: Column, width: Column, height: Column, ruled: Column) -> Column:
    """Why a crop gave no value."""
    return (
        F.when(ruled & (height < 6), "ruling").when((width > 6 * height) & ~text.rlike("[0-9]"), "signature").when(~F.coalesce(text, F.lit("")).rlike("[0-9]"), "no digit").otherwise("other")
    )


def group_boxes(boxes: DataFrame, gap: int = 55, overlap: float = 0.5) -> DataFrame:
    """Boxes (page, id, x0, y0, x1, y1) grouped to values: rows overlap and gaps stay small, to a fixed point, page by page."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["x0", "y0", "id"])
        rows = page[["x0", "y0", "x1", "y1"]].to_numpy()
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if rows[j][0] - max(rows[i][2], rows[i][0]) > gap and rows[j][0] - rows[: i + 1, 2].max() > gap:
                    break
                height = min(rows[i][3] - rows[i][1], rows[j][3] - rows[j][1])
                shared = min(rows[i][3], rows[j][3]) - max(rows[i][1], rows[j][1])
                if rows[j][0] - rows[i][2] <= gap and height > 0 and shared >= overlap * height:
                    root[find(j)] = find(i)
        page["value_id"] = [int(page["id"].iloc[find(i)]) for i in range(len(rows))]
        return page[["page", "id", "value_id"]]

    return boxes.groupBy("page").applyInPandas(one, "page bigint, id bigint, value_id bigint")


def attach_to_rulings(values: DataFrame, rulings: DataFrame, above: int = 60) -> DataFrame:
    """Values (page, id, x0, x1, y1) to the nearest ruling (page, rid, rx0, rx1, ry) below that they overlap; null if none."""
    n = tasks_for(values, rulings)
    values, r = values.repartition(n, "page"), rulings.withColumnRenamed("page", "_p").repartition(n, "_p")
    near = values.join(r, (F.col("page") == F.col("_p")) & (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("ry") - F.col("y1")).between(-5, above), "left")
    return near.groupBy("page", "id").agg(F.min_by("rid", F.abs(F.col("ry") - F.col("y1"))).alias("rid"))


def printed_lines(words: DataFrame) -> DataFrame:
    """Words of an OCR TSV (page, block, par, line, left, top, width, height, text) as lines."""
    return words.groupBy("page", "block", "par", "line").agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda s: s["text"])).alias("text"),
    )


#: Own choice: page types and their key words with weights.
PAGE_TYPES = {"journal": {"глубина": 2, "интервал": 2, "скважина": 1}, "table": {"итого": 2, "таблица": 2}, "title": {"отчёт": 2, "утверждаю": 2}}


def page_type(text: Column, types: dict[str, dict[str, int]] | None = None) -> Column:
    """The type whose key words weigh most; the earlier of equals; none if no word occurs."""
    types = types or PAGE_TYPES
    scores = [sum((F.regexp_count(F.lower(text), F.lit(w)) * k for w, k in words.items()), F.lit(0)) for words in types.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit("none")
    for name, score in reversed(list(zip(types, scores))):
        out = F.when(score == best, name).otherwise(out)
    return F.when(best > 0, out).otherwise("none")


def top_pages(pages: DataFrame, doc: str, share: str, n: int) -> DataFrame:
    """The n pages of each document with most ink."""
    w = Window.partitionBy(doc).orderBy(F.desc(share), "page")
    return pages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def split_by_document(rows: DataFrame, doc: str, held_out: float, seed: str) -> DataFrame:
    """Train or test by document, so no document lies in both."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", doc, F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(h < held_out, "test").otherwise("train"))


def separator_share(rows: DataFrame, before: str, after: str) -> DataFrame:
    """How many values hold a decimal separator, before and after a repair."""
    has = lambda c: F.avg(F.col(c).rlike(r"[0-9][.,][0-9]").cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("n"), has(before).alias("before"), has(after).alias("after"))


def confusion(rows: DataFrame, truth: str, verdict: str, labels: list[str]) -> DataFrame:
    return rows.groupBy(truth).pivot(verdict, labels).agg(F.count(F.lit(1))).na.fill(0)


def transcripts(raw: Column) -> Column:
    """Values of "text" keys in JSON that may be broken."""
    return F.transform(F.regexp_extract_all(raw, F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))


def harvest(first: DataFrame, second: DataFrame, ink: float, conf: float) -> DataFrame:
    """Labels for training: enough ink and confidence, a valid field, and a second reader that agrees on the box."""
    other = second.select("page", "box", F.col("text").alias("_t"))
    good = first.filter((F.col("ink") >= ink) & (F.col("conf_min") >= conf) & (check_field(F.col("field"), F.col("text")) == "ok"))
    return good.join(other, ["page", "box"]).filter(F.col("text") == F.col("_t")).drop("_t")


def crop_agreement(readings: DataFrame, third: DataFrame, readers: int = 2) -> DataFrame:
    """Values that readers agree on for a (page, box), and whether a page-level reading holds them as a third vote."""
    agreed = readings.groupBy("page", "box", "text").agg(F.count_distinct("reader").alias("votes")).filter(F.col("votes") >= readers)
    pages = third.select("page", F.col("text").alias("_page_text"))
    return agreed.join(pages, "page", "left").withColumn("third", F.coalesce(F.contains("_page_text", "text"), F.lit(False))).drop("_page_text")


def infix_distance(pairs: DataFrame) -> DataFrame:
    """pairs (ref, hyp) with the edit distance of ref to the nearest part of hyp (prefix and suffix of hyp are free)."""

    def distance(ref: str, hyp: str) -> int:
        row = [0] * (len(hyp) + 1)
        for i, c in enumerate(ref, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(hyp, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for refs, hyps in batches:
            yield pd.Series([distance(r or "", h or "") for r, h in zip(refs, hyps)])

    d = run("ref", "hyp")
    return pairs.withColumn("distance", d).withColumn("cer", F.col("distance") / F.greatest(F.length("ref"), F.lit(1)))
