"""Tasks stay of one size while tables grow, and results are those of the plain joins."""

import itertools

from pyspark.sql import functions as F

from cloakwork.operators import ocr, scoring
from cloakwork.operators.dealing import LEAST_ROWS, TASK_ROWS, tasks_for

SPANS = "doc_id bigint, type string, start int, end int"


def largest(frame):
    return frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_follow_rows(spark):
    assert tasks_for(spark.range(0)) == 1 and tasks_for(spark.range(LEAST_ROWS), spark.range(1)) == 2
    assert tasks_for(spark.range(9 * TASK_ROWS), spark.range(TASK_ROWS)) == 10


def test_observations_of_odd_spans(spark):
    ends = [None, 0, 1, 2, 5]
    gold = [(d, t, s, e) for d, t, s, e in itertools.product([1, 2, None], ["A", "B", None], ends, ends)]
    found = [(1, "A", 1, 2), (1, "A", 0, 0), (1, "A", None, 5), (1, "A", 0, None), (1, "B", 0, 1), (1, "B", 4, 3), (2, None, 0, 5), (None, "A", 0, 5), (3, "A", 0, 5)]
    want = {g: any(None not in g + f and g[:2] == f[:2] and g[2] < f[3] and f[2] < g[3] for f in found) for g in gold}
    got = scoring.observations(spark.createDataFrame(gold + gold[:40], SPANS), spark.createDataFrame(found + found, SPANS))
    assert got.dtypes == [("doc_id", "bigint"), ("type", "string"), ("start", "int"), ("end", "int"), ("found", "boolean")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {r[:4]: r[4] for r in rows} == want and any(want.values())


def test_observations_task_does_not_grow(spark):
    spans = spark.range(6 * TASK_ROWS).select(F.col("id").alias("doc_id"), F.lit("N").alias("type"), F.lit(0).alias("start"), F.lit(5).alias("end"))
    assert largest(scoring.observations(spans, spans.filter("doc_id % 2 = 0"))) < TASK_ROWS


def test_rulings_task_does_not_grow(spark):
    values = spark.range(6 * TASK_ROWS).select(F.col("id").alias("page"), F.lit(1).alias("id"), F.lit(0).alias("x0"), F.lit(9).alias("x1"), F.lit(100).alias("y1"))
    rulings = spark.range(6 * TASK_ROWS).select(F.col("id").alias("page"), F.lit(7).alias("rid"), F.lit(0).alias("rx0"), F.lit(9).alias("rx1"), F.lit(110).alias("ry"))
    near = ocr.attach_to_rulings(values, rulings)
    assert largest(near) < TASK_ROWS and near.agg(F.sum("rid")).first()[0] == 7 * 6 * TASK_ROWS
