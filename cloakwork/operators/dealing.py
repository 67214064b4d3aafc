"""How many partitions a shuffle by a key gets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Own choice: rows that one task sorts or holds at a time, and rows worth a task of their own.
TASK_ROWS, LEAST_ROWS = 1 << 19, 1 << 14


def tasks_for(*frames: DataFrame) -> int:
    """Partitions for a shuffle of all rows of the frames together: in proportion to their number, so that a task's memory does not grow.

    Adaptive execution goes by compressed bytes instead, and packs millions of narrow rows into one task. The frames are counted, which reads them once more.
    """
    rows = reduce(DataFrame.unionAll, [f.select(F.lit(1).alias("x")) for f in frames]).count()
    return max(-(-rows // TASK_ROWS), min(-(-rows // LEAST_ROWS), frames[0].sparkSession.sparkContext.defaultParallelism), 1)
