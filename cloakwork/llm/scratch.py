"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; only where it is unset (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own.setdefault("dir", "") or "file://" + tempfile.mkdtemp(prefix="cloakwork-")
        _own["dir"] = found
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts lineage and survives executors.

    The files stay until `discard` or until the folder is cleared; the caller's result may still read them.
    """
    return stash_all([df], name)


def stash_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Writes tables of one schema one after another as one table, as `stash` does. Shuffle files of one go before the next is written."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        before = spark.conf.get(_CLEANUP, None)
        # What the write has shuffled is not read again: its files go when it ends, not when the driver collects its garbage.
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes stashed tables that nothing reads any more, and has the driver look for shuffles that nothing refers to.

    Spark deletes the files of a shuffle once its objects on the driver are collected, which may be long after.
    """
    spark = None
    for df in tables:
        path = getattr(df, "_stash", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rest(docs: DataFrame) -> Column:
    """A row's columns but its text as one struct, so that helper columns cannot clash with them."""
    return F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")


def body(docs: DataFrame) -> Column:
    return F.col("text").cast("string").alias("_text")


def restored(docs: DataFrame, text: Column | None = None, **changed: Column) -> list[Column]:
    """The own columns again from `rest` and `body`, some of them changed."""
    text = F.col("_text") if text is None else text
    return [(text if c == "text" else changed[c] if c in changed else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns]
