"""Readers and writers: JSONL corpora, text folders, containers, vaults, receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.sources import containers

CORPUS = "doc_id string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS, strict: bool = False) -> DataFrame:
    """A JSONL corpus; broken lines are left out, or stop the job if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files, one document each."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return rows.withColumn("doc_id", F.regexp_extract("doc_id", "([^/]+?)(?:\\.[^./]+)?$", 1))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """DOCX, XLSX and PDF files with their text: path, kind, text, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pdf}").option("recursiveFileLookup", True).load(path)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), "content")
    readers = {"docx": containers.docx_text, "xlsx": containers.xlsx_text, "pdf": containers.pdf_text}

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, contents in batches:
            yield pd.Series([readers[k](bytes(c)) for k, c in zip(kinds, contents)])

    return files.withColumn("text", text_of("kind", "content"))


def write_vault(sealed: DataFrame, path: str) -> None:
    """Sealed rows by scope; rows of new tokens are appended (tokens are never changed once given)."""
    sealed.write.mode("append").partitionBy("scope").parquet(path)


def read_vault(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    rows = spark.read.schema("token string, type string, blob binary, scope string").parquet(path)
    return rows if scope is None else rows.filter(F.col("scope") == scope)


def append_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def write_corpus(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").json(path)
