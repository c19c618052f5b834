"""Intermediate tables of a job: written once in the shared folder, read back, dropped when spent."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.session import delete, own, step_folder

#: While a step is written: its shuffle files go with it, and Python workers get small batches of rows.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{step_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    own(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step and read it back; lineage ends here and its shuffle files go at once.

    The table survives lost executors, so nothing before it is needed again.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), {name: spark.conf.get(name) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored steps that no later step reads."""
    for table in tables:
        delete(table.sparkSession, table.stored_at)


def crc_fold(doc_id: str, modulus: int) -> Column:
    """crc32 of a document's id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
