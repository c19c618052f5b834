"""State tables of streams: rows in buckets of their keys, of which a micro-batch writes only those that it touches.

``data/version=N/bucket=B`` holds the rows of bucket B as batch N left them, ``manifest/version=N`` the version of every bucket after batch N.
The manifest is written last, so a batch counts wholly or not at all; a replayed batch overwrites its own version and starts from the same
predecessor, so a restart neither loses nor doubles rows. Buckets that the batch before last replaced are deleted.
A manifest has a row for each bucket; with many keys choose more buckets, as a batch of n keys writes n of them at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.session import delete

BUCKETS = 256


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _manifest(spark: SparkSession, table_dir: str, version: int) -> dict[int, int]:
    if version < 0 or f"version={version}" not in _names(spark, f"{table_dir}/manifest"):
        return {}
    return {r.bucket: r.at for r in spark.read.parquet(f"{table_dir}/manifest/version={version}").collect()}  # a row for each bucket


def _rows(spark: SparkSession, table_dir: str, places: dict[int, int]) -> DataFrame | None:
    if not places:
        return None
    paths = [f"{table_dir}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.option("basePath", f"{table_dir}/data").parquet(*paths).drop("version", "bucket")


def merge_version(batch_id: int, table_dir: str, keys: list[str], incoming: DataFrame, merge: Callable[[DataFrame | None], DataFrame],
                  buckets: int = BUCKETS, every: bool = False) -> None:
    """Write version ``batch_id``: ``merge`` of the rows before it in the buckets of ``incoming`` (None if there are none).

    every: all buckets are merged, for rules that reach beyond the incoming keys.
    """
    spark = incoming.sparkSession
    before = _manifest(spark, table_dir, batch_id - 1)
    touched = {r.b for r in incoming.select(bucket_of(keys, buckets).alias("b")).distinct().collect()} | (set(before) if every else set())
    merged = merge(_rows(spark, table_dir, {b: v for b, v in before.items() if b in touched}))
    folder = f"{table_dir}/data/version={batch_id}"
    merged.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = {int(n.removeprefix("bucket=")): batch_id for n in _names(spark, folder) if n.startswith("bucket=")}
    after = {b: v for b, v in before.items() if b not in touched} | written
    spark.createDataFrame(sorted(after.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{table_dir}/manifest/version={batch_id}")
    for b, v in _manifest(spark, table_dir, batch_id - 2).items():
        if before.get(b) != v:
            delete(spark, f"{table_dir}/data/version={v}/bucket={b}")


def last_version(spark: SparkSession, table_dir: str) -> DataFrame:
    newest = max(int(n.removeprefix("version=")) for n in _names(spark, f"{table_dir}/manifest"))
    rows = _rows(spark, table_dir, _manifest(spark, table_dir, newest))
    if rows is None:
        raise ValueError(f"{table_dir} holds no rows yet.")
    return rows
