"""Review events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fitweave.operators.schedule import review_day, review_state
from fitweave.streaming.versions import bucket_of, last_version, merge_version

_KEY = ["profile_id", "skill_id"]


def _last_per_day(events: DataFrame, zone: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "rating")).alias("last")
    return events.groupBy(*_KEY, review_day(F.col("ts"), zone).alias("day")).agg(last).select(*_KEY, "day", "last.*")


def start_review_stream(events: DataFrame, table_dir: str, checkpoint: str, zone: str = "UTC") -> StreamingQuery:
    """Fold each micro-batch onto the stored schedule state.

    The batch, reduced to the last rating per key and day, is kept under
    ``table_dir/days``, by buckets of keys; only touched buckets of state and days are read, and only those of the state are written again. Keys whose new days all come after their last review go on from
    the stored interval; a key with a late or repeated day is computed again from its
    own days. Other keys keep their row. Late events need no watermark.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        of_batch = f"{table_dir}/days/batch={batch_id}"
        days = _last_per_day(batch, zone).withColumn("bucket", bucket_of(_KEY))
        days.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(of_batch)
        new = spark.read.parquet(of_batch)
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        new = new.drop("bucket")

        def merge(before: DataFrame | None) -> DataFrame:
            if before is None:
                return review_state(new, zone=zone)
            touched = new.groupBy(*_KEY).agg(F.min("day").alias("first_day")).join(before.select(*_KEY, "last_reviewed"), _KEY, "left")
            again = touched.where(F.col("first_day") <= F.col("last_reviewed")).select(*_KEY)
            later = new.join(again, _KEY, "left_anti")
            days = spark.read.parquet(f"{table_dir}/days").where((F.col("batch") <= batch_id) & F.col("bucket").isin(buckets)).drop("batch", "bucket").join(again, _KEY, "left_semi")
            onward = review_state(later, before.select(*_KEY, "interval_days"), zone=zone)
            return before.join(touched.select(*_KEY), _KEY, "left_anti").unionByName(onward).unionByName(review_state(days, zone=zone))
        merge_version(batch_id, f"{table_dir}/states", _KEY, new, merge)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, table_dir: str) -> DataFrame:
    """The stored schedule state."""
    return last_version(spark, f"{table_dir}/states")
