"""Posting feed: repeated board snapshots into one catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fitweave.operators.merge import OUTDATED, PASTED
from fitweave.session import checkpointed
from fitweave.streaming.versions import last_version, merge_version

_KEY = ["source", "job_id"]


def _state(rows: DataFrame) -> DataFrame:
    """(source, job_id, newest, pasted): latest snapshot of each posting, and what its first pasted description keeps."""
    fields = [c for c in rows.columns if c not in _KEY]
    at = F.struct("fetched_at", "seq")
    own = F.struct(*[c for c in PASTED if c in fields], "fetched_at", "seq")
    pasted = F.min_by(own, F.when(F.col("description_source") == "pasted", at))
    return rows.groupBy(*_KEY).agg(F.max_by(F.struct(*fields), at).alias("newest"), pasted.alias("pasted"))


def _merged(states: DataFrame) -> DataFrame:
    def at(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(f"{column}.fetched_at", f"{column}.seq"))
    return states.groupBy(*_KEY).agg(F.max_by("newest", at("newest")).alias("newest"), F.min_by("pasted", at("pasted")).alias("pasted"))


def _shown(state: DataFrame) -> DataFrame:
    at = lambda c: F.struct(F.col(f"{c}.fetched_at"), F.col(f"{c}.seq"))
    later = F.col("pasted").isNotNull() & (at("newest") > at("pasted"))

    def value(name: str) -> Column:
        newest = F.col(f"newest.{name}")
        if name in PASTED:
            newest = F.when(later, F.col(f"pasted.{name}")).otherwise(newest)
        if name in OUTDATED:
            newest = F.when(~later, newest)
        return newest.alias(name)
    return state.select(*_KEY, *[value(f.name) for f in state.schema["newest"].dataType.fields])


def latest_versions(rows: DataFrame) -> DataFrame:
    """One row per (source, job_id): the latest snapshot; the first pasted description and its skills survive later snapshots (as in D7).

    ``rows`` (source, job_id, fetched_at, seq, description_source, ...). Partial aggregation keeps hot postings cheap.
    """
    return _shown(_state(rows))


def start_posting_feed(snapshots: DataFrame, table_dir: str, checkpoint: str, keep: DataFrame | None = None) -> StreamingQuery:
    """Merge each micro-batch into the catalogue; with ``keep`` (source, job_id) rows neither kept nor in the batch leave.

    A batch is reduced to one row per posting, then merged with the stored rows of the same
    buckets (of all, with ``keep``) by fetch time, so a text that returns to an earlier wording wins again,
    and a late snapshot of any age finds its place without a watermark.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        incoming = checkpointed(_state(batch))

        def merge(before: DataFrame | None) -> DataFrame:
            if before is None:
                return incoming
            if keep is not None:
                before = before.join(keep.select(*_KEY).unionByName(incoming.select(*_KEY)).distinct(), _KEY, "left_semi")
            return _merged(before.unionByName(incoming))

        merge_version(batch_id, table_dir, _KEY, incoming, merge, every=keep is not None)
    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalogue(spark: SparkSession, table_dir: str) -> DataFrame:
    return _shown(last_version(spark, table_dir))
