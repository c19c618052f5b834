"""Review schedule, due queue and staleness in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.functions.constants import REVIEW_AGAIN_DAYS, REVIEW_EFFORT_DAYS, REVIEW_FIRST_DAYS, REVIEW_MAX_DAYS
from fitweave.operators.evidence import fingerprint


def interval_after(rating: Column, baseline: Column) -> Column:
    """Days until the next review."""
    return F.when(rating == "again", REVIEW_AGAIN_DAYS).when(rating == "effort", REVIEW_EFFORT_DAYS).otherwise(
        F.least(F.lit(REVIEW_MAX_DAYS), F.greatest(F.lit(REVIEW_FIRST_DAYS), baseline * 2)))


def review_day(ts: Column, zone: str) -> Column:
    """Calendar day of a moment in ``zone``, whatever the session's zone."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone))


def review_days(events: DataFrame, start: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Events (profile_id, skill_id, ts, event_id, rating) -> state after each review day.

    A repeat on one day reuses that day's baseline, so only the last rating of a
    day counts: days are reduced first, combined before the shuffle. "again" and
    "effort" restart the interval; n independent days later it is
    min(30, max(7 * 2^(n-1), start * 2^n)), so no fold over events is needed.
    """
    key = ["profile_id", "skill_id"]
    days = events.groupBy(*key, review_day(F.col("ts"), zone).alias("day")).agg(F.max_by("rating", F.struct("ts", "event_id")).alias("recall"))
    days = days.join(start.select(*key, F.col("interval_days").alias("start_days")), key, "left") if start is not None \
        else days.withColumn("start_days", F.lit(0))
    history = Window.partitionBy(*key).orderBy("day")
    until = history.rowsBetween(Window.unboundedPreceding, 0)
    restart = F.when(F.col("recall").isin("again", "effort"), 1).otherwise(0)
    days = days.withColumn("run", F.sum(restart).over(until))
    step = F.sum(1 - restart).over(Window.partitionBy(*key, "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("n", F.least(step, F.lit(10)))
    begin = F.when(F.col("run") == 0, F.coalesce("start_days", F.lit(0))).otherwise(0)
    grown = F.least(F.lit(REVIEW_MAX_DAYS), F.greatest(
        (F.lit(REVIEW_FIRST_DAYS) * F.pow(F.lit(2), F.col("n") - 1)).cast("int"), (begin * F.pow(F.lit(2), F.col("n"))).cast("int")))
    interval = F.when(F.col("recall") == "again", REVIEW_AGAIN_DAYS).when(
        F.col("recall") == "effort", REVIEW_EFFORT_DAYS).otherwise(grown).cast("int")
    days = days.withColumn("interval_days", interval)
    before = F.lag("interval_days").over(history)
    return days.select(*key, "day", "recall", "interval_days",
                       F.coalesce(before, "start_days", F.lit(0)).cast("int").alias("interval_before"),
                       F.date_add("day", F.col("interval_days")).alias("review_on"))


def review_state(events: DataFrame, start: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Latest state per (profile_id, skill_id)."""
    days = review_days(events, start, zone)
    return days.groupBy("profile_id", "skill_id").agg(
        F.max_by(F.struct("interval_days", "interval_before", F.col("day").alias("last_reviewed"), "review_on", "recall"), "day").alias("s")
    ).select("profile_id", "skill_id", "s.*")


def due_items(applications: DataFrame, lessons: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Follow-ups and reviews due on ``as_of``; closed applications are left out.

    applications (profile_id, job_id, title, company, status, followup),
    lessons (profile_id, job_id, skill_id, skill, minutes), reviews (profile_id, skill_id, review_on).
    """
    today = F.lit(as_of).cast("date")
    live = applications.where(F.coalesce("status", F.lit("")) != "Closed")
    followups = live.where(F.col("followup") <= today).select(
        "profile_id", "job_id", F.lit(None).cast("string").alias("skill_id"), F.concat(F.lit("Follow up · "), "title").alias("title"),
        F.col("company").alias("detail"), F.col("followup").alias("due"), F.lit("workspace").alias("action"))
    due = lessons.join(reviews.where(F.col("review_on") <= today), ["profile_id", "skill_id"]).join(
        live.select("profile_id", "job_id", "company"), ["profile_id", "job_id"])
    practice = due.select("profile_id", "job_id", "skill_id", F.concat(F.lit("Review "), "skill").alias("title"),
                          F.concat(F.col("company"), F.lit(" · "), F.col("minutes"), F.lit(" min")).alias("detail"),
                          F.col("review_on").alias("due"), F.lit("coaching-lesson").alias("action"))
    return followups.unionByName(practice)


def in_due_order(items: DataFrame) -> DataFrame:
    return items.orderBy("due", "title", "job_id", "skill_id")


def stale(saved: DataFrame, current: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """T4: saved work (keys, fingerprint) against the rows it was built from; never-built rows are not stale."""
    now = current.select(*keys, fingerprint(*[F.col(c) for c in columns]).alias("current_print"))
    return saved.join(now, keys, "left").withColumn(
        "stale", F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("current_print")))
