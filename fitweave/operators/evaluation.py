"""Scoring of extracted profiles against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions.text import squeeze


def skills_at(expected: Column, actual: Column, k: int = 5) -> Column:
    """Share of the first k expected skills found in the answer, equal or one inside the other."""
    wanted = F.transform(F.slice(expected, 1, k), F.lower)
    have = F.transform(F.coalesce(actual, F.array().cast("array<string>")), F.lower)
    hits = F.filter(wanted, lambda s: F.exists(have, lambda a: F.contains(a, s) | F.contains(s, a)))
    return F.when(F.size(wanted) > 0, F.size(hits) / F.size(wanted))


def _name(value: Column) -> Column:
    return squeeze(F.lower(F.coalesce(value, F.lit(""))))


def _url(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "/+$", ""))


def scores(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Golden (id, full_name, skills, years_experience, github_url) against predictions (same columns, valid).

    A missing prediction counts as invalid JSON. One row with counts and rates.
    """
    p = predictions.select("id", "valid", *[F.col(c).alias(f"p_{c}") for c in ("full_name", "skills", "years_experience", "github_url")])
    rows = golden.join(p, "id", "left")
    valid = F.coalesce("valid", F.lit(False))
    has_name, has_url = F.coalesce("full_name", F.lit("")) != "", F.coalesce("github_url", F.lit("")) != ""
    has_years = F.col("years_experience").isNotNull()
    years_ok = F.coalesce(F.abs(F.col("p_years_experience") - F.col("years_experience")) <= 1, F.lit(False))
    counted = rows.agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid_json"),
        F.count_if(valid & has_name).alias("name_n"),
        F.count_if(valid & has_name & (_name(F.col("p_full_name")) == _name(F.col("full_name")))).alias("name_ok"),
        F.avg(F.when(valid, skills_at(F.col("skills"), F.col("p_skills")))).alias("skills_at_5"),
        F.count_if(valid & has_years).alias("years_n"), F.count_if(valid & has_years & years_ok).alias("years_ok"),
        F.count_if(valid & has_url).alias("github_n"),
        F.count_if(valid & has_url & (_url(F.col("p_github_url")) == _url(F.col("github_url")))).alias("github_ok"))

    def rate(ok: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(ok) / F.col(n)).otherwise(0.0)
    return counted.select("*", rate("valid_json", "n").alias("valid_json_rate"), rate("name_ok", "name_n").alias("name_accuracy"),
                          rate("years_ok", "years_n").alias("years_within_1"), rate("github_ok", "github_n").alias("github_url_exact"))


def gates(scored: DataFrame) -> DataFrame:
    """Pass marks; the link gate holds where no link is expected."""
    return scored.select("*", ((F.col("n") > 0) & (F.col("valid_json_rate") >= 0.90)).alias("valid_json_gate"),
                         ((F.col("github_n") == 0) | (F.col("github_url_exact") >= 0.80)).alias("github_gate"))
