"""Profile building from CV pages and model fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions.constants import (
    EMAIL, PHONE, GITHUB_LINK, LINKEDIN_LINK, YEAR_RANGE, YEARS_SAID,
    CLIENT_WORDS, CITY_COUNTRY, COUNTRY_NAMES, GITHUB_RESERVED, LANGUAGE_LEVELS, LOW_TEXT_CHARS)
from fitweave.functions.text import blank_to_null, distinct_ignoring_case, let, literal_map, strip
from fitweave.operators.skills import tidy_skill_list



def tidy_text(text: Column) -> Column:
    """Line ends, blank runs and empty lines."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def drop_repeated_edges(pages: DataFrame, max_chars: int = 80) -> DataFrame:
    """Pages (doc_id, page_no, text) without the header or footer line that every page repeats.

    A line repeats on every page exactly when the smallest and the largest
    first (last) line agree and no page lacks one, so plain aggregates decide.
    """
    def filled(lines: Column) -> Column:
        return F.filter(F.transform(lines, strip), lambda v: v != "")
    lined = pages.withColumn("lines", F.split("text", r"\r\n|\n|\r"))
    edges = lined.select("doc_id", F.get(filled(F.col("lines")), F.lit(0)).alias("head"),
                         F.get(F.reverse(filled(F.col("lines"))), F.lit(0)).alias("foot"))

    def repeated(column: str) -> Column:
        same = (F.min(column) == F.max(column)) & (F.count(column) == F.count("*")) & (F.count("*") > 1)
        return F.when(same & (F.length(F.min(column)) < max_chars), F.min(column))
    drop = edges.groupBy("doc_id").agg(F.array_compact(F.array(repeated("head"), repeated("foot"))).alias("drop"),
                                       F.count("*").alias("n_pages"))
    kept = let(F.col("drop"), lambda gone: F.filter("lines", lambda line: ~F.array_contains(gone, strip(line))))
    return lined.join(drop, "doc_id").select("doc_id", "page_no", "n_pages", F.when(
        F.col("n_pages") < 2, F.col("text")).otherwise(strip(F.array_join(kept, "\n"))).alias("text"))


def marked_page(page_no: Column, text: Column) -> Column:
    """Page text under its page marker."""
    return F.regexp_replace(F.concat(F.lit("--- page "), page_no, F.lit(" ---\n"), text), r"(?U)\s+$", "")


def documents(pages: DataFrame) -> DataFrame:
    """Document texts (doc_id, text), one row for each document, its pages in order under their markers."""
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "page_no", marked_page(F.col("page_no"), F.col("text")).alias("page")))).alias("pages"))
    return rows.select("doc_id", F.array_join(F.transform("pages", lambda p: p["page"]), "\n\n").alias("text"))


def text_quality(text: Column) -> Column:
    """C4: "low" for texts too short to read."""
    return F.when(F.length(text) < LOW_TEXT_CHARS, "low").otherwise("ok")


def _found(text: Column, sign: str, pattern: str, group: int) -> Column:
    """All matches of a pattern that never matches without ``sign``, whatever the case; texts without it are not searched."""
    none = F.array().cast("array<string>")
    return F.when(~F.contains(F.lower(text), F.lit(sign)), none).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def emails(text: Column) -> Column:
    return distinct_ignoring_case(_found(text, "@", EMAIL, 0))


def phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    digits = F.filter(found, lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")).between(8, 15))
    return distinct_ignoring_case(F.transform(digits, lambda p: F.regexp_replace(p, r"(?U)\s+", " ")))


def github_urls(text: Column) -> Column:
    users = F.filter(_found(text, "github.com/", GITHUB_LINK, 1), lambda u: ~F.lower(u).isin(GITHUB_RESERVED))
    return F.array_distinct(F.transform(users, lambda u: F.concat(F.lit("https://github.com/"), u)))


def linkedin_urls(text: Column) -> Column:
    slugs = _found(text, "linkedin.com/in/", LINKEDIN_LINK, 1)
    return F.array_distinct(F.transform(slugs, lambda s: F.concat(F.lit("https://www.linkedin.com/in/"), s)))


def year_ranges(text: Column) -> Column:
    """array<struct<start, end>>; null end means "present"; reversed ranges are dropped."""
    starts = F.regexp_extract_all(text, F.lit(YEAR_RANGE), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(YEAR_RANGE), F.lit(2))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(
        a.cast("int").alias("start"), F.when(b.rlike(r"^\d+$"), b.try_cast("int")).alias("end")))
    return F.filter(pairs, lambda p: p["end"].isNull() | (p["end"] >= p["start"]))


def bare_years(text: Column) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_distinct(F.filter(years, lambda y: y.between(1980, 2030)))


def stated_years(text: Column) -> Column:
    """The first "n years" phrase, at most 60."""
    return F.least(F.nullif(F.regexp_extract(text, YEARS_SAID, 1), F.lit("")).cast("double"), F.lit(60.0))


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> contact and year hints."""
    text = F.col("text")
    return docs.select("doc_id", emails(text).alias("emails"), phones(text).alias("phones"), github_urls(text).alias("github_urls"),
                       linkedin_urls(text).alias("linkedin_urls"), year_ranges(text).alias("year_ranges"),
                       bare_years(text).alias("years"), stated_years(text).alias("stated_years"))


def rules_profile(hints: DataFrame) -> DataFrame:
    """Profile from rules only; date ranges are never summed."""
    email, github = F.get("emails", F.lit(0)), F.get("github_urls", F.lit(0))
    return hints.select("doc_id", email.alias("email"), github.alias("github_url"),
                        F.get("linkedin_urls", F.lit(0)).alias("linkedin_url"), F.col("stated_years").alias("years_experience"),
                        F.when(email.isNotNull() | github.isNotNull(), 0.25).otherwise(0.1).alias("confidence"))


def employer(item: Column) -> Column:
    """struct<name, client> from struct<name, client>; "Firm (Client: X)" is split, other brackets stay."""
    pattern = rf"(?i)^(.+?)\s*\(\s*(?:{CLIENT_WORDS})\s*:?\s+([^)]+?)\s*\)\s*$"
    name, client = strip(F.coalesce(item["name"], F.lit(""))), blank_to_null(item["client"])
    split = name.rlike(pattern) & client.isNull()
    return F.struct(F.when(split, strip(F.regexp_extract(name, pattern, 1))).otherwise(name).alias("name"),
                    F.when(split, blank_to_null(F.regexp_extract(name, pattern, 2))).otherwise(client).alias("client"))


def spoken_language(item: Column) -> Column:
    """struct<name, level> from struct<name, level>; "Dutch (A2)" and "English - Native" are split."""
    pattern = rf"(?i)^(.+?)\s*(?:\(|[-–:])\s*({LANGUAGE_LEVELS})(?:\s+level)?\s*\)?\s*$"
    name, level = strip(F.coalesce(item["name"], F.lit(""))), blank_to_null(item["level"])
    split = name.rlike(pattern) & level.isNull()
    return F.struct(F.when(split, strip(F.regexp_extract(name, pattern, 1))).otherwise(name).alias("name"),
                    F.when(split, strip(F.regexp_extract(name, pattern, 2))).otherwise(level).alias("level"))


def _distinct_names(items: Column, coerce, limit: int) -> Column:
    rows = F.filter(F.transform(items, coerce), lambda r: r["name"] != "")
    first = let(rows, lambda known: let(F.transform(known, lambda r: F.lower(r["name"])), lambda names: F.filter(
        known, lambda r, i: F.array_position(names, F.lower(r["name"])) == i + 1)))
    return F.slice(first, 1, limit)


def employers(items: Column, limit: int = 15) -> Column:
    return _distinct_names(items, employer, limit)


def spoken_languages(items: Column, limit: int = 12) -> Column:
    return _distinct_names(items, spoken_language, limit)


def country_name(value: Column) -> Column:
    text = blank_to_null(value)
    return F.coalesce(literal_map(COUNTRY_NAMES)[F.replace(F.lower(text), F.lit("."), F.lit(""))], text)


def city_country(city: Column) -> Column:
    return literal_map(CITY_COUNTRY)[F.lower(blank_to_null(city))]


def full_location(city: Column, country: Column, raw: Column) -> Column:
    """C11: struct<city, country, raw> with the country spelled out or filled from the city."""
    return F.struct(blank_to_null(city).alias("city"), F.coalesce(country_name(country), city_country(city)).alias("country"),
                    blank_to_null(raw).alias("raw"))


def search_location(city: Column, country: Column, raw: Column) -> Column:
    """C12: "City, Country", or the city alone when one name holds the other."""
    place = full_location(city, country, raw)
    c, n = place["city"], place["country"]
    nested = F.contains(F.lower(c), F.lower(n)) | F.contains(F.lower(n), F.lower(c))
    return F.when(c.isNotNull() & n.isNotNull(), F.when(nested, c).otherwise(F.concat(c, F.lit(", "), n))).otherwise(
        F.coalesce(c, n, place["raw"]))


def merge_profile(model: DataFrame, rules: DataFrame, include_age: bool = False) -> DataFrame:
    """Rule identifiers win over model fields, lists are tidied, age stays out unless explicit and asked for."""
    hints = rules.select("doc_id", F.col("email").alias("r_email"), F.col("github_url").alias("r_github"),
                         F.col("linkedin_url").alias("r_linkedin"))
    rows = model.join(hints, "doc_id", "left")
    keep_age = (F.col("age_source") == "explicit_cv") if include_age else F.lit(False)
    place = full_location(F.col("location.city"), F.col("location.country"), F.col("location.raw"))
    return rows.select(
        "doc_id", "full_name", F.coalesce("r_email", "email").alias("email"), F.coalesce("r_github", "github_url").alias("github_url"),
        F.coalesce("r_linkedin", "linkedin_url").alias("linkedin_url"), "years_experience", "primary_industry",
        F.struct(place["city"].alias("city"), F.col("location.region").alias("region"), place["country"].alias("country"),
                 place["raw"].alias("raw")).alias("location"),
        tidy_skill_list(F.col("skills")).alias("skills"), distinct_ignoring_case(F.col("recent_titles"), 5).alias("recent_titles"),
        employers(F.col("employers")).alias("employers"), distinct_ignoring_case(F.col("certifications"), 15).alias("certifications"),
        spoken_languages(F.col("spoken_languages")).alias("spoken_languages"),
        distinct_ignoring_case(F.col("possible_titles"), 8).alias("possible_titles"),
        *[F.when(keep_age, F.col(c)).alias(c) for c in ("birth_year", "age_estimate", "age_source")], "confidence")


def public_json(profiles: DataFrame, include_age: bool = False) -> DataFrame:
    """Export rows; the age trio is left out unless explicit and asked for, empty client/level omitted."""
    columns = [c for c in profiles.columns if c not in ("doc_id", "birth_year", "age_estimate", "age_source")]
    aged = [*columns, "birth_year", "age_estimate", "age_source"]
    options = {"ignoreNullFields": "true"}
    plain = F.to_json(F.struct(*columns), options)
    full = F.to_json(F.struct(*aged), options)
    return profiles.select("doc_id", (F.when(F.col("age_source") == "explicit_cv", full).otherwise(plain) if include_age else plain).alias("json"))


def title_context(profiles: DataFrame) -> DataFrame:
    """What titles may be inferred from; no contacts, no age."""
    fields = ["skills", "certifications", "spoken_languages", "recent_titles", "employers", "years_experience",
              "primary_industry", "location"]
    return profiles.select("doc_id", F.to_json(F.struct(*fields)).alias("json"))


# --- C14 model output validation --------------------------------------------

_CV_FIELDS = ("full_name string, email string, skills array<string>, years_experience double, recent_titles array<string>, "
              "certifications array<string>, possible_titles array<string>, birth_year int, age_estimate int, confidence double, "
              "_bad string")
_TITLE_FIELDS = "possible_titles array<string>, _bad string"
_STORY_FIELDS = "briefing string, stories array<struct<prompt:string,anchor:string>>, ask_them array<string>, _bad string"
_EXERCISE_FIELDS = ("diagnostic string, exercise string, stretch string, hints array<string>, criteria array<string>, _bad string")


def json_body(raw: Column) -> Column:
    """The outermost object of a model answer, without code fences and preamble."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(body == "", strip(raw)).otherwise(body)


def _parsed(body: Column, fields: str) -> Column:
    return F.from_json(body, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def _restates(title: Column, recent: Column) -> Column:
    low = F.lower(title)
    return F.exists(recent, lambda r: F.contains(F.lower(r), low) | F.contains(low, F.lower(r)))


def validate_answers(answers: DataFrame) -> DataFrame:
    """C14: answers (answer_id, kind, raw, certifications, recent_titles) -> outcome ok / repair / reject and reasons.

    ``repair`` marks answers that parse but miss something a second try could add.
    """
    body = json_body(F.col("raw"))
    rows = answers.withColumn("cv", F.when(F.col("kind") == "cv", _parsed(body, _CV_FIELDS))) \
        .withColumn("titles", F.when(F.col("kind") == "titles", _parsed(body, _TITLE_FIELDS))) \
        .withColumn("story", F.when(F.col("kind") == "stories", _parsed(body, _STORY_FIELDS))) \
        .withColumn("task", F.when(F.col("kind") == "exercise", _parsed(body, _EXERCISE_FIELDS)))

    def bad(name: str) -> Column:
        return F.col(f"{name}._bad").isNotNull()

    def length_out(column: str, low: int, high: int) -> Column:
        return ~F.coalesce(F.length(strip(F.col(column))).between(low, high), F.lit(False))

    def list_out(column: str) -> Column:
        good = F.size(column).between(2, 4) & F.forall(F.col(column), lambda s: F.length(strip(s)).between(5, 400))
        return ~F.coalesce(good, F.lit(False))
    none = F.array().cast("array<string>")
    prompts = F.filter(F.transform(F.coalesce(F.col("story.stories"), F.array().cast("array<struct<prompt:string,anchor:string>>")),
                                   lambda s: strip(F.coalesce(s["prompt"], F.lit("")))), lambda p: p != "")
    titles = F.coalesce(F.col("titles.possible_titles"), none)
    recent = F.coalesce(F.col("recent_titles"), none)
    ignored = (F.size(F.coalesce(F.col("certifications"), none)) > 0) & (F.size(titles) > 0) & (F.size(recent) > 0) & F.forall(
        titles, lambda t: _restates(t, recent))
    is_kind = {k: F.col("kind") == k for k in ("cv", "titles", "stories", "exercise")}
    checks = [
        (is_kind["cv"] & bad("cv") | is_kind["titles"] & bad("titles") | is_kind["stories"] & bad("story")
         | is_kind["exercise"] & bad("task"), "json"),
        (is_kind["cv"] & (F.size("cv.skills") > 40), "schema: skills"),
        (is_kind["cv"] & ~F.coalesce(F.col("cv.years_experience").between(0, 60), F.lit(True)), "schema: years_experience"),
        (is_kind["cv"] & (F.size("cv.recent_titles") > 5), "schema: recent_titles"),
        (is_kind["cv"] & (F.size("cv.certifications") > 15), "schema: certifications"),
        (is_kind["cv"] & ~F.coalesce(F.col("cv.birth_year").between(1920, 2015), F.lit(True)), "schema: birth_year"),
        (is_kind["cv"] & ~F.coalesce(F.col("cv.age_estimate").between(14, 100), F.lit(True)), "schema: age_estimate"),
        (is_kind["cv"] & ~F.coalesce(F.col("cv.confidence").between(0, 1), F.lit(True)), "schema: confidence"),
        (is_kind["titles"] & (F.size(titles) > 8), "schema: possible_titles"),
        (is_kind["stories"] & ((strip(F.coalesce(F.col("story.briefing"), F.lit(""))) == "") | (F.size(prompts) == 0)), "schema: stories"),
        (is_kind["exercise"] & (length_out("task.diagnostic", 20, 500) | length_out("task.exercise", 20, 1750)
                                | length_out("task.stretch", 20, 500)), "schema: exercise"),
        (is_kind["exercise"] & (list_out("task.hints") | list_out("task.criteria")), "schema: checks"),
        (is_kind["cv"] & (strip(F.coalesce(F.col("cv.full_name"), F.lit(""))) == "") & ~bad("cv"), "missing full_name"),
        (is_kind["titles"] & (F.size(titles) == 0) & ~bad("titles"), "missing possible_titles"),
        (is_kind["titles"] & ignored, "titles ignore certifications"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for test, reason in checks]))
    # an unreadable answer has no other findings
    reasons = F.when(F.array_contains(reasons, "json"), F.array(F.lit("json"))).otherwise(reasons)
    rows = rows.select("answer_id", "kind", reasons.alias("reasons"), F.slice(prompts, 1, 4).alias("stories"))
    rejected = F.exists("reasons", lambda r: (r == "json") | F.startswith(r, F.lit("schema")))
    return rows.withColumn("outcome", F.when(F.size("reasons") == 0, "ok").when(rejected, "reject").otherwise("repair"))


def validation_rates(checked: DataFrame) -> DataFrame:
    """C14: answers per kind, outcome and reason."""
    return checked.select("kind", "outcome", F.explode_outer("reasons").alias("reason")).groupBy("kind", "outcome", "reason").count()
