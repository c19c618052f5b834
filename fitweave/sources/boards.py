"""Board payloads -> postings.

Payload tables hold landed responses: (source, board, payload). Every parser
returns one row per record with ``reject`` naming why a record is unusable;
``accepted``/``rejected`` split them and ``accounting`` counts both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fitweave.functions.constants import EMPLOYMENT_KEYS, WORKPLACE_KEYS
from fitweave.functions.html import clean_text, plain_text
from fitweave.functions.text import literal_map
from fitweave.functions.urls import is_web_url

#: Why a whole payload could not be read.
PAYLOAD_PROBLEMS = ["unexpected record list", "invalid pagination metadata", "ignored a requested filter"]
FIELDS = ["source", "board", "rec_no", "job_id", "title", "company", "location", "application_url", "description", "posted_at",
          "employment_type", "workplace_type", "salary", "reject"]


def _compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(clean_text(value)), r"[\s_\-]", "")


def employment_type(value: Column) -> Column:
    """Known employment label, else null."""
    return literal_map(EMPLOYMENT_KEYS)[_compact(value)]


def workplace_type(value: Column) -> Column:
    return literal_map(WORKPLACE_KEYS)[_compact(value)]


def posted_time(value: Column) -> Column:
    """ISO date or time text as timestamp; without an offset it is UTC."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    whole = F.regexp_replace(value, r"^(.{10}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    moment = F.when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00Z"))).when(
        value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    return F.when(shaped, F.try_to_timestamp(moment))


def _filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _records(payloads: DataFrame, items: Column, schema: str, problem: Column | None = None) -> DataFrame:
    """One row for each record; a payload without the expected list is one row with its ``problem``."""
    wrong = F.when(items.isNull(), "unexpected record list")
    rows = payloads.withColumn("problem", F.coalesce(problem, wrong) if problem is not None else wrong)
    listed = F.when(F.col("problem").isNull(), items).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("source", "board", "problem", F.posexplode(listed).alias("rec_no", "text"))
    return rows.withColumn("rec_no", F.when(F.col("problem").isNull(), F.col("rec_no"))).withColumn("r", F.from_json("text", schema))


def _object_items(key: str) -> Column:
    return F.from_json("payload", f"struct<{key}:array<string>>")[key]


def _company(rows: DataFrame, companies: DataFrame | None) -> DataFrame:
    """Registry name of a board, else the board's own name in words."""
    fallback = F.replace(F.regexp_replace("board", "^eu:", ""), F.lit("-"), F.lit(" "))
    if companies is None:
        return rows.withColumn("registry_name", fallback)
    known = companies.select(F.col("ats_type").alias("source"), F.col("board_slug").alias("board"), F.col("name").alias("known_name"))
    return rows.join(known, ["source", "board"], "left").withColumn("registry_name", F.coalesce("known_name", fallback))


def posting_row(rows: DataFrame, *, title, company, location, url, job_id, description, posted_at,
                employment=None, workplace=None, salary=None, skipped=None) -> DataFrame:
    """Common constructor; records without title, company or a safe link are kept as rejects."""
    null = F.lit(None).cast("string")
    title, company, url = clean_text(title), clean_text(company), clean_text(url)
    problem = F.col("problem") if "problem" in rows.columns else null
    reject = (F.when(problem.isNotNull(), problem).when(F.col("r").isNull(), "unreadable")
              .when(F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False), "closed")
              .when(title.isNull(), "no title").when(company.isNull(), "no company").when(url.isNull(), "no link")
              .when(~is_web_url(url), "unsafe link"))
    return rows.select(
        "source", "board", "rec_no", F.coalesce(clean_text(job_id), url).alias("job_id"), title.alias("title"), company.alias("company"),
        clean_text(location).alias("location"), url.alias("application_url"), plain_text(description).alias("description"),
        clean_text(posted_at).alias("posted_at"), (employment if employment is not None else null).alias("employment_type"),
        (workplace if workplace is not None else null).alias("workplace_type"), (clean_text(salary) if salary is not None else null).alias("salary"),
        reject.alias("reject"))


def greenhouse(payloads: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """S1."""
    rows = _company(_records(payloads, _object_items("jobs"), (
        "title string, company_name string, location struct<name:string>, absolute_url string, id string, first_published string, content string")), companies)
    number = F.coalesce(_filled(F.col("r.id")), F.col("r.absolute_url"), F.lit(""))
    return posting_row(rows, title=F.col("r.title"), company=F.coalesce(_filled(F.col("r.company_name")), F.col("registry_name")),
                       location=F.col("r.location.name"), url=F.col("r.absolute_url"),
                       job_id=F.concat(F.lit("greenhouse:"), "board", F.lit(":"), number), description=F.col("r.content"), posted_at=F.col("r.first_published"))


def _iso_millis(value: Column) -> Column:
    stamp = F.to_utc_timestamp(F.timestamp_millis(value), F.current_timezone())  # UTC whatever the session's zone
    part = F.when(value % 1000 != 0, F.concat(F.date_format(stamp, ".SSS"), F.lit("000"))).otherwise(F.lit(""))
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def lever(payloads: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """S2."""
    rows = _company(_records(payloads, F.from_json("payload", "array<string>"), (
        "text string, hostedUrl string, applyUrl string, id string, createdAt bigint, workplaceType string, descriptionPlain string, "
        "description string, additionalPlain string, additional string, lists array<struct<text:string,content:string>>, "
        "categories struct<allLocations:array<string>,location:string,commitment:string>")), companies)
    places = F.when(F.size("r.categories.allLocations") > 0, F.col("r.categories.allLocations")).otherwise(F.array("r.categories.location"))
    blank = F.lit("")
    sections = F.flatten(F.transform(F.coalesce("r.lists", F.array().cast("array<struct<text:string,content:string>>")),
                                     lambda s: F.array(F.coalesce(s["text"], blank), F.coalesce(s["content"], blank))))
    body = F.concat(F.array(F.coalesce(_filled(F.col("r.descriptionPlain"), F.col("r.description")), blank)), sections,
                    F.array(F.coalesce(_filled(F.col("r.additionalPlain"), F.col("r.additional")), blank)))
    url = _filled(F.col("r.hostedUrl"), F.col("r.applyUrl"))
    return posting_row(rows, title=F.col("r.text"), company=F.col("registry_name"), location=F.array_join(F.array_compact(places), "; "), url=url,
                       job_id=F.concat(F.lit("lever:"), "board", F.lit(":"), F.coalesce(_filled(F.col("r.id")), url, blank)),
                       description=F.array_join(body, "\n"), posted_at=_iso_millis(F.col("r.createdAt")),
                       employment=employment_type(F.col("r.categories.commitment")), workplace=workplace_type(F.col("r.workplaceType")))


def ashby(payloads: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """S3: unlisted records disappear silently."""
    rows = _company(_records(payloads, _object_items("jobs"), (
        "jobUrl string, applyUrl string, title string, location string, workplaceType string, employmentType string, descriptionPlain string, "
        "descriptionHtml string, publishedAt string, isListed boolean, isRemote boolean, secondaryLocations array<struct<location:string>>")), companies)
    rows = rows.where(F.coalesce("r.isListed", F.lit(True)))
    more = F.transform(F.coalesce("r.secondaryLocations", F.array().cast("array<struct<location:string>>")), lambda s: s["location"])
    url = _filled(F.col("r.jobUrl"), F.col("r.applyUrl"))
    return posting_row(rows, title=F.col("r.title"), company=F.col("registry_name"),
                       location=F.array_join(F.array_compact(F.concat(F.array("r.location"), more)), "; "), url=url,
                       job_id=F.concat(F.lit("ashby:"), "board", F.lit(":"), F.coalesce(url, F.lit(""))),
                       description=_filled(F.col("r.descriptionPlain"), F.col("r.descriptionHtml")), posted_at=F.col("r.publishedAt"),
                       employment=employment_type(F.col("r.employmentType")),
                       workplace=F.coalesce(workplace_type(F.col("r.workplaceType")), F.when(F.col("r.isRemote"), "remote")))


def envelope_problem(payload: Column) -> Column:
    """Why a search envelope is unusable, else null."""
    meta = F.from_json(payload, "struct<data:array<string>,meta:struct<total:bigint,ignored_params:array<string>>>")
    return (F.when(meta["data"].isNull(), "unexpected record list")
            .when(F.coalesce(meta["meta"]["total"], F.lit(-1)) < 0, "invalid pagination metadata")
            .when(F.size(F.coalesce(meta["meta"]["ignored_params"], F.array().cast("array<string>"))) > 0, "ignored a requested filter"))


def freehire(payloads: DataFrame) -> DataFrame:
    """Records of usable envelopes; closed ones and unusable envelopes are rejects."""
    rows = _records(payloads, _object_items("data"), (
        "title string, company string, location string, url string, public_slug string, description string, posted_at string, closed_at string, "
        "work_mode string, employment_type string, enrichment struct<employment_type:string>"), envelope_problem(F.col("payload")))
    return posting_row(rows, title=F.col("r.title"), company=F.col("r.company"), location=F.col("r.location"), url=F.col("r.url"),
                       job_id=F.col("r.public_slug"), description=F.col("r.description"), posted_at=F.col("r.posted_at"),
                       employment=employment_type(_filled(F.col("r.employment_type"), F.col("r.enrichment.employment_type"))),
                       workplace=workplace_type(F.col("r.work_mode")), skipped=F.col("r.closed_at") != "")


def tabular(rows: DataFrame) -> DataFrame:
    """Scraped table rows (source, board, rec_no, title, company, location, job_url, id, description, date_posted,
    job_type, currency, interval, min_amount, max_amount, is_remote)."""
    columns = [c for c in rows.columns if c not in ("source", "board", "rec_no")]
    packed = rows.select("source", "board", "rec_no", F.struct(*columns).alias("r"))
    low, high = clean_text(F.col("r.min_amount")), clean_text(F.col("r.max_amount"))
    salary = F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(
        " ", clean_text(F.col("r.currency")), F.concat_ws("–", low, high), clean_text(F.col("r.interval"))))
    return posting_row(packed, title=F.col("r.title"), company=F.col("r.company"), location=F.col("r.location"), url=F.col("r.job_url"),
                       job_id=F.coalesce(clean_text(F.col("r.id")), clean_text(F.col("r.job_url"))), description=F.col("r.description"),
                       posted_at=F.col("r.date_posted"), employment=employment_type(F.col("r.job_type")),
                       workplace=F.when(F.coalesce(F.col("r.is_remote"), F.lit(False)), "remote"), salary=salary)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject is null").drop("reject")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reject is not null").select("source", "board", "rec_no", "job_id", "reject")


def accounting(rows: DataFrame, date_filter: bool = False) -> DataFrame:
    """Kept, skipped and undated records per (source, board), with the warnings they cause and the status.

    A board none of whose payloads could be read is an ``error``, named by ``error``; with some unread ones it is ``partial``.
    """
    unread = F.coalesce(F.col("reject").isin(PAYLOAD_PROBLEMS), F.lit(False))
    bad = F.col("reject").isNotNull() & ~unread
    undated = F.col("reject").isNull() & posted_time(F.col("posted_at")).isNull() if date_filter else F.lit(False)
    counts = rows.groupBy("source", "board").agg(F.count_if(F.col("reject").isNull()).alias("kept"), F.count_if(bad).alias("skipped"), F.count_if(undated).alias("undated"),
                                                F.count_if(unread).alias("unread"), F.min(F.when(unread, F.col("reject"))).alias("error"), F.count_if(~unread).alias("read"))
    warnings = F.array_compact(F.array(
        F.when(F.col("skipped") > 0, F.concat(F.lit("Skipped "), "skipped", F.lit(" incomplete or invalid listings."))),
        F.when(F.col("undated") > 0, F.concat(F.lit("Excluded "), "undated", F.lit(
            " listings without a publication date. Choose Any time to include them.")))))
    status = F.when((F.col("unread") > 0) & (F.col("read") == 0), "error").when((F.size(warnings) > 0) | (F.col("unread") > 0), "partial").otherwise("ok")
    return counts.select("*", warnings.alias("warnings"), status.alias("status")).drop("read")


def write_postings(rows: DataFrame, location: str, date_filter: bool = False) -> dict[str, int]:
    """Write the accepted postings; the totals of all records are observed by the same write, without a second pass.

    Returns kept, skipped, undated and unread, as `accounting` sums them over all boards.
    """
    seen = Observation()
    unread = F.coalesce(F.col("reject").isin(PAYLOAD_PROBLEMS), F.lit(False))
    undated = F.col("reject").isNull() & posted_time(F.col("posted_at")).isNull() if date_filter else F.lit(False)
    counted = rows.observe(seen, F.count_if(F.col("reject").isNull()).alias("kept"), F.count_if(F.col("reject").isNotNull() & ~unread).alias("skipped"),
                           F.count_if(undated).alias("undated"), F.count_if(unread).alias("unread"))
    accepted(counted).write.mode("overwrite").parquet(location)
    return seen.get
