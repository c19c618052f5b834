"""Posting pages and search requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions.constants import (
    BLOCKED_MARKERS, DATE_DAYS, DATE_SECONDS, EASY_APPLY_LABELS, EMPTY_MARKERS, EXPERIENCE_CODES, LEGACY_DATE,
    PAGE_EMPLOYMENT_LABELS, PAGE_WORKPLACE_LABELS, SALARY_CODES, STRUCTURED_WORKPLACE_LABELS, TYPE_CODES, WORKPLACE_CODES)
from fitweave.functions.html import block_text, clean_description
from fitweave.functions.text import distinct_ignoring_case, literal_map, squeeze, strip
from fitweave.functions.urls import company_apply_url, is_web_url

_NONE = "array<string>"


def none() -> Column:
    return F.array().cast(_NONE)


def page_outcome(html: Column) -> Column:
    """Cards, blocked, empty or unrecognised; an unknown page is never an empty success."""
    low = F.lower(html)
    cards = html.rlike(r"""(?i)class\s*=\s*["'](?:[^"']*\s)?base-search-card(?:\s[^"']*)?["']""") | html.rlike(
        r"(?is)<li\b.*base-search-card__title")
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return (F.when(strip(html) == "", "empty").when(cards, "cards").when(any_of(BLOCKED_MARKERS), "blocked")
            .when(any_of(EMPTY_MARKERS), "empty").otherwise("unrecognised"))


def outcome_counts(pages: DataFrame) -> DataFrame:
    """Pages (source, html) -> counts per outcome."""
    return pages.groupBy("source", page_outcome(F.col("html")).alias("outcome")).count()


def _label_key(text: Column) -> Column:
    return squeeze(F.translate(F.lower(text), "_/-", "   "))


def _first_label(text: Column, values: dict) -> Column:
    parts = F.concat(F.array(text), F.split(text, r"[·•|,]"))
    known = F.filter(F.transform(parts, lambda p: literal_map(values)[_label_key(p)]), lambda v: v.isNotNull())
    return F.get(known, F.lit(0))


def labels_from_text(text: Column, structured: bool = False) -> Column:
    """struct<employment_type, workplace_type> named in a label list."""
    places = STRUCTURED_WORKPLACE_LABELS if structured else PAGE_WORKPLACE_LABELS
    return F.struct(_first_label(text, PAGE_EMPLOYMENT_LABELS).alias("employment_type"), _first_label(text, places).alias("workplace_type"))


def _as_list(raw: Column) -> Column:
    """A JSON value read as text: its elements if it is a list, else itself."""
    return F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, _NONE)).otherwise(F.array(raw))


_ITEM = "`@type` string, description string, employmentType string, jobLocationType string, directApply string"


def structured_fields(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) -> description, types and direct apply of their JobPosting blocks, first found wins.

    Blocks may hold one object, a list or an @graph; once all three text fields are found later blocks are not read.
    """
    scripts = F.regexp_extract_all("html", F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["'][^"'>]*ld\+json[^>]*>(.*?)</script\s*>"""), F.lit(1))
    blocks = pages.select("page_id", F.posexplode(scripts).alias("block", "text"))
    items = blocks.select("page_id", "block", F.posexplode(_as_list(F.trim("text"))).alias("nr", "item"))
    graph = F.coalesce(F.from_json(F.get_json_object("item", "$.@graph"), _NONE), none())
    items = items.select("page_id", "block", "nr", F.posexplode(F.concat(F.array("item"), graph)).alias("sub", "item"))
    read = items.withColumn("j", F.from_json("item", _ITEM)).where(
        F.exists(_as_list(F.col("j.@type")), lambda t: F.endswith(t, F.lit("JobPosting"))))
    desc = F.col("j.description")
    text = F.when(F.contains(desc, F.lit("<")), block_text(desc)).otherwise(squeeze(desc))

    def label(part: str) -> Column:
        values = F.concat(F.coalesce(_as_list(F.col("j.employmentType")), none()), F.coalesce(_as_list(F.col("j.jobLocationType")), none()))
        found = F.transform(values, lambda v: labels_from_text(v, structured=True)[part])
        return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))
    at = F.struct("block", "nr", "sub")
    rows = read.select("page_id", at.alias("at"), clean_description(text).alias("description"), label("employment_type").alias("employment_type"),
                       label("workplace_type").alias("workplace_type"), (F.col("j.directApply") == "true").alias("direct"))

    def first(column: str) -> Column:
        return F.min(F.when(F.col(column).isNotNull(), F.struct("at", F.col(column).alias("v"))))
    texts = ("description", "employment_type", "workplace_type")
    found = rows.groupBy("page_id").agg(*[first(c).alias(f"first_{c}") for c in texts],
                                        F.array_sort(F.collect_list(F.when(F.col("direct").isNotNull(), F.struct("at", "direct")))).alias("directs"))
    complete = F.when(F.forall(F.array(*[F.col(f"first_{c}").isNull() for c in texts]), lambda missing: ~missing),
                      F.array_max(F.array(*[F.col(f"first_{c}.at") for c in texts])))
    direct = F.get(F.filter("directs", lambda d: complete.isNull() | (d["at"] <= complete)), F.lit(0))["direct"]
    return found.select("page_id", *[F.col(f"first_{c}.v").alias(c) for c in texts], direct.alias("easy_apply"))


def apply_mode(tracking: Column, label: Column, apply_url: Column, direct: Column) -> Column:
    """struct<easy_apply, external_apply_url>; a company link always means no easy apply."""
    external = company_apply_url(apply_url)
    tracked = F.lower(F.coalesce(tracking, F.lit("")))
    named = _label_key(F.coalesce(label, F.lit("")))
    easy = tracked.rlike("easy[_-]?apply")
    easy = F.when(external.isNotNull(), False).when(easy, True).when(F.contains(tracked, F.lit("offsite")), False).when(
        named.isin(EASY_APPLY_LABELS) | F.startswith(named, F.lit("easy apply")), True).otherwise(direct)
    return F.struct(easy.alias("easy_apply"), external.alias("external_apply_url"))


def enrich(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Page details (job_id, fields) fill rows without a description; other rows keep theirs."""
    fields = [c for c in details.columns if c != "job_id"]
    page = details.select("job_id", *[F.col(c).alias(f"d_{c}") for c in fields])
    bare = F.col("description").isNull()
    kept = [c for c in postings.columns if c not in fields]
    return postings.join(page, "job_id", "left").select(*kept, *[
        F.when(bare, F.coalesce(f"d_{c}", c)).otherwise(F.col(c)).alias(c) if c in postings.columns else F.when(bare, F.col(f"d_{c}")).alias(c)
        for c in fields])


def description_counts(postings: DataFrame) -> DataFrame:
    """Rows with a description out of all, per source, with the warning they cause."""
    counts = postings.groupBy("source").agg(F.count("description").alias("have"), F.count("*").alias("n"))
    return counts.withColumn("warning", F.when(F.col("have") == 0, "Job descriptions were not available for this search.").when(
        F.col("have") < F.col("n"), F.concat(F.lit("Read descriptions for "), "have", F.lit(" of "), "n", F.lit(" listings."))))


# --- N11 row sanitiser -------------------------------------------------------

_TYPES = ["full_time", "part_time", "contract", "temporary", "volunteer", "internship"]


def _clip(column: Column, limit: int) -> Column:
    return F.left(strip(F.coalesce(column, F.lit(""))), F.lit(limit))


def _optional(column: Column, limit: int) -> Column:
    return F.nullif(_clip(column, limit), F.lit(""))


def _label_list(column: Column, size: int = 80, limit: int = 100) -> Column:
    clipped = F.filter(F.transform(F.coalesce(column, none()), lambda v: _clip(v, size)), lambda v: v != "")
    return F.slice(F.array_distinct(clipped), 1, limit)


def _uri_part(text: Column) -> Column:
    """Percent-encoding of an id part, with blanks as %20 and the unreserved marks kept."""
    coded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        coded = F.replace(coded, F.lit(code), F.lit(mark))
    return coded


def sanitise_postings(rows: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Imported rows -> clipped, whitelisted rows with id and is_valid; invalid ones keep their reason."""
    source, job, title, company = (_clip(F.col(c), n) for c, n in (("source", 80), ("job_id", 200), ("title", 500), ("company", 500)))
    url = F.when(is_web_url(F.col("application_url")), F.col("application_url"))
    description = _optional(F.col("description"), description_chars) if description_chars else F.nullif(
        strip(F.coalesce("description", F.lit(""))), F.lit(""))
    reason = (F.when(source == "", "no source").when(job == "", "no id").when(title == "", "no title").when(company == "", "no company")
              .when(url.isNull(), "unsafe link"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nullif("match_score", F.lit(float("nan")))))
    return rows.select(
        F.concat(_uri_part(source), F.lit(":"), _uri_part(job)).alias("id"), source.alias("source"), job.alias("job_id"), title.alias("title"),
        company.alias("company"), url.alias("application_url"), _optional(F.col("location"), 500).alias("location"), description.alias("description"),
        F.when(F.col("workplace_type").isin(list(WORKPLACE_CODES)), F.col("workplace_type")).alias("workplace_type"),
        F.when(F.col("employment_type").isin(_TYPES), F.col("employment_type")).alias("employment_type"),
        F.when(F.col("description_source") == "pasted", "pasted").otherwise("source").alias("description_source"),
        _label_list(F.col("skills")).alias("skills"), F.when(F.col("match_score").isNotNull(), score).alias("match_score"),
        reason.isNull().alias("is_valid"), reason.alias("reason"))


def sanitise_requests(rows: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Profile and listing of a writing request, with the reason it cannot be served."""
    name, title, company = _clip(F.col("name"), 80), _clip(F.col("title"), 200), _clip(F.col("company"), 200)
    description = strip(F.coalesce("description", F.lit("")))
    if description_chars:
        description = F.left(description, F.lit(description_chars))
    reason = (F.when(name == "", "Add your name in your profile first.").when((title == "") | (company == ""), "This listing is missing a title or company.")
              .when(F.length(description) < 40, "Paste the job description so this can talk about this role."))
    years = F.when(F.col("years_experience").between(0, 60), F.col("years_experience"))
    return rows.select("request_id", name.alias("name"), title.alias("title"), company.alias("company"), description.alias("description"),
                       distinct_ignoring_case(F.transform(F.coalesce("skills", none()), lambda s: _clip(s, 80)), 40).alias("skills"),
                       years.alias("years_experience"), reason.alias("reason"))


# --- N12, N13 search requests --------------------------------------------------

def _option(value: Column) -> Column:
    text = F.regexp_replace(squeeze(F.replace(F.lower(value), F.lit("-"), F.lit(" "))), " ", "_")
    return F.when(text == "24h", "24hr").otherwise(F.nullif(text, F.lit("")))


def _choices(value: Column) -> Column:
    """Sorted distinct options of one value or a comma list; null where nothing is chosen."""
    return F.when(F.contains(value, F.lit(",")), F.array_sort(F.array_distinct(F.transform(F.split(value, ","), _option)))).otherwise(
        F.when(_option(value).isNotNull(), F.array(_option(value))))


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Requests with alias and legacy columns, all text -> typed queries; invalid ones carry their reason.

    Columns read where present: keywords/keyword, location, career_url, date_since_posted/dateSincePosted, posted_within_days/postedWithinDays,
    job_type/jobType, workplace_type/remoteFilter, experience_level/experienceLevel, salary, sort_by/sortBy, limit, page,
    has_verification, under_10_applicants, and the legacy f_TPR, f_E, f_WT.
    """
    def col(*names: str) -> Column:
        present = [F.col(n) for n in names if n in raw.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    def legacy(name: str, codes: dict) -> tuple[Column, Column]:
        value = col(name)
        return literal_map(codes)[value], value.isNotNull() & literal_map(codes)[value].isNull()
    old_date, bad_date = legacy("f_TPR", LEGACY_DATE)
    old_level, bad_level = legacy("f_E", {v: k for k, v in EXPERIENCE_CODES.items()})
    old_place, bad_place = legacy("f_WT", {v: k for k, v in WORKPLACE_CODES.items()})
    date, level, place = col("date_since_posted", "dateSincePosted"), col("experience_level", "experienceLevel"), col("workplace_type", "remoteFilter")
    clash = F.coalesce((date != old_date) | (level != old_level), F.lit(False)) | F.coalesce(level != old_level, F.lit(False)) | F.coalesce(
        date != old_date, F.lit(False)) | F.coalesce(place != old_place, F.lit(False))
    keywords, location = strip(col("keywords", "keyword")), strip(col("location"))
    dates = F.coalesce(_option(F.coalesce(old_date, date)), F.lit("past_week"))
    days, salary = col("posted_within_days", "postedWithinDays").try_cast("int"), col("salary")
    types, places, levels = _choices(col("job_type", "jobType")), _choices(F.coalesce(old_place, place)), _choices(F.coalesce(old_level, level))
    pay = F.nullif(salary, F.lit("")).try_cast("int")
    order = F.coalesce(_option(col("sort_by", "sortBy")), F.lit("relevant"))
    limit, page = F.coalesce(col("limit").try_cast("int"), F.lit(15)), F.coalesce(col("page").try_cast("int"), F.lit(0))

    def outside(values: Column, allowed) -> Column:
        return F.coalesce(F.exists(values, lambda v: v.isNull() | ~v.isin(list(allowed))), F.lit(False))
    reason = (F.when(bad_date | bad_level | bad_place, "unsupported legacy filter").when(clash, "conflicting filters")
              .when(F.coalesce(F.length(keywords), F.lit(0)) == 0, "no keywords").when(F.length(keywords) > 300, "keywords too long")
              .when(F.length(location) > 200, "location too long").when(F.length(col("career_url")) > 2000, "career link too long")
              .when(~dates.isin("any", *DATE_DAYS), "unknown date").when(days.isNotNull() & ~days.between(1, 365), "unknown days")
              .when(outside(types, TYPE_CODES), "unknown job type").when(outside(places, WORKPLACE_CODES), "unknown workplace")
              .when(outside(levels, EXPERIENCE_CODES), "unknown level")
              .when((F.coalesce(salary, F.lit("")) != "") & ~F.coalesce(pay.isin(list(SALARY_CODES)), F.lit(False)), "unknown salary")
              .when(~order.isin("recent", "relevant"), "unknown order").when(~limit.between(1, 100), "unknown limit").when(~page.between(0, 1000), "unknown page"))
    flag = lambda name: F.coalesce(col(name).try_cast("boolean"), F.lit(False))
    return raw.select(
        "query_id", keywords.alias("keywords"), F.nullif(location, F.lit("")).alias("location"), F.nullif(strip(col("career_url")), F.lit("")).alias("career_url"),
        dates.alias("date_since_posted"), days.alias("posted_within_days"), types.alias("job_type"), places.alias("workplace_type"),
        levels.alias("experience_level"), pay.alias("salary"), order.alias("sort_by"), limit.alias("limit"), page.alias("page"),
        flag("has_verification").alias("has_verification"), flag("under_10_applicants").alias("under_10_applicants"), reason.alias("reason"))


def date_days(queries_date: Column, within: Column) -> Column:
    """Days of the date filter: the explicit number wins over the preset."""
    return F.coalesce(within, literal_map(DATE_DAYS)[queries_date])


def _codes(values: Column, codes: dict) -> Column:
    return F.nullif(F.array_join(F.transform(values, lambda v: literal_map(codes)[v]), ","), F.lit(""))


def source_requests(queries: DataFrame) -> DataFrame:
    """What each source can take over from a query: (query_id, source, params map); nulls are left out."""
    text = lambda c: c.cast("string")
    recent = F.col("sort_by") == "recent"
    seconds = F.coalesce(F.concat(F.lit("r"), text(F.col("posted_within_days") * 86400)), literal_map(DATE_SECONDS)[F.col("date_since_posted")])
    network = {
        "keywords": F.col("keywords"), "start": text(F.col("page") * 25), "sortBy": F.when(recent, "DD").otherwise("R"), "location": F.col("location"),
        "f_TPR": seconds, "f_JT": _codes(F.col("job_type"), TYPE_CODES), "f_WT": _codes(F.col("workplace_type"), WORKPLACE_CODES),
        "f_E": _codes(F.col("experience_level"), EXPERIENCE_CODES), "f_SB2": literal_map(SALARY_CODES)[F.col("salary")],
        "f_VJ": F.when(F.col("has_verification"), "true"), "f_EA": F.when(F.col("under_10_applicants"), "true")}
    plain = lambda values: F.array_join(F.transform(values, lambda v: F.replace(v, F.lit("on_site"), F.lit("onsite"))), ",")
    search = {
        "q": F.col("keywords"), "limit": text(F.col("limit")), "offset": text(F.col("page") * F.col("limit")),
        "posted_within_days": text(date_days(F.col("date_since_posted"), F.col("posted_within_days"))), "sort": F.when(recent, "posted_at"),
        "order": F.when(recent, "desc"), "work_mode": plain(F.col("workplace_type")), "employment_type": plain(F.col("job_type"))}

    def params(fields: dict) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    requests = F.array(F.struct(F.lit("linkedin").alias("source"), params(network).alias("params")),
                       F.struct(F.lit("freehire").alias("source"), params(search).alias("params")))
    return queries.select("query_id", F.explode(requests).alias("r")).select("query_id", "r.*")
