"""Payload, page, search and merge jobs over documents, pages, benchmark and orders (S*, N*, F*, D*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitweave.functions import constants as K
from fitweave.functions import html as H
from fitweave.functions import urls as U
from fitweave.functions.text import distinct_ignoring_case, let
from fitweave.operators import match as M
from fitweave.operators import merge as D
from fitweave.operators import normalize as N
from fitweave.sources import boards as B
from fitweave.sources import companies as C
from fitweave.workloads import sql as Q
from fitweave.workloads.inputs import table
from fitweave.session import own, step_folder
from fitweave.workloads.texts import pick, pick_sql

AS_OF = "2024-02-01 00:00:00"
PLACES = ["Berlin, Germany", "Paris", "", "Amsterdam,  Netherlands", "Berlin", "Remote Germany", "New York, US"]
TYPES = ["full_time", "contract", "", "part_time", "internship"]
ARRANGEMENTS = ["remote", "hybrid", "on_site", ""]
NULL = "CAST(NULL AS VARCHAR)"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.expr("doc_id div 25").alias("part"))


def companies(spark, sf_dir) -> DataFrame:
    rows = docs(spark, sf_dir).select("source").distinct()
    return rows.select(F.explode(F.array(*[F.lit(s) for s in ("greenhouse", "lever", "ashby")])).alias("ats_type"),
                       F.concat("source", F.lit("-0")).alias("board_slug"), F.concat(F.lit("Co "), "source").alias("name"))


def _payloads(spark, sf_dir, source: str, record, wrap) -> DataFrame:
    """Boards of at most 25 documents each, one payload per board; every 19th record is null."""
    rows = docs(spark, sf_dir).withColumn("board", F.concat_ws("-", "source", "part"))
    record = F.when(F.col("doc_id") % 19 > 0, record)
    packed = rows.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("rs"))
    records = F.transform("rs", lambda x: x["r"])
    return packed.select(F.lit(source).alias("source"), "board", wrap(records).alias("payload"))


def _escape(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def greenhouse_rows(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    record = F.struct(
        F.when(d % 17 > 0, F.concat(F.lit("  Role "), d)).alias("title"), F.when(d % 3 > 0, F.concat(F.lit("Firm "), "source")).alias("company_name"),
        F.struct(pick(PLACES, d).alias("name")).alias("location"), F.when(d % 13 > 0, F.concat(F.lit("https://jobs.example.com/"), d)).otherwise("ftp://x/1").alias("absolute_url"),
        F.when(d % 5 > 0, d).alias("id"), F.when(d % 4 > 0, F.lit("2024-01-15T10:00:00Z")).alias("first_published"), F.lit("2020").alias("updated_at"),
        _escape(F.concat(F.lit("<p>"), _escape(F.col("text")), F.lit("</p><script>no()</script>"))).alias("content"))
    return B.greenhouse(_payloads(spark, sf_dir, "greenhouse", record, lambda r: F.to_json(F.struct(r.alias("jobs")))), companies(spark, sf_dir))


def lever_rows(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    record = F.struct(
        F.concat(F.lit("Role "), d).alias("text"), d.alias("id"), F.when(d % 11 > 0, F.concat(F.lit("https://jobs.example.com/"), d)).alias("hostedUrl"),
        F.when(d % 22 > 0, F.concat(F.lit("https://apply.example.com/"), d)).alias("applyUrl"), F.when(d % 4 > 0, F.lit(1700000000000) + d * 86400500).alias("createdAt"),
        pick(["Remote", "On-site", "hybrid", "moon"], d).alias("workplaceType"), F.when(d % 2 == 0, _escape(F.col("text"))).alias("descriptionPlain"), F.concat(F.lit("<b>"), _escape(F.col("text")), F.lit("</b> body")).alias("description"),
        F.when(d % 3 == 0, F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>One</li><li>Two &amp; more</li>").alias("content")))).alias("lists"), F.lit("End").alias("additional"),
        F.struct(F.when(d % 2 == 0, F.array(pick(PLACES, d), F.lit("Rome"))).alias("allLocations"), F.lit("Oslo").alias("location"), pick(["Full-time", "Part time", "Intern", "Gig"], d).alias("commitment")).alias("categories"))
    return B.lever(_payloads(spark, sf_dir, "lever", record, F.to_json), companies(spark, sf_dir))


def ashby_rows(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    record = F.struct(
        F.concat(F.lit("Role "), d).alias("title"), F.when(d % 2 == 0, F.concat(F.lit("https://jobs.example.com/"), d)).alias("jobUrl"), F.concat(F.lit("https://user@apply.example.com/"), d).alias("applyUrl"),
        F.lit("Oslo").alias("location"), F.when(d % 3 == 0, F.array(F.struct(F.lit("Bergen").alias("location")))).alias("secondaryLocations"), pick(["", "Hybrid", "OnSite"], d).alias("workplaceType"),
        (d % 2 == 0).alias("isRemote"), F.when(d % 7 == 0, F.lit(False)).alias("isListed"), F.lit("FullTime").alias("employmentType"), F.concat(F.lit("<p>A</p><p>"), _escape(F.col("text")), F.lit("</p>")).alias("descriptionHtml"), F.lit("2024-01-02").alias("publishedAt"))
    return B.ashby(_payloads(spark, sf_dir, "ashby", record, lambda r: F.to_json(F.struct(r.alias("jobs")))), companies(spark, sf_dir))


def freehire_payloads(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    record = F.struct(
        F.concat(F.lit("Role "), d).alias("title"), F.col("source").alias("company"), pick(PLACES, d).alias("location"), F.concat(F.lit("https://jobs.example.com/"), d).alias("url"),
        F.concat(F.lit("s"), d).alias("public_slug"), _escape(F.col("text")).alias("description"), F.lit("2024-01-02").alias("posted_at"), F.when(d % 6 == 0, F.lit("2024-01-20")).alias("closed_at"),
        F.lit("onsite").alias("work_mode"), F.when(d % 2 == 0, F.lit("contract")).alias("employment_type"), F.struct(F.lit("volunteer").alias("employment_type")).alias("enrichment"))
    rows = _payloads(spark, sf_dir, "freehire", record, lambda r: F.to_json(F.struct(r.alias("data"))))
    part = F.substring_index("board", "-", -1).cast("int")
    meta = F.when(part % 4 == 1, '"meta":{"total":-1}').when(part % 4 == 2, '"meta":{"total":9,"ignored_params":["x"]}').otherwise('"meta":{"total":9,"ignored_params":[]}')
    body = F.concat(F.lit("{"), meta, F.lit(","), F.substring("payload", 2, 1000000000))
    return rows.withColumn("payload", F.when(part % 4 == 3, F.replace(body, F.lit('"data"'), F.lit('"rows"'))).otherwise(body))


def tabular_rows(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("indeed").alias("source"), F.col("o_orderstatus").alias("board"), o.cast("int").alias("rec_no"), F.when(o % 9 > 0, F.concat(F.lit("Role "), o)).otherwise("nan").alias("title"),
        F.col("o_orderpriority").alias("company"), pick(PLACES, o).alias("location"), F.concat(F.lit("https://jobs.example.com/"), o).alias("job_url"),
        F.when(o % 2 == 0, F.concat(F.lit("in-"), o)).otherwise(" None ").alias("id"), F.lit(None).cast("string").alias("description"), F.to_date("o_orderdate").cast("string").alias("date_posted"),
        pick(["fulltime", "contract", "odd"], o).alias("job_type"), F.lit("EUR").alias("currency"), F.when(o % 5 > 0, F.lit("yearly")).alias("interval"),
        F.when(o % 3 > 0, F.col("o_totalprice").cast("int")).alias("min_amount"), F.when(o % 4 > 0, F.col("o_totalprice").cast("int") + 1000).alias("max_amount"), (o % 2 == 0).alias("is_remote"))
    return B.tabular(rows)


def _shown(rows):
    return rows.select("board", "rec_no", "job_id", "title", "company", F.coalesce("location", F.lit("-")).alias("location"), "application_url",
                       F.md5(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce("posted_at", F.lit("-")).alias("posted_at"),
                       F.coalesce("employment_type", F.lit("-")).alias("employment_type"), F.coalesce("workplace_type", F.lit("-")).alias("workplace_type"),
                       F.coalesce("salary", F.lit("-")).alias("salary"))


def s1(spark, sf_dir):
    return _shown(B.accepted(greenhouse_rows(spark, sf_dir)))


def s2(spark, sf_dir):
    return _shown(B.accepted(lever_rows(spark, sf_dir)))


def s3(spark, sf_dir):
    return _shown(B.accepted(ashby_rows(spark, sf_dir)))


def s4(spark, sf_dir):
    return _shown(B.accepted(B.freehire(freehire_payloads(spark, sf_dir))))


def s4_problems(spark, sf_dir):
    return freehire_payloads(spark, sf_dir).select("board", B.envelope_problem(F.col("payload")).alias("problem"))


def s4_accounting(spark, sf_dir):
    """Three of four boards answer with an envelope that cannot be used."""
    return B.accounting(B.freehire(freehire_payloads(spark, sf_dir))).select("board", "kept", "skipped", "unread", F.coalesce("error", F.lit("-")).alias("error"), "status")


def s5(spark, sf_dir):
    return _shown(B.accepted(tabular_rows(spark, sf_dir)))


def s6(spark, sf_dir):
    return B.rejected(greenhouse_rows(spark, sf_dir)).select("board", "rec_no", "reject")


def s7(spark, sf_dir):
    return B.accounting(greenhouse_rows(spark, sf_dir), date_filter=True).select("board", "kept", "skipped", "undated", F.array_join("warnings", "|").alias("warnings"), "status")


def s7_observed(spark, sf_dir):
    """Totals that the write of the postings has observed, beside the rows it wrote."""
    folder = _folder(spark, "postings")
    seen = B.write_postings(greenhouse_rows(spark, sf_dir), folder, date_filter=True)
    written = spark.read.parquet(folder).agg(F.count("*").alias("written"))
    return written.select("written", *[F.lit(seen[c]).cast("bigint").alias(c) for c in ("kept", "skipped", "undated", "unread")])


def s8(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return C.company_conflicts(part.select(F.concat_ws("-", "p_name", "p_brand").alias("slug"), F.col("p_type").alias("ats_type"), F.concat_ws("-", "p_name", "p_brand").alias("board_slug")))


def _folder(spark, label: str) -> str:
    path = f"{step_folder(spark)}/{label}-{uuid.uuid4().hex}"
    own(path)
    return path


def s8_file(spark, sf_dir):
    """Customers written as the company file of a registry, with blanks, quotes and commas, and read from there."""
    firms = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" c-"), "c_custkey").alias("slug"), F.concat("c_name", F.lit(', "the" firm ')).alias("name"), F.concat(F.lit("  "), "c_mktsegment").alias("industry"),
        pick(["greenhouse", "lever ", " ashby"], F.col("c_custkey")).alias("ats_type"), F.concat("c_name", F.lit(" ")).alias("board_slug"), pick([" nl", "de "], F.col("c_custkey")).alias("country"), F.lit("x").alias("hq_location"))
    folder = _folder(spark, "companies")
    firms.write.csv(folder, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return C.read_companies(spark, folder).drop("hq_location")


def s12_files(spark, sf_dir):
    """Pages written as text files of many lines and read as whole files of some kind."""
    folder = _folder(spark, "documents")
    table(spark, sf_dir, "pages").select(F.regexp_replace("html", r"\s+", " ")).write.text(folder)
    files = C.read_documents(spark, folder)
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x != "")
    return files.select("kind", F.explode(lines).alias("line")).select("kind", F.md5("line").alias("line"))


def s14_files(spark, sf_dir):
    """The report as it stands in its files."""
    page, folder = M.page_of(M.first_per_job(hits(spark, sf_dir)), search_queries(spark, sf_dir)), _folder(spark, "report")
    C.write_report(page, M.roll_up(source_status(spark, sf_dir)), folder)
    shown = spark.read.schema("query_id bigint, posting_id bigint").json(f"{folder}/hits").groupBy("query_id").agg(F.count("*").alias("written"))
    told = spark.read.schema("query_id bigint, status string, exit_code int, returned bigint").json(f"{folder}/report")
    return told.join(shown, "query_id", "left").select("query_id", "status", "exit_code", "returned", F.coalesce("written", F.lit(0)).cast("bigint").alias("written"))


def s9(spark, sf_dir):
    firms = table(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey")).alias("slug"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), pick(["1", " 07", "C-1", "machinery customer", "x", "", "Customer#00000010"], F.col("s_suppkey")).alias("query"))
    return C.search_companies(firms, wanted)


def career_links(spark, sf_dir) -> DataFrame:
    p = F.col("page_id")
    path = U.path(F.col("url"))
    hosts = ["https://boards.greenhouse.io", "job-boards.greenhouse.io", "https://api.lever.co/v0/postings", "https://jobs.eu.lever.co", "https://acme.wd5.myworkdayjobs.com",
             "https://www.recruitee.com", "https://user@boards.greenhouse.io", "https://jobs.ashbyhq.com:8443", "https://beta.workable.com:443", "https://api.lever.co/other", "https://boards.greenhouse.io.evil.test"]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(pick(hosts, p), path, F.when(p % 3 == 0, F.lit("?next=https://x.test")).otherwise("")).alias("career_url"))


def s10(spark, sf_dir):
    return C.detect_board(career_links(spark, sf_dir)).select("page_id", "system", "board", F.col("searchable").cast("int").alias("searchable"))


def s12(spark, sf_dir):
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/a"), p, pick([".pdf", ".DOCX", ".txt", ".bin", ".md", "", ".doc"], p)).alias("path"),
                                                F.concat(pick(["%PDF-1.7 ", "PK", ""], p), F.col("html")).cast("binary").alias("content"))
    return rows.groupBy(C.document_kind(F.col("path"), F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


# --- pages ---------------------------------------------------------------------

#: A last paragraph of each page, as written and as read after the three passes: odd numbers, names without semicolon, nested references.
REFERENCES = [
    ("fee &#8364;5", "fee \u20ac5"), ("&#x80;9", "\u20ac9"), ("&#9999999;!", "\ufffd!"), ("&#xD800;&#xFFFFFF;?", "\ufffd\ufffd?"), ("&#0;0", "\ufffd0"), ("R&ampD", "R&D"), ("&copy2024", "\u00a92024"),
    ("&notit;", "\u00acit;"), ("&#38;amp;amp;lt; deep", "&lt; deep"), ("&hearts;&zzz;", "\u2665&zzz;"), ("&#1;x&#xFFFE;y", "xy"), ("&nbsp x", "x"), ("&am<b>p;</b>", "&amp;"), ("&", "&"),
]


def n1(spark, sf_dir):
    written = F.concat("html", F.lit("<p>"), pick([w for w, _ in REFERENCES], F.col("page_id")), F.lit("</p>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.plain_text(written)).alias("text"))


def structured_pages(spark, sf_dir) -> DataFrame:
    """Pages of documents: a decoy script, then JobPosting blocks as object, list or graph."""
    d = F.col("doc_id")
    posting = F.to_json(F.struct(
        F.when(d % 5 > 0, F.lit("JobPosting")).otherwise("Organization").alias("@type"), F.when(d % 4 > 0, F.concat(F.lit("<p>About the job: "), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</p>"))).alias("description"),
        pick(["FULL_TIME", "PART_TIME", "Contractor · x", "other"], d).alias("employmentType"), F.when(d % 3 == 0, F.lit("TELECOMMUTE")).alias("jobLocationType"), F.when(d % 2 == 0, d % 4 == 0).alias("directApply")))
    second = F.lit('{"@type":["Thing","JobPosting"],"description":"too short","employmentType":["INTERN","x"],"directApply":true}')
    body = F.when(d % 3 == 0, F.concat(F.lit('{"@graph":['), posting, F.lit(","), second, F.lit("]}"))).when(
        d % 3 == 1, F.concat(F.lit("["), second, F.lit(","), posting, F.lit("]"))).otherwise(posting)
    return docs(spark, sf_dir).select(d.alias("page_id"), F.concat(
        F.lit('<html><script type="text/javascript">var x="JobPosting";</script><script type="application/ld+json">not json</script><script type="application/ld+json">'),
        body, F.lit("</script></html>")).alias("html"))


def n2(spark, sf_dir):
    return N.structured_fields(structured_pages(spark, sf_dir)).select(
        "page_id", F.md5("description").alias("description"), "employment_type", "workplace_type", F.col("easy_apply").cast("int").alias("easy_apply"))


def n3(spark, sf_dir):
    p = F.col("page_id")
    marker = pick(['<div class="card base-search-card x">', "<li><h3 class='base-search-card__title'>", 'Please pass the Security Verification', '<input name="session_key">', "No matching jobs", ""], p)
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"(https?)", 1).alias("source"), F.when(p % 10 == 9, F.lit(" ")).otherwise(F.concat(marker, F.col("html"))).alias("html"))
    return N.outcome_counts(pages).select("source", "outcome", F.col("count").alias("n"))


def n4(spark, sf_dir):
    o = F.col("o_orderkey")
    text = F.concat(pick(["Full-time", "Part_time · Remote", "On-site, Intern", "Contractor | hybrid", "tele commute", "Odd"], o), pick(["", " · Volunteer", ", ON_SITE"], o))
    row = N.labels_from_text(text, structured=True)
    one = pick(["Full-Time", "ON SITE", "remote", " nan ", "Intern ship", "part_time"], o)
    return table(spark, sf_dir, "orders").select("o_orderkey", row["employment_type"].alias("employment"), row["workplace_type"].alias("workplace"),
                                                 B.employment_type(one).alias("type_label"), B.workplace_type(one).alias("place_label"))


def n5(spark, sf_dir):
    p = F.col("page_id")
    link = pick(["https://www.linkedin.com/safety?url=https%3A%2F%2FJobs.Example.com%2Fa%3Fb%3D1", "<!--https://Firm.example.com/x?y=1#z-->", "https://www.linkedin.com/jobs/1", "mailto:x@y.z", ""], p)
    row = N.apply_mode(pick(["public_jobs_EASY_APPLY", "offsite-apply", "", "easyapply"], p), pick(["Easy Apply now", "Eenvoudig-solliciteren", "Apply"], p), F.nullif(link, F.lit("")), F.when(p % 7 == 0, False))
    return table(spark, sf_dir, "pages").select("page_id", row["easy_apply"].cast("int").alias("easy_apply"), row["external_apply_url"].alias("external"))


def n6(spark, sf_dir):
    text = F.concat(pick(["About the job\n: ", "ABOUT THE JOB - ", "", "  "], F.col("doc_id")), F.when(F.col("doc_id") % 5 == 0, F.left("text", F.lit(18))).otherwise(F.col("text")))
    return docs(spark, sf_dir).select("doc_id", F.md5(H.clean_description(text)).alias("description"))


def _enriched(spark, sf_dir):
    d = F.col("doc_id")
    postings = docs(spark, sf_dir).select("source", d.alias("job_id"), F.when(d % 2 == 0, F.col("text")).alias("description"), F.lit("contract").alias("employment_type"))
    details = N.structured_fields(structured_pages(spark, sf_dir)).withColumnRenamed("page_id", "job_id").select("job_id", "description", "employment_type")
    return N.enrich(postings, details)


def n7(spark, sf_dir):
    return _enriched(spark, sf_dir).select("source", "job_id", F.md5("description").alias("description"), "employment_type")


def n7_counts(spark, sf_dir):
    return N.description_counts(_enriched(spark, sf_dir))


def n8(spark, sf_dir):
    p = F.col("page_id")
    link = F.when(p % 6 == 0, F.replace("url", F.lit("://"), F.lit("://me:pw@"))).when(p % 6 == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).when(p % 6 == 2, F.lit("https:///x")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.is_web_url(link).cast("int").alias("safe"))


def _links(spark, sf_dir):
    p = F.col("page_id")
    extra = F.when(p % 4 == 0, F.concat(F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("z=1&utm_medium=x&A=b&empty=&trk=7&PageNum=3"))).otherwise("")
    bare = F.regexp_replace("url", "#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.initcap(F.regexp_extract(bare, "^([a-z]+)", 1)), F.regexp_replace(bare, "^[a-z]+", ""), extra, F.lit("#part")).alias("url"))


def n9(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


def n10(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", U.workspace_url(F.col("url")).alias("link"))


def n11(spark, sf_dir):
    d = F.col("doc_id")
    rows = docs(spark, sf_dir).select(
        F.when(d % 12 > 0, F.concat(F.lit(" "), F.col("source"), F.lit(" x"))).alias("source"), F.concat(F.lit("a/b "), d).alias("job_id"), F.when(d % 7 > 0, F.left("text", F.lit(600))).alias("title"),
        F.when(d % 11 > 0, F.lit("Firm")).alias("company"), F.when(d % 5 > 0, F.lit("https://x.example.com/1")).otherwise("javascript:x").alias("application_url"), F.lit("  ").alias("location"), F.col("text").alias("description"),
        pick(ARRANGEMENTS, d).alias("workplace_type"), pick(TYPES, d).alias("employment_type"), F.when(d % 2 == 0, F.lit("pasted")).alias("description_source"),
        F.array(F.lit("Go "), F.lit("Go"), F.col("source"), F.lit("")).alias("skills"), (F.pmod(d, F.lit(5)) - 1).cast("double").alias("match_score"))
    out = N.sanitise_postings(rows)
    return out.select("id", F.md5("title").alias("title"), F.md5("description").alias("description"), F.coalesce("location", F.lit("-")).alias("location"),
                      "workplace_type", "employment_type", "description_source", F.array_join("skills", "|").alias("skills"), "match_score", "reason")


def n11_requests(spark, sf_dir):
    d = F.col("doc_id")
    rows = docs(spark, sf_dir).select(d.alias("request_id"), F.when(d % 9 > 0, F.lit(" Ann ")).alias("name"), F.when(d % 8 > 0, F.lit("Dev")).alias("title"), F.lit("Firm").alias("company"),
                                      F.when(d % 7 > 0, F.col("text")).otherwise(" short ").alias("description"), F.array(F.lit("Go"), F.lit(" go "), F.col("source")).alias("skills"), (d % 90).cast("double").alias("years_experience"))
    return N.sanitise_requests(rows).select("request_id", F.md5("description").alias("description"), F.array_join("skills", "|").alias("skills"), "years_experience", "reason")


def raw_requests(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("query_id"), F.when(o % 10 > 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("keywords"), F.when(o % 20 == 0, F.lit("fallback")).alias("keyword"),
        pick(PLACES, o).alias("location"), pick(["Past Week", "24h", "any", "past-month", "later"], o).alias("dateSincePosted"), pick(["", "7", "400", "30"], o).alias("postedWithinDays"),
        pick(["full time", "Contract, part-time,contract", "", "gig"], o + 1).alias("job_type"), pick(["remote", "on site,hybrid"], o).alias("remoteFilter"), pick(["", "60000", "70000"], o + 2).alias("salary"),
        pick(["Recent", "relevant"], o).alias("sortBy"), pick(["10", "25", "500"], o + 1).alias("limit"), pick(["0", "3"], o).alias("page"), F.when(o % 6 == 0, pick(["1", "2", "9"], o)).alias("f_WT"),
        F.when(o % 3 == 0, F.lit("true")).alias("has_verification"))


def n12(spark, sf_dir):
    out = N.normalise_requests(raw_requests(spark, sf_dir))
    return out.select("query_id", "keywords", "date_since_posted", "posted_within_days", F.array_join("job_type", ",").alias("job_type"), F.array_join("workplace_type", ",").alias("workplace_type"),
                      "salary", "sort_by", "limit", "page", F.col("has_verification").cast("int").alias("has_verification"), "reason")


def n13(spark, sf_dir):
    good = N.normalise_requests(raw_requests(spark, sf_dir)).where("reason is null")
    rows = N.source_requests(good)
    entries = F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("query_id", "source", F.array_join(entries, "&").alias("params"))


# --- searches --------------------------------------------------------------------

def search_postings(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    words = F.split("text", " ")
    return docs(spark, sf_dir).select(
        d.alias("posting_id"), "source", F.expr("doc_id div 2").cast("string").alias("job_id"), d.alias("ord"), F.concat_ws(" ", F.slice(words, 1, 3)).alias("title"), F.upper("source").alias("company"),
        F.nullif(pick(PLACES, d), F.lit("")).alias("location"), F.col("text").alias("description"), F.nullif(pick(TYPES, d), F.lit("")).alias("employment_type"),
        F.nullif(pick(ARRANGEMENTS, d), F.lit("")).alias("workplace_type"), F.when(d % 4 > 0, F.date_add(F.lit("2023-12-20").cast("date"), F.pmod(d, F.lit(45)).cast("int")).cast("string")).alias("posted_at"))


def search_queries(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    w = F.split("text", " ")
    at = lambda n: F.get(w, F.lit(n))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.concat(F.lit('"'), at(0), F.lit(" "), at(1), F.lit('" OR '), at(2), F.lit(" "), at(3), F.lit("  OR "), at(4), F.lit(' "'), at(5), F.lit('"')).alias("keywords"),
        F.nullif(pick(["", "Berlin", "germany, berlin", "", "Paris"], i), F.lit("")).alias("location"), F.lit(None).cast("string").alias("career_url"), pick(["any", "past_week", "past_month", "24hr"], i).alias("date_since_posted"),
        F.when(i % 9 == 0, 20).alias("posted_within_days"), F.when(i % 3 == 0, F.array(F.lit("full_time"), F.lit("contract"))).alias("job_type"), F.when(i % 5 == 0, F.array(F.lit("remote"))).alias("workplace_type"),
        F.when(i % 7 == 0, F.array(F.lit("senior"))).alias("experience_level"), F.when(i % 6 == 0, 60000).alias("salary"), F.when(i % 2 == 0, "recent").otherwise("relevant").alias("sort_by"),
        (F.pmod(i, F.lit(4)) + 3).cast("int").alias("limit"), (i % 2).cast("int").alias("page"), (i % 8 == 0).alias("has_verification"), F.lit(False).alias("under_10_applicants"))


def f1(spark, sf_dir):
    return M.keyword_matches(search_queries(spark, sf_dir), search_postings(spark, sf_dir))


def f1_grams(spark, sf_dir):
    """The same pairs by the plan for many distinct terms."""
    return M.keyword_matches(search_queries(spark, sf_dir), search_postings(spark, sf_dir), most_terms=0)


def hits(spark, sf_dir) -> DataFrame:
    return M.matches(search_queries(spark, sf_dir), search_postings(spark, sf_dir), AS_OF)


def f_matches(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "posting_id")


def d1(spark, sf_dir):
    return M.first_per_job(hits(spark, sf_dir)).select("query_id", "source", "job_id", "posting_id")


def d4(spark, sf_dir):
    return M.page_of(M.first_per_job(hits(spark, sf_dir)), search_queries(spark, sf_dir)).select("query_id", "place", "posting_id")


def d4_counts(spark, sf_dir):
    return M.page_counts(M.first_per_job(hits(spark, sf_dir)), search_queries(spark, sf_dir))


def _chosen(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(s) for s in ("greenhouse", "freehire", "indeed", "linkedin")])).alias("source"))


def f5(spark, sf_dir):
    rows = M.unsupported_filters(search_queries(spark, sf_dir), _chosen(spark, sf_dir))
    return rows.select("query_id", "source", F.array_join("filters", ",").alias("filters"))


def source_status(spark, sf_dir) -> DataFrame:
    bad = M.unsupported_filters(search_queries(spark, sf_dir), _chosen(spark, sf_dir))
    rows = _chosen(spark, sf_dir).join(bad, ["query_id", "source"], "left")
    error = F.when(F.col("filters").isNotNull(), F.concat(F.lit("cannot apply "), F.array_join("filters", ", ")))
    warned = (F.col("query_id") % 3 == 0) & (F.col("source") == "freehire")
    return rows.select("query_id", "source", F.when(error.isNotNull(), "error").when(warned, "partial").otherwise("ok").alias("status"), error.alias("error"),
                       F.when(warned, F.array(F.lit("Skipped 2 closed or invalid listings."))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def d6(spark, sf_dir):
    rows = M.roll_up(source_status(spark, sf_dir))
    return rows.select("query_id", "status", F.array_join("warnings", "|").alias("warnings"), F.array_join("errors", "|").alias("errors"))


def s14(spark, sf_dir):
    page = M.page_of(M.first_per_job(hits(spark, sf_dir)), search_queries(spark, sf_dir))
    return C.report(page, M.roll_up(source_status(spark, sf_dir))).select("query_id", "status", "exit_code", "returned")


def f7(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"),
                                                  F.nullif(pick(PLACES, F.col("o_orderkey")), F.lit("")).alias("location"), F.array(F.lit("Go"), F.col("o_orderpriority")).alias("skills"), pick(ARRANGEMENTS, F.col("o_orderkey")).alias("workplace_type"))
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")).distinct().join(
        saved.select("profile_id", "job_id"), "job_id")
    return M.shortlist_filter(saved, gone, "remote", "GERMANY Go 1-URG").select("profile_id", "job_id")


def f8(spark, sf_dir):
    links = career_links(spark, sf_dir).select(F.col("page_id").alias("query_id"), "career_url")
    chosen = links.where("query_id % 2 = 0").select("query_id", F.when(F.col("query_id") % 4 == 0, " Greenhouse").otherwise("lever").alias("source"))
    return M.route_queries(links, chosen)


# --- merge --------------------------------------------------------------------------

def d2(spark, sf_dir):
    rows = search_postings(spark, sf_dir).select("posting_id", "source", "ord")
    both = D.ordered_union([rows.where("source = 'src3'"), rows.where("source = 'src1'"), rows.where("source not in ('src1', 'src3')")])
    return both.select("posting_id", "source", "source_ord", "ord")


def d3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("url", r"/(\d+)", 1).cast("int").alias("nr"), U.canonical_url(F.col("url")).alias("link"))
    rows = pages.select("ord", F.concat(F.lit("id"), F.col("nr") % 97).alias("identity"), F.regexp_replace("link", r"^https?://[^/]*/(..)/.*?(\d)\D*$", "$1$2").alias("url"))
    # some rows lack one key, some both
    rows = rows.withColumn("identity", F.when(F.col("ord") % 10 > 0, F.col("identity"))).withColumn("url", F.when(F.col("ord") % 15 > 0, F.col("url")))
    return D.greedy_dedup(rows).select("ord", "identity", "url")


def _catalogues(spark, sf_dir):
    d = F.col("doc_id")
    rows = docs(spark, sf_dir).select((d % 401).alias("id"), d.alias("ord"), F.col("text").alias("description"), F.when(d % 3 == 0, "pasted").otherwise("source").alias("description_source"),
                                      F.array("source").alias("skills"), F.upper("source").alias("translated_description"), F.lit("title").alias("title"))
    existing = rows.where("ord % 2 = 0").groupBy("id").agg(F.max_by(F.struct("description", "description_source", "skills", "translated_description", "title"), "ord").alias("r")).select("id", "r.*")
    incoming = rows.where("ord % 2 = 1 and id % 4 > 0").withColumn("title", F.concat(F.lit("new "), F.col("ord")))
    return existing, incoming, existing.where("id % 5 = 0").select("id")


def d7(spark, sf_dir):
    rows = D.upsert_catalogue(*_catalogues(spark, sf_dir))
    return rows.select("id", F.md5("description").alias("description"), "description_source", F.array_join("skills", "|").alias("skills"), "translated_description", "title")


def d8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("application_url"))
    added = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_replace("application_url", r"[?#].*$", ""), F.lit("?utm_source=mail#x"))).otherwise(
        F.concat(F.regexp_replace("application_url", r"[?#].*$", ""), F.lit("?id=9"))).alias("application_url"))
    return D.new_links(added, pages).select("page_id")


def _firsts(words):
    """First spellings of (i, w) words, ignoring case, in order."""
    ranked = F.sort_array(F.transform(words, lambda x: F.struct(F.lower(x["w"]).alias("k"), x.alias("x"))))
    firsts = let(ranked, lambda r: F.filter(r, lambda x, j: ~F.get(r, j - 1)["k"].eqNullSafe(x["k"])))
    return F.sort_array(F.transform(firsts, lambda x: x["x"]))


def d9(spark, sf_dir):
    """Whole texts in both forms: words grouped per document, and the column form.

    Texts meet once by document; their words are taken apart after that.
    """
    def flat(row):
        return F.replace(row["text"], F.lit("\n"), F.lit(" "))

    def words(row):
        return F.filter(F.transform(F.split(flat(row), " "), lambda w, i: F.struct(i.alias("i"), F.trim(w).alias("w"))), lambda x: x["w"] != "")

    rows = docs(spark, sf_dir).where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("text")).alias("rows"))
    rows = rows.where(F.exists("rows", lambda row: F.trim(flat(row)) != ""))
    every = F.flatten(F.transform(F.filter("rows", lambda row: row["text"].isNotNull()), words))
    every = F.md5(F.array_join(F.transform(let(every, _firsts), lambda x: x["w"]), "|"))
    first = F.transform("rows", lambda row: F.array_join(distinct_ignoring_case(F.split(flat(row), " "), 8), "|"))
    return rows.select("doc_id", every.alias("words"), F.explode(first).alias("first"))


def _crawl(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.expr("event_id div 100 % 12").cast("int").alias("page"), e.alias("place"),
                                                 F.when(F.expr("event_id div 100 % 12") == F.col("user_id") % 12, 7).otherwise(e % 53).cast("string").alias("job_id"))


def d10(spark, sf_dir):
    return D.crawl_pages(_crawl(spark, sf_dir)).select("query_id", "page", "n_rows", "n_new", F.col("stopped").cast("int").alias("stopped"))


def d10_results(spark, sf_dir):
    rows = _crawl(spark, sf_dir)
    limits = rows.select("query_id").distinct().select("query_id", (F.col("query_id") % 9 + 2).cast("int").alias("limit"))
    return D.crawl_results(rows, limits).select("query_id", "rank", "job_id", "page")


QUERIES = {
    "s1_greenhouse": s1, "s2_lever": s2, "s3_ashby": s3, "s4_freehire": s4, "s4_envelopes": s4_problems, "s4_accounting": s4_accounting, "s5_tabular": s5, "s6_rejects": s6, "s7_accounting": s7, "s7_observed_totals": s7_observed,
    "s8_company_conflicts": s8, "s8_company_file": s8_file, "s9_company_search": s9, "s10_career_links": s10, "s12_document_kinds": s12, "s12_document_files": s12_files, "s14_report": s14, "s14_report_files": s14_files,
    "n1_plain_text": n1, "n2_structured_pages": n2, "n3_page_outcomes": n3, "n4_labels": n4, "n5_apply_mode": n5, "n6_descriptions": n6, "n7_enrichment": n7, "n7_description_counts": n7_counts,
    "n8_url_safety": n8, "n9_canonical_url": n9, "n10_workspace_url": n10, "n11_sanitised_postings": n11, "n11_sanitised_requests": n11_requests, "n12_requests": n12, "n13_source_requests": n13,
    "f1_keywords": f1, "f1_keywords_by_grams": f1_grams, "f1_f4_matches": f_matches, "f5_unsupported_filters": f5, "f7_shortlist_filter": f7, "f8_routing": f8,
    "d1_first_per_job": d1, "d2_ordered_union": d2, "d3_greedy_dedup": d3, "d4_d5_pages": d4, "d4_next_page": d4_counts, "d6_roll_up": d6, "d7_catalogue": d7, "d8_new_links": d8,
    "d9_distinct_ignoring_case": d9, "d10_crawl_pages": d10, "d10_crawl_results": d10_results,
}

from fitweave.workloads.postings_sql import ORACLE  # noqa: E402,F401
