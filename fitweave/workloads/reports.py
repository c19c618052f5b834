"""Letter audit, practice plans and review schedule over conversations, documents, lineitem and events (A*, P*, T*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitweave.functions import constants as K
from fitweave.operators import evidence as R
from fitweave.operators import letters as A
from fitweave.operators import schedule as T
from fitweave.operators import skills as S
from fitweave.plans import learning as P
from fitweave.plans.materials import MATERIALS, materials
from fitweave.session import own, step_folder
from fitweave.streaming import feed, reviews
from fitweave.workloads import skills as WS
from fitweave.workloads import sql as Q
from fitweave.workloads.evidence import word
from fitweave.workloads.inputs import SKILL_DOCUMENTS, skill_documents, skill_text, skill_text_sql, table
from fitweave.workloads.texts import pick, pick_sql


# --- letters: assistant turns; facts: the user turn before -------------------

def letter_rows(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", spread=True)
    letters = turns.where("role = 'assistant'")
    tail = pick(["", " [Company name]", " Increased revenue by 12%.", " I am writing to you. Improved data accuracy in 2021.", " {{name}}"], F.col("conv_id"))
    facts = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), skill_text(F.col("text")).alias("facts"))
    rows = letters.join(facts, ["conv_id", "turn"], "left")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("letter_id"), "conv_id", "turn",
                       F.concat(skill_text(F.col("text")), tail).alias("letter"), F.coalesce("facts", F.lit("")).alias("facts"),
                       F.when(F.col("conv_id") % 2 == 0, "concise").otherwise("standard").alias("length"))


def _named(rows: DataFrame, text: str) -> DataFrame:
    """(letter_id, ord, name): canonical tools of a text column."""
    found = rows.select("letter_id", F.posexplode(S.base_mentions(F.col(text))).alias("ord", "label"))
    return found.groupBy("letter_id", S.canonical_skill(F.col("label")).alias("name")).agg(F.min("ord").alias("ord"))


def letter_gaps(spark, sf_dir) -> DataFrame:
    """Tools of the document with the conversation's number and of the draft, as far as the facts lack them."""
    rows = letter_rows(spark, sf_dir)
    docs = skill_documents(spark, sf_dir).join(rows.select(F.col("conv_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    tools = _named(docs.select(F.col("doc_id").alias("letter_id"), "text"), "text")  # once a document, before it meets its letters
    have = _named(rows, "facts").select("letter_id", "name")
    listing = rows.select("letter_id", "conv_id").join(tools.withColumnRenamed("letter_id", "conv_id"), "conv_id").groupBy("letter_id", "name").agg(
        F.min("ord").alias("ord")).join(have, ["letter_id", "name"], "left_anti")
    draft = _named(rows, "letter").join(have, ["letter_id", "name"], "left_anti")
    return A.all_gaps(listing, draft)


def claims(spark, sf_dir):
    return A.unsupported_claims(letter_rows(spark, sf_dir), letter_gaps(spark, sf_dir)).select("letter_id", "name")


def gap_names(spark, sf_dir):
    return letter_gaps(spark, sf_dir).select("letter_id", "name")


def numbers(spark, sf_dir):
    rows = letter_rows(spark, sf_dir)
    return A.unsupported_numbers(rows.select("letter_id", "letter"), rows.select("letter_id", "facts"))


def marks(spark, sf_dir):
    rows = letter_rows(spark, sf_dir)
    low, high = A.length_band(F.col("length"))
    words = A.word_count(F.col("letter"))
    return rows.select("letter_id", F.array_join(A.unproven_outcomes(F.col("letter"), F.col("facts")), "|").alias("outcomes"),
                       A.has_placeholder(F.col("letter")).cast("int").alias("placeholder"), A.looks_usable(F.col("letter")).cast("int").alias("usable"),
                       words.alias("words"), words.between(low, high).cast("int").alias("within"))


def letter_audit(spark, sf_dir) -> DataFrame:
    rows = letter_rows(spark, sf_dir)
    return A.audit(rows.select("letter_id", "letter", "length"), rows.select("letter_id", "facts"), letter_gaps(spark, sf_dir))


def audit_rows(spark, sf_dir):
    return letter_audit(spark, sf_dir).select("letter_id", F.array_join("issues", "|").alias("issues"), "word_count", "target",
                                              F.col("within_target").cast("int").alias("within_target"))


def revisions(spark, sf_dir):
    issues = letter_audit(spark, sf_dir).select(F.expr("letter_id div 100").alias("letter_id"), (F.col("letter_id") % 100 / 2).cast("int").alias("version"), "issues")
    return A.acceptable_revisions(issues).select("letter_id", "version", "n_added", F.col("acceptable").cast("int").alias("acceptable"))


# --- practice plans ----------------------------------------------------------

def line_requirements(spark, sf_dir) -> DataFrame:
    """Order lines as requirement rows of (customer, order) pairs."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    soft = F.col("l_partkey") % 5 == 0
    missing = F.col("l_returnflag") == "A"
    topics = list(R.SOFT_TOPICS)
    return lines.select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("posting_id"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("ord"),
        F.when(soft, pick(topics, F.col("l_partkey"))).otherwise(pick(S.base_labels(), F.col("l_partkey"))).alias("name"),
        F.when(soft, "soft").otherwise("hard").alias("kind"), pick(["required", "mentioned", "preferred"], F.col("l_linenumber")).alias("priority"),
        F.when(missing, "not_evidenced").otherwise("listed").alias("status"),
        F.when(soft, "rehearsal").when(missing, "foundation").otherwise("refresher").alias("mode"),
        (missing & (F.col("l_linenumber") == 2)).alias("alternative_covered"), F.lit("").alias("job_evidence"), F.lit("").alias("profile_evidence"),
        F.lit("").alias("evidence_source"), F.lit("").alias("req_id"))


def topics(spark, sf_dir):
    rows = P.select_topics(line_requirements(spark, sf_dir))
    return rows.select("profile_id", "posting_id", "bucket", "place", "name", "priority")


def totals(spark, sf_dir):
    rows = line_requirements(spark, sf_dir)
    return P.plan_totals(rows, P.select_topics(rows)).select("profile_id", "posting_id", "lessons", "total_minutes", "remaining_topics")


def lesson_rows(spark, sf_dir):
    """Templates: one recipe per part type's label and per people topic, derived from the part table."""
    part = table(spark, sf_dir, "part")
    recipe = part.where("p_size > 25").select(pick(S.base_labels(), F.col("p_partkey")).alias("recipe")).distinct()
    hard = recipe.select("recipe", F.lit("hard").alias("kind"))
    soft = part.select(pick(list(R.SOFT_TOPICS), F.col("p_partkey")).alias("recipe"), F.lit("soft").alias("kind")).distinct()
    recipes = hard.unionByName(soft).select(
        "recipe", "kind", F.concat(F.lit("About "), "recipe").alias("concept"), F.lit("Why?").alias("diagnostic"),
        F.concat(F.lit("Try "), "recipe").alias("exercise"), F.array(F.lit("It works.")).alias("criteria"),
        F.concat("recipe", F.lit(" guide")).alias("resource_title"), F.concat(F.lit("https://example.com/"), "recipe").alias("resource_url"), F.lit("Read").alias("resource_note"))
    tools = part.where("p_size > 40").select(pick(S.base_labels(), F.col("p_partkey")).alias("name")).distinct().select(
        "name", F.concat("name", F.lit(" manual")).alias("title"), F.concat(F.lit("https://example.org/"), "name").alias("url"), F.lit("Stages").alias("note"))
    rows = P.lessons(P.select_topics(line_requirements(spark, sf_dir)), recipes, tools)
    return rows.select("profile_id", "posting_id", "bucket", "place", "name", "minutes", "title", F.col("has_recipe").cast("int").alias("has_recipe"),
                       F.col("resource.url").alias("url"), F.aggregate("steps", F.lit(0), lambda a, s: a + s["minutes"]).alias("step_minutes"))


def _document_requirements(spark, sf_dir) -> DataFrame:
    rows = skill_documents(spark, sf_dir).select(F.col("doc_id").alias("posting_id"), F.posexplode(S.base_mentions(F.col("text"))).alias("ord", "name"))
    return rows.select((F.col("posting_id") + 1).alias("profile_id"), "posting_id", "ord", "name", F.lit("hard").alias("kind"),
                       F.when(F.col("ord") % 2 == 0, "not_evidenced").otherwise("listed").alias("status"))


def resource_rows(spark, sf_dir):
    docs = skill_documents(spark, sf_dir)
    pairs = docs.select((F.col("doc_id") + 1).alias("profile_id"), F.col("doc_id").alias("posting_id"))
    postings = docs.select(F.col("doc_id").alias("posting_id"), "text")
    return P.rank_resources(pairs, postings, _document_requirements(spark, sf_dir), materials(spark)).select(
        "profile_id", "posting_id", "place", "title", F.col("score").cast("int").alias("score"))


def _observations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"),
                          F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"), F.lit("c3")).alias("criteria"))
    # whole benchmark passages, every one of them quoted for the documents of its residue, and pieces of the document itself
    passages = bench.select(F.col("item_id").alias("slot"), F.col("text").alias("passage"))
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ord")).withColumn(
        "slot", F.pmod(F.col("doc_id") + F.col("ord"), F.lit(bench.count()))).join(passages, "slot", "left")
    own = F.substring(F.col("text"), F.col("ord") * 7 + 1, F.when(F.col("ord") == 3, 260).otherwise(40))
    evidence = F.when(F.col("ord") % 3 == 0, own).when(F.col("ord") % 3 == 1, F.col("passage")).otherwise("")
    status = pick(["demonstrated", "partial", "not_yet", "great"], F.col("doc_id") + F.col("ord"))
    observations = rows.select(F.col("doc_id").alias("answer_id"), "ord", (F.pmod(F.col("ord") * 3 + F.col("doc_id"), F.lit(6)) - 1).cast("int").alias("criterion_index"),
                               status.alias("status"), evidence.alias("evidence"), F.when(F.col("ord") == 6, " ").otherwise("Good").alias("comment"),
                               F.lit("Next").alias("next_step"))
    return answers, observations


def feedback(spark, sf_dir):
    rows = P.grounded_feedback(*_observations(spark, sf_dir))
    return rows.select("answer_id", "criterion_index", "status", F.md5("evidence").alias("evidence"))


def feedback_notes(spark, sf_dir):
    answers, observations = _observations(spark, sf_dir)
    return P.feedback_notes(answers, P.grounded_feedback(answers, observations)).select(
        "answer_id", "kept", F.col("incomplete").cast("int").alias("incomplete"))


# --- schedule ------------------------------------------------------------------

def review_events(spark, sf_dir) -> DataFrame:
    rating = F.when(F.col("value") < 10, "again").when(F.col("value") < 30, "effort").otherwise("independent")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("event_type").alias("skill_id"),
                                                 F.col("ts").cast("timestamp").alias("ts"), "event_id", rating.alias("rating"))


def schedule_days(spark, sf_dir):
    rows = T.review_days(review_events(spark, sf_dir))
    return rows.select("profile_id", "skill_id", F.col("day").cast("string").alias("day"), "recall", "interval_days", "interval_before",
                       F.col("review_on").cast("string").alias("review_on"))


def _state(rows):
    return rows.select("profile_id", "skill_id", "interval_days", "interval_before", F.col("last_reviewed").cast("string").alias("last_reviewed"),
                       F.col("review_on").cast("string").alias("review_on"), "recall")


def schedule_state(spark, sf_dir):
    return _state(T.review_state(review_events(spark, sf_dir)))


def _run_folder(spark, name):
    folder = f"{step_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own(folder)
    return folder


def schedule_stream(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rating = F.when(F.col("value") < 10, "again").when(F.col("value") < 30, "effort").otherwise("independent")
    events = stream.select(F.col("user_id").alias("profile_id"), F.col("event_type").alias("skill_id"),
                           F.col("ts").cast("timestamp").alias("ts"), "event_id", rating.alias("rating"))
    folder = _run_folder(spark, "reviews")
    reviews.start_review_stream(events, f"{folder}/days", f"{folder}/checkpoint").awaitTermination()
    return _state(reviews.current_state(spark, f"{folder}/days"))


def _desk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    skill = pick(["view", "click", "error", "signup", "purchase"], F.col("o_orderkey"))
    applications = orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"),
                                 F.col("o_orderpriority").alias("company"), F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open").alias("status"),
                                 F.date_add(F.to_date("o_orderdate"), 9500).alias("followup"))
    lessons = orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("job_id"), skill.alias("skill_id"), skill.alias("skill"), F.lit(20).alias("minutes"))
    return applications, lessons, T.review_state(review_events(spark, sf_dir)).select("profile_id", "skill_id", "review_on")


def due(spark, sf_dir):
    rows = T.in_due_order(T.due_items(*_desk(spark, sf_dir), as_of="2024-01-31"))
    return rows.select("profile_id", "job_id", F.coalesce("skill_id", F.lit("-")).alias("skill_id"), "title", "detail", F.col("due").cast("string").alias("due"), "action")


def feed_snapshots(documents: DataFrame) -> DataFrame:
    """Every document as a snapshot row; each text is fetched twice, one third with a change, one fifth pasted by hand first."""
    rows = documents.select("source", (F.col("doc_id") / 2).cast("long").cast("string").alias("job_id"), F.col("doc_id").alias("seq"),
                            (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 2).cast("int"))).alias("fetched_at"),
                            F.col("text").alias("description"), F.when(F.col("doc_id") % 5 == 0, "pasted").otherwise("source").alias("description_source"))
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("\u0001", "description", "description_source"), 256))


def posting_feed(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    # a pattern that only the table's own name fits: a stream reads it as a file or as a folder of files
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    folder = _run_folder(spark, "feed")
    feed.start_posting_feed(feed_snapshots(stream), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    rows = feed.catalogue(spark, f"{folder}/rows")
    return rows.select("source", "job_id", F.md5("description").alias("description"), "description_source")


def posting_feed_batch(spark, sf_dir):
    rows = feed.latest_versions(feed_snapshots(table(spark, sf_dir, "documents")))
    return rows.select("source", "job_id", "seq", F.md5("description").alias("description"), "description_source")


def stale_work(spark, sf_dir):
    docs = skill_documents(spark, sf_dir)
    saved = docs.select("doc_id", F.when(F.col("doc_id") % 7 > 0, R.fingerprint(F.col("doc_id"), F.col("text"))).alias("fingerprint"))
    current = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return T.stale(saved, current, ["doc_id"], ["doc_id", "text"]).select("doc_id", F.col("stale").cast("int").alias("stale"))


QUERIES = {
    "a1_unsupported_claims": claims, "a2_draft_gaps": gap_names, "a3_unsupported_numbers": numbers, "a4_a5_letter_marks": marks, "a5_letter_audit": audit_rows,
    "a7_revisions": revisions, "p1_topics": topics, "p1_plan_totals": totals, "p2_lessons": lesson_rows, "p3_resources": resource_rows,
    "p5_feedback": feedback, "p5_feedback_notes": feedback_notes, "t1_schedule_days": schedule_days, "t1_schedule_state": schedule_state,
    "t1_schedule_stream": schedule_stream, "t2_due_queue": due, "t3_posting_feed": posting_feed, "t3_posting_feed_batch": posting_feed_batch,
    "t4_stale_work": stale_work,
}

_LETTERS = f"""letters AS MATERIALIZED (SELECT a.conv_id * 100 + a.turn AS letter_id, a.conv_id, a.turn, {skill_text_sql('a.text')} ||
   {pick_sql(["", " [Company name]", " Increased revenue by 12%.", " I am writing to you. Improved data accuracy in 2021.", " {{name}}"], 'a.conv_id')} AS letter,
   coalesce({skill_text_sql('u.text')}, '') AS facts, CASE WHEN a.conv_id % 2 = 0 THEN 'concise' ELSE 'standard' END AS length
   FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant')"""
_GAPS = f"""{Q.VOCABULARY}, {Q.CANON}, fact_tools AS (SELECT letter_id, coalesce(canonical, label) AS name FROM ({Q.mentions('letters', 'letter_id', 'facts')}) LEFT JOIN canon USING (key)),
draft_tools AS (SELECT letter_id, coalesce(canonical, label) AS name, min(ord) AS ord FROM ({Q.mentions('letters', 'letter_id', 'letter')}) LEFT JOIN canon USING (key) GROUP BY ALL),
doc_tools AS (SELECT doc_id, coalesce(canonical, label) AS name, min(ord) AS ord FROM ({Q.mentions('skill_docs', 'doc_id', 'text')}) LEFT JOIN canon USING (key) GROUP BY ALL),
both_gaps AS (SELECT letter_id, name, 0 AS part, ord FROM letters JOIN doc_tools ON doc_id = conv_id UNION ALL SELECT letter_id, name, 1, ord FROM draft_tools),
gaps AS MATERIALIZED (SELECT letter_id, name, min((part, ord)) AS place FROM both_gaps WHERE (letter_id, name) NOT IN (SELECT (letter_id, name) FROM fact_tools) GROUP BY ALL)"""
_CUT = """regexp_replace(regexp_replace(regexp_replace(letter, '([.!?])\\s+', '\\1' || chr(10), 'g'), '(?i)\\b(but|while)\\b', chr(10), 'g'),
   '(?i)[,;]\\s*((?:and\\s+)?(?:I|my|we)(?:[^\\p{L}\\p{N}_]|$))', chr(10) || '\\1', 'g')"""
_LABELS = "letter_labels(name, label) AS (" + Q.rows(sorted({(labels[0], label) for labels in K.LETTER_SPELLINGS.values() for label in labels})) + ")"
_CLAIMS = f"""{_LABELS}, sentences AS (SELECT letter_id, unnest(string_split_regex({_CUT}, '\\n+')) AS s FROM letters),
open_sentences AS MATERIALIZED (SELECT letter_id, s FROM sentences WHERE NOT regexp_matches(s, {word(K.DENIAL_CUES)}) AND NOT regexp_matches(s, {word(K.OTHER_LANGUAGE_DENIALS)})
   AND NOT (regexp_matches(s, '(?i)\\b(?:your|the|this)\\s+(?:role|listing|team|position)\\b.*\\b(?:requires?|mentions?|uses?|asks?|needs?)\\b') AND NOT regexp_matches(s, {word('I|my|our|we')}))),
gap_labels AS (SELECT letter_id, name, place, name AS label FROM gaps UNION SELECT letter_id, name, place, label FROM gaps JOIN letter_labels USING (name)),
claims AS (SELECT DISTINCT letter_id, name, place FROM open_sentences JOIN gap_labels USING (letter_id)
   WHERE regexp_matches(s, '(?i)(^|[^a-z0-9])' || {Q.escape_column('label')} || '([^a-z0-9]|$)'))"""
_NUMBER = "(^|[^\\p{L}\\p{N}_])(\\d+(?:[.,]\\d+)?(?:\\s*%|\\s*(?:percent|years?|jaar))?)"
_NUMBERS = f"""numbers0 AS (SELECT letter_id, facts, regexp_extract_all(letter, '(?i){_NUMBER}', 2) AS ns FROM letters),
numbers AS (SELECT letter_id, CAST(pos AS INTEGER) AS pos, number FROM (SELECT letter_id, facts, unnest(ns) AS number, unnest(range(len(ns))) AS pos FROM numbers0)
   WHERE NOT regexp_matches(facts, '(^|\\D)' || replace(regexp_extract(number, '\\d+(?:[.,]\\d+)?'), '.', '\\.') || '(\\D|$)'))"""
_OUT = "list_filter([" + ", ".join(Q.text(p) for p in K.OUTCOME_PHRASES) + "], lambda p: contains(lower(letter), p) AND NOT contains(lower(facts), p))"
_MARKS = f"""marks AS (SELECT letter_id, {_OUT} AS outcomes, regexp_matches(letter, '(?i)\\[(?:your|company|name|insert|achievement|role)[^\\]]*\\]|\\{{\\{{.*?\\}}\\}}') AS placeholder,
   length(letter) >= 120 AND NOT regexp_matches(letter, '^\\s*[{{\\[<]') AND NOT contains(letter, '```') AND NOT regexp_matches(letter, '(?m)^\\s*(?:#{{1,6}}\\s|[-*]\\s)')
     AND NOT regexp_matches(lower(letter), {Q.text('|'.join(K.STOCK_PHRASES))}) AS usable,
   CAST(len(list_filter(string_split_regex(letter, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words, length FROM letters)"""
_BAND = "CASE WHEN length = 'concise' THEN words BETWEEN 140 AND 220 ELSE words BETWEEN 220 AND 340 END"
_AUDIT = f"""WITH {SKILL_DOCUMENTS}, {_LETTERS}, {_GAPS}, {_CLAIMS}, {_NUMBERS}, {_MARKS},
claim_text AS (SELECT letter_id, 'Unsupported tool claims: ' || string_agg(name, ', ' ORDER BY place) AS t FROM claims GROUP BY ALL),
number_list AS (SELECT letter_id, list('Check an unsupported number: ' || number ORDER BY pos) AS ns FROM numbers GROUP BY ALL),
raw AS (SELECT letter_id, words, length, list_filter(list_concat([c.t], list_transform(outcomes, lambda p: 'An outcome needs explicit evidence: ' || p), coalesce(n.ns, []),
   [CASE WHEN placeholder THEN 'Replace template placeholders with supplied facts.' END, CASE WHEN NOT usable THEN 'The draft is too short or uses a stock opening.' END,
    CASE WHEN words > 440 THEN 'The draft is too long for an application note.' END]), lambda x: x IS NOT NULL) AS all_issues
   FROM marks LEFT JOIN claim_text c USING (letter_id) LEFT JOIN number_list n USING (letter_id)),
audit AS (SELECT letter_id, words, length, list_filter(all_issues, lambda x, i: list_position(all_issues, x) = i) AS issues FROM raw)"""
_REQS = f"""reqs AS (SELECT o_custkey AS profile_id, o_orderkey AS posting_id, l_linenumber::BIGINT * 100000000 + l_partkey AS ord,
   CASE WHEN l_partkey % 5 = 0 THEN {pick_sql(list(R.SOFT_TOPICS), 'l_partkey')} ELSE {pick_sql(S.base_labels(), 'l_partkey')} END AS name,
   CASE WHEN l_partkey % 5 = 0 THEN 'soft' ELSE 'hard' END AS kind, l_linenumber % 3 AS rank, {pick_sql(['required', 'mentioned', 'preferred'], 'l_linenumber')} AS priority,
   l_returnflag = 'A' AS missing, l_returnflag = 'A' AND l_linenumber = 2 AS covered FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bucketed AS (SELECT *, CASE WHEN kind = 'soft' THEN 2 WHEN NOT missing THEN 1 WHEN NOT covered THEN 0 END AS bucket FROM reqs),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id, posting_id, bucket ORDER BY rank, CASE WHEN bucket < 2 THEN name END, ord) AS INTEGER) AS place FROM bucketed WHERE bucket IS NOT NULL),
topics AS (SELECT *, CASE WHEN kind = 'soft' THEN 15 WHEN missing THEN 35 ELSE 20 END AS minutes FROM placed WHERE place <= CASE bucket WHEN 0 THEN 3 ELSE 2 END)"""
_DAYS = """rated AS (SELECT user_id AS profile_id, event_type AS skill_id, CAST(ts AS DATE) AS day, ts, event_id,
   CASE WHEN value < 10 THEN 'again' WHEN value < 30 THEN 'effort' ELSE 'independent' END AS rating FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY profile_id, skill_id ORDER BY ts, event_id) AS i FROM rated),
fold AS (WITH RECURSIVE f(profile_id, skill_id, i, day, rating, interval_days, interval_before) AS (
   SELECT profile_id, skill_id, i, day, rating, CASE rating WHEN 'again' THEN 1 WHEN 'effort' THEN 3 ELSE 7 END, 0 FROM numbered WHERE i = 1
   UNION ALL SELECT n.profile_id, n.skill_id, n.i, n.day, n.rating,
     CASE n.rating WHEN 'again' THEN 1 WHEN 'effort' THEN 3 ELSE least(30, greatest(7, 2 * CASE WHEN n.day = f.day THEN f.interval_before ELSE f.interval_days END)) END,
     CASE WHEN n.day = f.day THEN f.interval_before ELSE f.interval_days END
   FROM f JOIN numbered n ON n.profile_id = f.profile_id AND n.skill_id = f.skill_id AND n.i = f.i + 1) SELECT * FROM f),
days AS (SELECT profile_id, skill_id, day, arg_max(rating, i) AS recall, arg_max(interval_days, i) AS interval_days, arg_max(interval_before, i) AS interval_before FROM fold GROUP BY ALL),
state AS (SELECT profile_id, skill_id, arg_max(interval_days, day) AS interval_days, arg_max(interval_before, day) AS interval_before, max(day) AS last_day, arg_max(recall, day) AS recall
   FROM days GROUP BY ALL)"""
_STATE = f"""WITH {_DAYS} SELECT profile_id, skill_id, interval_days, interval_before, CAST(last_day AS VARCHAR) AS last_reviewed,
   CAST(CAST(last_day + to_days(interval_days) AS DATE) AS VARCHAR) AS review_on, recall FROM state"""
_FEED = """WITH s AS (SELECT source, CAST(doc_id // 2 AS VARCHAR) AS job_id, doc_id, doc_id % 2 AS minute, text, doc_id % 5 = 0 AS pasted FROM documents)
   SELECT source, job_id, {seq} md5(coalesce(arg_min(text, minute * 1000000000 + doc_id) FILTER (pasted), arg_max(text, minute * 1000000000 + doc_id))) AS description,
   CASE WHEN bool_or(pasted) THEN 'pasted' ELSE 'source' END AS description_source FROM s GROUP BY source, job_id"""
_MATERIAL = "material(title, url, always, pos, keyword, pattern) AS (" + Q.rows(
    (t, u, a, i, k, "(^|[^a-z0-9_])" + Q.escape(k) + "([^a-z0-9_]|$)") for t, u, ks, a in MATERIALS for i, k in enumerate(ks)) + ")"
_FEEDBACK = f"""bench AS (SELECT item_id, text AS passage FROM benchmark), obs AS (SELECT doc_id, text, ord, CAST((ord * 3 + doc_id) % 6 - 1 AS INTEGER) AS idx,
   {pick_sql(['demonstrated', 'partial', 'not_yet', 'great'], '(doc_id + ord)')} AS status, CASE ord % 3 WHEN 0 THEN substr(text, CAST(ord * 7 + 1 AS INTEGER), CASE WHEN ord = 3 THEN 260 ELSE 40 END)
   WHEN 1 THEN passage ELSE '' END AS ev, CASE WHEN ord = 6 THEN ' ' ELSE 'Good' END AS comment
   FROM documents CROSS JOIN range(8) r(ord) LEFT JOIN bench ON item_id = (doc_id + ord) % (SELECT count(*) FROM benchmark)),
valid AS (SELECT *, regexp_replace(coalesce(ev, ''), '^\\s+|\\s+$', '', 'g') AS q FROM obs WHERE idx BETWEEN 0 AND 3 AND status <> 'great' AND trim(comment) <> ''),
kept AS (SELECT doc_id AS answer_id, idx AS criterion_index, arg_min(status, ord) AS status, arg_min(q, ord) AS q FROM valid
   WHERE length(q) <= 240 AND (q = '' OR contains(text, q)) AND (status = 'not_yet' OR q <> '') GROUP BY ALL)"""

ORACLE = {
    "a1_unsupported_claims": f"WITH {SKILL_DOCUMENTS}, {_LETTERS}, {_GAPS}, {_CLAIMS} SELECT letter_id, name FROM claims",
    "a2_draft_gaps": f"WITH {SKILL_DOCUMENTS}, {_LETTERS}, {_GAPS} SELECT letter_id, name FROM gaps",
    "a3_unsupported_numbers": f"WITH {_LETTERS}, {_NUMBERS} SELECT letter_id, pos, number FROM numbers",
    "a4_a5_letter_marks": f"""WITH {_LETTERS}, {_MARKS} SELECT letter_id, array_to_string(outcomes, '|') AS outcomes, CAST(placeholder AS INTEGER) AS placeholder,
        CAST(usable AS INTEGER) AS usable, words, CAST({_BAND} AS INTEGER) AS within FROM marks""",
    "a5_letter_audit": f"""{_AUDIT} SELECT letter_id, array_to_string(issues, '|') AS issues, words AS word_count,
        CASE WHEN length = 'concise' THEN '140–220' ELSE '220–340' END AS target, CAST({_BAND} AS INTEGER) AS within_target FROM audit""",
    "a7_revisions": f"""{_AUDIT}, v AS (SELECT letter_id // 100 AS letter_id, CAST(letter_id % 100 // 2 AS INTEGER) AS version, issues FROM audit)
        SELECT a.letter_id, a.version, CAST(len(list_filter(a.issues, lambda x: NOT list_contains(b.issues, x))) AS INTEGER) AS n_added,
          CAST(len(list_filter(a.issues, lambda x: NOT list_contains(b.issues, x))) = 0 AS INTEGER) AS acceptable
        FROM v a JOIN v b ON a.letter_id = b.letter_id AND a.version = b.version + 1""",
    "p1_topics": f"WITH {_REQS} SELECT profile_id, posting_id, bucket, place, name, priority FROM topics",
    "p1_plan_totals": f"""WITH {_REQS}, c AS (SELECT profile_id, posting_id, count(*) AS lessons, sum(minutes)::BIGINT AS total_minutes FROM topics GROUP BY ALL)
        SELECT profile_id, posting_id, coalesce(lessons, 0) AS lessons, coalesce(total_minutes, 0) AS total_minutes, count(*) - coalesce(lessons, 0) AS remaining_topics
        FROM reqs LEFT JOIN c USING (profile_id, posting_id) GROUP BY profile_id, posting_id, lessons, total_minutes""",
    "p2_lessons": f"""WITH {_REQS}, {Q.CANON}, alias(name, recipe) AS ({Q.rows(K.RECIPE_ALIASES.items())}),
        recipes AS (SELECT DISTINCT {pick_sql(S.base_labels(), 'p_partkey')} AS recipe FROM part WHERE p_size > 25),
        soft_recipes AS (SELECT DISTINCT {pick_sql(list(R.SOFT_TOPICS), 'p_partkey')} AS recipe FROM part),
        tools AS (SELECT DISTINCT {pick_sql(S.base_labels(), 'p_partkey')} AS name FROM part WHERE p_size > 40),
        named AS (SELECT t.*, coalesce(a.recipe, c.canonical, t.name) AS wanted FROM topics t LEFT JOIN canon c ON c.key = {Q.key('t.name')}
          LEFT JOIN alias a ON a.name = coalesce(c.canonical, t.name))
        SELECT profile_id, posting_id, bucket, place, n.name, minutes, n.name || ': ' || CASE WHEN kind = 'soft' THEN 'rehearse a situation' WHEN missing THEN 'build a first example'
            ELSE 'recall, then apply' END AS title, CASE WHEN kind = 'soft' THEN (s.recipe IS NOT NULL)::INTEGER ELSE (r.recipe IS NOT NULL)::INTEGER END AS has_recipe,
          CASE WHEN kind = 'hard' AND r.recipe IS NOT NULL THEN CASE WHEN l.name IS NOT NULL THEN 'https://example.org/' || l.name ELSE 'https://example.com/' || r.recipe END END AS url,
          minutes AS step_minutes
        FROM named n LEFT JOIN recipes r ON r.recipe = wanted LEFT JOIN soft_recipes s ON s.recipe = n.name LEFT JOIN tools l ON l.name = n.name""",
    "p3_resources": f"""WITH {SKILL_DOCUMENTS}, {Q.VOCABULARY}, {_MATERIAL}, m AS ({Q.mentions('skill_docs', 'doc_id', 'text')}),
        o AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord FROM m),
        names AS (SELECT doc_id, lower(coalesce(string_agg(label, ' ' ORDER BY ord) FILTER (ord % 2 = 0), '')) AS missing,
          lower(coalesce(string_agg(label, ' ' ORDER BY ord) FILTER (ord % 2 = 1), '')) AS covered FROM o GROUP BY ALL),
        flags AS (SELECT d.doc_id, k.url, k.title, k.always, k.pos, regexp_matches(regexp_replace(lower(d.text), '[^\\x00-\\x7F]', '_', 'g'), k.pattern) AS t,
          regexp_matches(coalesce(n.missing, ''), k.pattern) AS ms, regexp_matches(coalesce(n.covered, ''), k.pattern) AS cv
          FROM skill_docs d CROSS JOIN material k LEFT JOIN names n USING (doc_id)),
        summed AS (SELECT doc_id, title, always, sum(CASE WHEN t THEN 2 WHEN ms OR cv THEN 1 ELSE 0 END + CASE WHEN pos = 0 AND ms THEN 3 ELSE 0 END) AS s
          FROM flags GROUP BY doc_id, title, always), scored AS (SELECT doc_id, title, always, s + CASE WHEN always THEN 3 ELSE 0 END AS score FROM summed)
        SELECT doc_id + 1 AS profile_id, doc_id AS posting_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY always DESC, score DESC, title) AS INTEGER) AS place,
          title, CAST(score AS INTEGER) AS score FROM scored WHERE score > 0 QUALIFY place <= 7""",
    "p5_feedback": f"WITH {_FEEDBACK} SELECT answer_id, criterion_index, status, md5(q) AS evidence FROM kept",
    "p5_feedback_notes": f"""WITH {_FEEDBACK}, c AS (SELECT answer_id, count(*) AS kept FROM kept GROUP BY ALL)
        SELECT doc_id AS answer_id, coalesce(kept, 0) AS kept, CAST(coalesce(kept, 0) > 0 AND kept <> 4 AS INTEGER) AS incomplete FROM documents LEFT JOIN c ON answer_id = doc_id""",
    "t1_schedule_days": f"""WITH {_DAYS} SELECT profile_id, skill_id, CAST(day AS VARCHAR) AS day, recall, interval_days, interval_before,
        CAST(CAST(day + to_days(interval_days) AS DATE) AS VARCHAR) AS review_on FROM days""",
    "t1_schedule_state": _STATE, "t1_schedule_stream": _STATE,
    "t2_due_queue": f"""WITH {_DAYS}, apps AS (SELECT *, CAST(o_orderdate AS DATE) + 9500 AS followup FROM orders WHERE o_orderstatus <> 'F'),
        r AS (SELECT profile_id, skill_id, CAST(last_day + to_days(interval_days) AS DATE) AS review_on FROM state)
        SELECT o_custkey AS profile_id, o_orderkey AS job_id, '-' AS skill_id, 'Follow up · ' || o_orderpriority AS title, o_orderpriority AS detail,
          CAST(followup AS VARCHAR) AS due, 'workspace' AS action FROM apps WHERE followup <= DATE '2024-01-31'
        UNION ALL SELECT o_custkey, o_orderkey, r.skill_id, 'Review ' || r.skill_id, o_orderpriority || ' · 20 min', CAST(review_on AS VARCHAR), 'coaching-lesson'
        FROM apps JOIN r ON r.profile_id = o_custkey AND r.skill_id = {pick_sql(['view', 'click', 'error', 'signup', 'purchase'], 'o_orderkey')} WHERE review_on <= DATE '2024-01-31'""",
    "t3_posting_feed": _FEED.format(seq=""), "t3_posting_feed_batch": _FEED.format(seq="arg_max(doc_id, minute * 1000000000 + doc_id) AS seq,"),
    "t4_stale_work": "SELECT doc_id, CAST(doc_id % 7 > 0 AND doc_id % 5 = 0 AS INTEGER) AS stale FROM documents",
}
