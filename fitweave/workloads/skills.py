"""Skill jobs over parts, documents, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.functions.text import literal_array, skill_key
from fitweave.functions.vocabulary import GENERIC_TERMS
from fitweave.operators import skills as S
from fitweave.plans.posting_rank import rank_by_text, shortlist_order
from fitweave.workloads import sql as Q
from fitweave.workloads.inputs import SKILL_DOCUMENTS, skill_documents, table

# Labels that customers list: base labels, generic terms, composites and words only some documents use.
LISTED = [*S.base_labels(), *GENERIC_TERMS, "Azure, Azure DevOps", "Python developer", "Senior Java engineer",
          "R&D/Lab_work", " Docker ", "onth", "onea", "reing", "Git hub", "C++ programming", "linux-admin"]
OWN = ["Python", "K8s", "Jenkins", "GitHub", "Docker", "MySQL", "Azure DevOps", "Ubuntu", "Prometheus", "onth",
       "communication", "Java developer", "reing", "Postgres", "NodeJS", "React", "anat", "Go", "GitLab CI", "oned",
       "Learning Rust", "No AWS experience"]


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(literal_array(list(values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], number: str) -> str:
    return f"list_extract([{', '.join(Q.text(v) for v in values)}], CAST({number} % {len(values)} AS INTEGER) + 1)"


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", _pick(LISTED, F.col("p_partkey")).alias("label"))


def keys(spark, sf_dir):
    raw = F.concat_ws("", F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("_x-(y)  "))
    return table(spark, sf_dir, "part").select("p_partkey", skill_key(raw).alias("key"))


def generic_filter(spark, sf_dir):
    rows = part_labels(spark, sf_dir)
    return rows.where(~S.is_generic(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


def canonical(spark, sf_dir):
    return part_labels(spark, sf_dir).select("p_partkey", S.canonical_skill(F.col("label")).alias("canonical"),
                                             S.canonical_key(F.col("label")).alias("canonical_key"))


def build_vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    extras = part_labels(spark, sf_dir).select(F.col("p_partkey").alias("ord"), "label").unionByName(
        part.select((F.col("p_partkey") + 10000000).alias("ord"), F.concat_ws(" ", "p_name", F.upper("p_brand")).alias("label")))
    return S.vocabulary(S.base_vocabulary(spark), extras).select("lower_label", "part", "ord", "label")


def mentions(spark, sf_dir):
    docs = skill_documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(S.base_mentions(F.col("text"))).alias("pos", "label"))


def conversation_labels(spark, sf_dir):
    """Every word and every pair of neighbouring words of the users' turns."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    return turns.select(F.explode(F.concat("w", pairs)).alias("label")).distinct()


def large_vocabulary(spark, sf_dir):
    docs = skill_documents(spark, sf_dir).select("doc_id", "text")
    return S.vocabulary_mentions(docs, conversation_labels(spark, sf_dir))


def label_coverage(spark, sf_dir):
    labels = part_labels(spark, sf_dir).select("label")
    return S.coverage(labels, labels)


def customer_skills(spark, sf_dir) -> DataFrame:
    """(profile_id, ord, label): each order of a customer names one label; repeats count once."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", _pick(OWN, F.col("o_orderkey")).alias("label"), "o_orderkey")
    return orders.groupBy(F.col("o_custkey").alias("profile_id"), "label").agg(F.min("o_orderkey").alias("ord"))


def document_skills(spark, sf_dir) -> DataFrame:
    docs = skill_documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("posting_id"), F.posexplode(S.base_mentions(F.col("text"))).alias("ord", "label"))


def comparison(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select("c_custkey").join(
        table(spark, sf_dir, "documents").select("doc_id"), F.col("c_custkey") == F.col("doc_id")).select(
        F.col("c_custkey").alias("profile_id"), F.col("doc_id").alias("posting_id"))
    rows = S.compare(pairs, document_skills(spark, sf_dir), customer_skills(spark, sf_dir))
    return rows.select("profile_id", "posting_id", "ord", "name", F.col("matched").cast("int").alias("matched"),
                       F.coalesce(F.array_join("via", "|"), F.lit("-")).alias("via"))


def comparison_lists(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("posting_id"))
    rows = S.summarise_comparison(S.compare(pairs, document_skills(spark, sf_dir), customer_skills(spark, sf_dir)))
    return rows.select("profile_id", "posting_id", F.array_join("matched", "|").alias("matched"),
                       F.array_join("missing", "|").alias("missing"))


def text_rank(spark, sf_dir):
    docs = skill_documents(spark, sf_dir).select(F.col("doc_id").alias("posting_id"), F.col("doc_id").alias("ord"), "text")
    ranked = rank_by_text(docs, customer_skills(spark, sf_dir), k=5)
    return ranked.select("profile_id", "posting_id", "n_matched", "score", "rank")


def shortlist(spark, sf_dir):
    docs = skill_documents(spark, sf_dir).select(F.col("doc_id").alias("posting_id"), "text")
    saved = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("posting_id"),
                                                  F.col("o_orderkey").alias("ord"))
    return shortlist_order(saved, docs, customer_skills(spark, sf_dir)).select("profile_id", "posting_id", "n_matched")


def terms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nothing = F.array().cast("array<string>")
    possible = F.when(F.col("p_partkey") % 3 == 0, F.array(
        F.concat(F.lit('"'), F.col("p_name"), F.lit('" lead')), F.col("p_type"), F.col("p_brand"), F.col("p_name"))).when(
        F.col("p_partkey") % 3 == 1, nothing)
    recent = F.when(F.col("p_partkey") % 5 > 0, F.array("p_brand", "p_type")).otherwise(nothing)
    return part.select("p_partkey", S.search_terms(possible, recent).alias("keywords"))


def _spellings(name, number):
    cased = F.initcap(name)
    return F.array(F.replace(cased, F.lit(" "), F.lit("")), name, F.replace(name, F.lit(" "), F.lit("_")), F.lit(" "),
                   F.when(number % 2 == 0, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.col("p_brand")),
                   cased, F.replace(F.col("p_brand"), F.lit("#"), F.lit(" #")))


def tidy(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(S.tidy_skill_list(_spellings(F.col("p_name"), F.col("p_partkey")), 3), "|").alias("labels"))


QUERIES = {
    "k1_skill_key": keys, "k2_generic_filter": generic_filter, "k3_canonical": canonical,
    "k4_vocabulary": build_vocabulary, "k5_mentions": mentions, "k5_large_vocabulary": large_vocabulary,
    "k6_coverage": label_coverage, "k7_compare": comparison, "k7_comparison_lists": comparison_lists,
    "k8_text_rank": text_rank, "k10_shortlist_order": shortlist, "k12_search_terms": terms, "k13_tidy_skill_list": tidy,
}

_LISTED = f"listed AS (SELECT p_partkey, {_pick_sql(LISTED, 'p_partkey')} AS label FROM part)"
_CUSTOMER = (f"customer_skills AS (SELECT o_custkey AS profile_id, {_pick_sql(OWN, 'o_orderkey')} AS label, "
             f"min(o_orderkey) AS ord FROM orders GROUP BY ALL)")


def _coverage_sql(jobs: str, mine: str) -> str:
    """covered(job_label, profile_label, kind) from two label relations."""
    return f"""
job_side AS (SELECT DISTINCT trim(label) AS label FROM {jobs}),
jobs AS (SELECT label, {Q.key('label')} AS key, coalesce(canonical, label) AS name FROM job_side
         LEFT JOIN canon ON canon.key = {Q.key('label')}),
own_side AS (SELECT DISTINCT trim(label) AS label FROM {mine}),
own AS (SELECT label, {Q.key('label')} AS key, coalesce(canonical, label) AS name FROM own_side
        LEFT JOIN canon ON canon.key = {Q.key('label')} WHERE {Q.key('label')} NOT IN {Q.GENERIC}),
covered AS (SELECT j.label AS job_label, o.label AS profile_label, {Q.key('o.name')} AS tool,
    CASE WHEN j.key = o.key THEN 'same' WHEN {Q.key('j.name')} = {Q.key('o.name')} THEN 'alias'
         WHEN {Q.label_mentioned('o.label', 'j.label')} OR {Q.label_mentioned('o.label', 'j.name')} THEN 'contains'
         WHEN rj.umbrella AND rj.family = ro.family THEN 'family' END AS kind
  FROM jobs j CROSS JOIN own o LEFT JOIN roles rj ON rj.key = {Q.key('j.name')}
  LEFT JOIN roles ro ON ro.key = {Q.key('o.name')})"""


_MENTIONS = f"mentions AS MATERIALIZED ({Q.mentions('skill_docs', 'doc_id', 'text')})"
_FIRST = f"""
named AS (SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.ord) - 1 AS INTEGER) AS ord, m.label, {Q.key("coalesce(canonical, label)")} AS tool
          FROM mentions m LEFT JOIN canon USING (key)),
tools AS (SELECT doc_id, tool, min(ord) AS ord, arg_min(label, ord) AS label FROM named GROUP BY doc_id, tool)"""
def _via_sql(skills: str) -> str:
    return f"""
per_tool AS (SELECT profile_id, job_label, tool, max(CASE WHEN kind = 'same' THEN 1 ELSE 0 END) AS same, min(ord) AS first_ord,
                    first(profile_label ORDER BY length(profile_label) DESC, ord) AS best
             FROM {skills} JOIN covered ON profile_label = trim(label) WHERE kind IS NOT NULL GROUP BY ALL),
via AS (SELECT profile_id, job_label, CASE WHEN max(same) = 1 THEN '' ELSE string_agg(best, '|' ORDER BY first_ord, best) END AS via
        FROM per_tool GROUP BY ALL)"""


_VIA = _via_sql("customer_skills")
_TEXT_PREFIX = f"WITH {SKILL_DOCUMENTS}, {Q.VOCABULARY}, {Q.CANON}, {Q.ROLES}, {_CUSTOMER}, {_MENTIONS}, {_FIRST}"
_HITS = f"""{_coverage_sql('tools', 'customer_skills')}, {_VIA},
base_tools AS (SELECT v.profile_id, t.doc_id, t.tool FROM tools t JOIN via v ON v.job_label = t.label),
extras AS (SELECT DISTINCT label FROM customer_skills WHERE lower(label) NOT IN (SELECT lower(label) FROM vocabulary)
           AND {Q.key('label')} NOT IN {Q.GENERIC}),
extra_hits AS (SELECT d.doc_id, e.label FROM skill_docs d CROSS JOIN extras e WHERE {Q.label_mentioned('d.text', 'e.label')}),
all_tools AS (SELECT * FROM base_tools UNION
              SELECT c.profile_id, x.doc_id, {Q.key('x.label')} FROM extra_hits x JOIN customer_skills c USING (label)),
hits AS (SELECT profile_id, doc_id AS posting_id, count(*) AS n FROM all_tools GROUP BY ALL)"""

_SPELLINGS_SQL = """[replace(cased, ' ', ''), p_name, replace(p_name, ' ', '_'), ' ',
  CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_brand END, cased, replace(p_brand, '#', ' #')]"""


def _edged(column: str) -> str:
    """Lower case with a mark at both ends of every run of letters and digits."""
    return f"regexp_replace(lower({column}), '([a-z0-9]+)', chr(1) || '\\1' || chr(1), 'g')"


ORACLE = {
    "k1_skill_key": f"SELECT p_partkey, {Q.key('''p_name || ' & ' || p_brand || '/' || p_type || '_x-(y)  ' ''')} AS key FROM part",
    "k2_generic_filter": f"WITH {_LISTED} SELECT label, count(*) AS n FROM listed WHERE {Q.key('label')} NOT IN {Q.GENERIC} GROUP BY label",
    "k3_canonical": f"""WITH {_LISTED}, {Q.CANON} SELECT p_partkey, coalesce(canonical, trim(label)) AS canonical,
        {Q.key('coalesce(canonical, trim(label))')} AS canonical_key FROM listed LEFT JOIN canon ON key = {Q.key('label')}""",
    "k4_vocabulary": f"""WITH {_LISTED}, {Q.VOCABULARY},
        every AS (SELECT 0 AS part, CAST(ord AS BIGINT) AS ord, label FROM vocabulary
                  UNION ALL SELECT 1, p_partkey, trim(label) FROM listed
                  UNION ALL SELECT 1, p_partkey + 10000000, p_name || ' ' || upper(p_brand) FROM part)
        SELECT lower_label, part, ord, label FROM (SELECT *, lower(label) AS lower_label,
          row_number() OVER (PARTITION BY lower(label) ORDER BY part, ord) AS rn FROM every
          WHERE label <> '' AND {Q.key('label')} NOT IN {Q.GENERIC}) WHERE rn = 1""",
    "k5_mentions": f"""WITH {SKILL_DOCUMENTS}, {Q.VOCABULARY}, {_MENTIONS}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS pos, label FROM mentions""",
    "k5_large_vocabulary": f"""WITH {SKILL_DOCUMENTS}, words AS (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations WHERE role = 'user'),
        labels AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS label FROM words),
        tidy AS (SELECT DISTINCT regexp_replace(label, '^\\s+|\\s+$', '', 'g') AS label FROM labels),
        keyed AS (SELECT label, string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' ')[1] AS first_word, {_edged('label')} AS edged FROM tidy),
        edged_docs AS MATERIALIZED (SELECT doc_id, text, {_edged('text')} AS edged FROM skill_docs),
        doc_words AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS first_word FROM skill_docs
                      UNION SELECT doc_id, '' FROM skill_docs)
        SELECT doc_id, label FROM doc_words JOIN keyed USING (first_word) JOIN edged_docs d USING (doc_id) WHERE contains(d.edged, keyed.edged) AND
          (regexp_matches(label, '(?i)^[a-z0-9](.*[a-z0-9])?$') OR regexp_matches(text, '(?i)(^|[^a-z0-9])' || {Q.escape_column('label')} || '([^a-z0-9]|$)'))
        UNION SELECT doc_id, label FROM skill_docs JOIN tidy ON {Q.key('text')} = {Q.key('label')}""",
    "k6_coverage": f"""WITH {_LISTED}, {Q.CANON}, {Q.ROLES}, {_coverage_sql('listed', 'listed')}
        SELECT job_label, profile_label, kind FROM covered WHERE kind IS NOT NULL""",
    "k7_compare": f"""{_TEXT_PREFIX}, {_coverage_sql('tools', 'customer_skills')}, {_VIA}
        SELECT c_custkey AS profile_id, doc_id AS posting_id, t.ord, t.label AS name,
               CASE WHEN v.via IS NULL THEN 0 ELSE 1 END AS matched, coalesce(v.via, '-') AS via
        FROM customer JOIN tools t ON doc_id = c_custkey LEFT JOIN via v ON v.profile_id = c_custkey AND v.job_label = t.label""",
    "k7_comparison_lists": f"""{_TEXT_PREFIX}, {_coverage_sql('tools', 'customer_skills')}, {_VIA}
        SELECT o_custkey AS profile_id, doc_id AS posting_id,
               coalesce(string_agg(CASE WHEN v.via IS NOT NULL THEN t.label END, '|' ORDER BY t.ord), '') AS matched,
               coalesce(string_agg(CASE WHEN v.via IS NULL THEN t.label END, '|' ORDER BY t.ord), '') AS missing
        FROM orders JOIN tools t ON doc_id = o_orderkey LEFT JOIN via v ON v.profile_id = o_custkey AND v.job_label = t.label
        GROUP BY ALL""",
    "k8_text_rank": f"""{_TEXT_PREFIX}, {_HITS},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, posting_id) AS rank FROM hits),
        sizes AS (SELECT profile_id, count(*) AS m FROM customer_skills GROUP BY ALL)
        SELECT profile_id, posting_id, CAST(n AS INTEGER) AS n_matched, round_even(n / m, 4) AS score, CAST(rank AS INTEGER) AS rank
        FROM ranked JOIN sizes USING (profile_id) WHERE rank <= 5""",
    "k10_shortlist_order": f"""{_TEXT_PREFIX}, {_HITS}
        SELECT o_custkey AS profile_id, o_orderkey AS posting_id, CAST(coalesce(n, 0) AS INTEGER) AS n_matched
        FROM orders JOIN documents ON doc_id = o_orderkey LEFT JOIN hits ON hits.profile_id = o_custkey AND hits.posting_id = o_orderkey""",
    "k12_search_terms": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name || ' lead', p_type, p_brand]
          WHEN p_partkey % 5 > 0 THEN [p_brand, p_type] ELSE [] END AS titles FROM part)
        SELECT p_partkey, CASE WHEN len(titles) > 0 THEN '"' || array_to_string(titles, '" OR "') || '"' END AS keywords FROM t""",
    "k13_tidy_skill_list": f"""WITH cased AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cased FROM part),
        flat AS (SELECT p_partkey, unnest(list_transform({_SPELLINGS_SQL}, lambda x: trim(x))) AS label,
                 unnest(range(7)) AS ord FROM cased),
        groups AS (SELECT p_partkey, regexp_replace(lower(label), '[\\s_\\-]+', '', 'g') AS k, min(ord) AS first_ord,
                   list(label ORDER BY ord) AS labels FROM flat WHERE label <> '' GROUP BY ALL),
        folded AS (SELECT p_partkey, first_ord, list_reduce(labels, lambda a, b: CASE WHEN contains(a, ' ') THEN a
          WHEN contains(b, ' ') AND NOT (a <> lower(a) AND b = lower(b)) THEN b ELSE a END) AS label,
          row_number() OVER (PARTITION BY p_partkey ORDER BY first_ord) AS rn FROM groups)
        SELECT p_partkey, string_agg(label, '|' ORDER BY first_ord) AS labels FROM folded WHERE rn <= 3 GROUP BY p_partkey""",
}
