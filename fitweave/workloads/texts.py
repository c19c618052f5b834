"""Language, CV text and evaluation jobs over documents, conversations and customers (L*, C*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitweave.functions import constants as K
from fitweave.functions.text import literal_array
from fitweave.operators import evaluation as E
from fitweave.operators import language as L
from fitweave.operators import profiles as P
from fitweave.workloads import sql as Q
from fitweave.workloads.inputs import SKILL_DOCUMENTS, skill_documents, table

REQUESTED = ["en", " NL ", "zh", "zh-tw", "nb", "off", "Original", "pt-BR", "xx", "", "de-AT", "0", "iw", "fr", "EN", "klingon"]
COUNTRIES = ["nl", "U.S.", "Deutschland", " de ", "UK", "", "The Netherlands", "be", "Korea", "Singapore"]
CITIES = ["Amsterdam", "berlin", "Paris ", "", "Springfield", "Singapore", "New York", "Köln", "Luxembourg"]


def pick(values, number):
    return F.element_at(literal_array(list(values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, number):
    return f"list_extract([{', '.join(Q.text(v) for v in values)}], CAST({number} % {len(values)} AS INTEGER) + 1)"


def english(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", L.looks_english(F.col("text")).cast("int").alias("english"))


def codes(spark, sf_dir):
    value = pick(REQUESTED, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.language_code(value).alias("code"),
                                                   L.language_supported(value).cast("int").alias("supported"))


def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def chunk_rows(spark, sf_dir):
    return L.chunk_table(paragraphs(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


def memory(spark, sf_dir):
    """Known chunks: those of French and German documents, with a marker as translation."""
    docs = table(spark, sf_dir, "documents").where("lang in ('fr', 'de')").select("doc_id")
    known = L.chunk_table(paragraphs(spark, sf_dir).join(docs, "doc_id"))
    return known.select("chunk_hash", F.lit("en").alias("target"), F.concat(F.lit("T: "), "chunk").alias("translated"),
                        F.lit("fr").alias("detected")).distinct()


def translated(spark, sf_dir):
    rows = L.apply_memory(paragraphs(spark, sf_dir), memory(spark, sf_dir))
    return rows.select("doc_id", "source_language", F.md5("translated_text").alias("translated"), F.col("is_translated").cast("int").alias("done"), "n_missing")


def open_chunks(spark, sf_dir):
    return L.work_list(paragraphs(spark, sf_dir), memory(spark, sf_dir)).select("chunk_hash", "uses")


def notes(spark, sf_dir):
    rows = L.translation_notes(L.apply_memory(paragraphs(spark, sf_dir), memory(spark, sf_dir)))
    return rows.select("translated", "failed", F.array_join("notes", "|").alias("notes"))


def shown(spark, sf_dir):
    rows = L.apply_memory(paragraphs(spark, sf_dir), memory(spark, sf_dir)).join(paragraphs(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.md5(L.display_text(F.col("translated_text"), F.col("text"))).alias("shown"))


def tidy(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.replace(F.replace("text", F.lit(". "), F.lit(".  \t")), F.lit("\n"), F.lit("\r\n\r\n\r\n")), F.lit("\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", P.tidy_text(raw).alias("text"))
    return docs.select("doc_id", F.md5("text").alias("text"), P.text_quality(F.col("text")).alias("quality"))


def pages(spark, sf_dir):
    """Turns as pages: some conversations repeat a header or footer on all pages, some on all but the first."""
    c = F.col("conv_id")
    head = F.when(c % 3 == 0, F.concat(F.lit("CV of "), c, F.lit("\n"))).when((c % 3 == 1) & (F.col("turn") > 0), F.lit("CV part\n")).otherwise("")
    foot = F.when(c % 2 == 0, F.concat(F.lit("\n\n  Page foot "), c, F.lit("  "))).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        c.alias("doc_id"), F.col("turn").alias("page_no"), F.concat(head, F.col("text"), foot).alias("text"))


def clean_pages(spark, sf_dir):
    return P.drop_repeated_edges(pages(spark, sf_dir)).select("doc_id", "page_no", F.md5("text").alias("text"))


def whole_documents(spark, sf_dir):
    rows = P.documents(pages(spark, sf_dir).withColumn("page_no", F.col("page_no") + 1))
    return rows.select("doc_id", F.md5("text").alias("text"))


def hints(spark, sf_dir):
    rows = P.identifiers(skill_documents(spark, sf_dir).select("doc_id", "text"))
    ranges = F.transform("year_ranges", lambda r: F.concat(r["start"], F.lit("-"), F.coalesce(r["end"].cast("string"), F.lit("now"))))
    return rows.select("doc_id", F.array_join("emails", "|").alias("emails"), F.array_join("github_urls", "|").alias("github"),
                       F.array_join("linkedin_urls", "|").alias("linkedin"), F.array_join(ranges, "|").alias("ranges"),
                       F.array_join("years", "|").alias("years"), F.col("stated_years").cast("int").alias("stated"))


def phone_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.phones(F.col("text")), "|").alias("phones"))
    return rows.where("phones <> ''")


def rules(spark, sf_dir):
    return P.rules_profile(P.identifiers(skill_documents(spark, sf_dir).select("doc_id", "text")))


def rule_profiles(spark, sf_dir):
    return rules(spark, sf_dir).select("doc_id", "email", "github_url", "linkedin_url", F.col("years_experience").cast("int").alias("years"),
                                       "confidence")


def model_profiles(spark, sf_dir):
    """Model fields derived from customers; documents of the same number supply the rule hints."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    nothing = F.lit(None).cast("string")
    firm = F.struct(F.when(k % 3 == 0, F.concat(F.col("c_name"), F.lit(" (Client: "), seg, F.lit(")"))).when(
        k % 3 == 1, F.concat(F.col("c_name"), F.lit(" (Redmond)"))).otherwise(F.lit("  ")).alias("name"), nothing.alias("client"))
    second = F.struct(F.upper("c_name").alias("name"), F.when(k % 2 == 0, seg).alias("client"))
    tongue = F.struct(pick(["Dutch (A2)", "English - Native", "German: fluent level", "French (Paris)", "Polish"], k).alias("name"), nothing.alias("level"))
    plain_tongue = F.struct(F.lit(" dutch ").alias("name"), F.lit("B2").alias("level"))
    return table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.col("c_name").alias("full_name"), F.when(k % 4 == 0, F.lit("model@example.com")).alias("email"),
        F.when(k % 5 == 0, F.lit("https://github.com/model")).alias("github_url"), nothing.alias("linkedin_url"),
        F.col("c_nationkey").cast("double").alias("years_experience"), seg.alias("primary_industry"),
        F.struct(pick(CITIES, k).alias("city"), nothing.alias("region"), pick(COUNTRIES, k).alias("country"), seg.alias("raw")).alias("location"),
        F.array(seg, F.lower(seg), F.lit("Machine learning"), F.lit("machine-learning")).alias("skills"),
        F.array(F.initcap(seg), seg, F.lit(" Lead "), F.lit("lead")).alias("recent_titles"), F.array(firm, second, firm).alias("employers"),
        F.array(F.lit("CKA"), F.lit(" cka"), seg).alias("certifications"), F.array(tongue, plain_tongue).alias("spoken_languages"),
        F.array(F.concat(seg, F.lit(" engineer")), F.lit("")).alias("possible_titles"),
        F.when(k % 2 == 0, F.lit(1980)).cast("int").alias("birth_year"), F.lit(44).alias("age_estimate"),
        F.when(k % 2 == 0, F.lit("explicit_cv")).alias("age_source"), F.lit(0.8).alias("confidence"))


def _names(column, second):
    return F.array_join(F.transform(column, lambda e: F.concat(e["name"], F.lit("/"), F.coalesce(e[second], F.lit("-")))), "|")


def merged(spark, sf_dir):
    rows = P.merge_profile(model_profiles(spark, sf_dir), rules(spark, sf_dir), include_age=True)
    return rows.select("doc_id", "email", "github_url", F.coalesce("location.city", F.lit("-")).alias("city"),
                       F.coalesce("location.country", F.lit("-")).alias("country"), F.array_join("skills", "|").alias("skills"),
                       F.array_join("recent_titles", "|").alias("titles"), F.array_join("certifications", "|").alias("certifications"), "birth_year")


def employer_rows(spark, sf_dir):
    return model_profiles(spark, sf_dir).select("doc_id", _names(P.employers(F.col("employers")), "client").alias("employers"))


def tongue_rows(spark, sf_dir):
    return model_profiles(spark, sf_dir).select("doc_id", _names(P.spoken_languages(F.col("spoken_languages")), "level").alias("languages"))


def locations(spark, sf_dir):
    city, country, raw = F.col("location.city"), F.col("location.country"), F.col("location.raw")
    place = P.full_location(city, country, raw)
    return model_profiles(spark, sf_dir).select("doc_id", place["country"].alias("country"), P.search_location(city, country, raw).alias("search"))


def exports(spark, sf_dir):
    rows = P.public_json(P.merge_profile(model_profiles(spark, sf_dir), rules(spark, sf_dir), include_age=True), include_age=True)
    at = lambda path: F.get_json_object("json", path)
    return rows.select("doc_id", at("$.full_name").alias("full_name"), at("$.birth_year").cast("int").alias("birth_year"),
                       at("$.age_source").alias("age_source"), F.contains("json", F.lit("null")).cast("int").alias("has_null"))


def title_contexts(spark, sf_dir):
    rows = P.title_context(P.merge_profile(model_profiles(spark, sf_dir), rules(spark, sf_dir), include_age=True))
    has = lambda word: F.contains("json", F.lit(f'"{word}"')).cast("int")
    return rows.select("doc_id", has("skills").alias("has_skills"), (has("email") + has("phone") + has("birth_year") + has("age_estimate") + has("full_name")).alias("private"))


def answers(spark, sf_dir):
    """Model answers built from customers: fenced, broken, short and complete ones of every kind."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    long = F.concat(F.lit("Explain the trade off in "), seg)
    bodies = F.when(k % 4 == 0, F.to_json(F.struct(
        F.when(k % 3 > 0, F.col("c_name")).alias("full_name"), F.array(seg).alias("skills"), (F.col("c_nationkey") * 4).alias("years_experience"),
        F.lit(0.5).alias("confidence")))).when(k % 4 == 1, F.to_json(F.struct(
            F.when(k % 3 == 0, F.array()).otherwise(F.array(F.concat(seg, F.when(k % 3 == 1, F.lit("")).otherwise(F.lit(" lead"))))).cast("array<string>").alias("possible_titles")))
    ).when(k % 4 == 2, F.to_json(F.struct(F.when(k % 3 > 0, F.lit("Talk")).otherwise(F.lit(" ")).alias("briefing"), F.array(F.struct(
        F.concat(F.lit(" "), seg).alias("prompt"), F.lit("a").alias("anchor"))).alias("stories")))).otherwise(F.to_json(F.struct(
            long.alias("diagnostic"), long.alias("exercise"), F.when(k % 3 > 0, long).otherwise(F.lit("short")).alias("stretch"),
            F.array(F.lit("hint one"), F.lit("hint two")).alias("hints"),
            F.when(k % 5 > 0, F.array(F.lit("check one"), F.lit("check two"))).otherwise(F.array(F.lit("no"))).alias("criteria"))))
    raw = F.when(k % 7 == 0, F.concat(F.lit("```json\n"), bodies, F.lit("\n```"))).when(
        k % 11 == 0, F.left(bodies, F.length(bodies) - 3)).otherwise(bodies)
    kind = pick(["cv", "titles", "stories", "exercise"], k)
    return table(spark, sf_dir, "customer").select(k.alias("answer_id"), kind.alias("kind"), raw.alias("raw"),
                                                   F.array(F.lit("CKA")).alias("certifications"), F.array(seg).alias("recent_titles"))


def checked(spark, sf_dir):
    return P.validate_answers(answers(spark, sf_dir)).select("answer_id", "kind", "outcome", F.array_join("reasons", "|").alias("reasons"))


def rates(spark, sf_dir):
    return P.validation_rates(P.validate_answers(answers(spark, sf_dir))).select("kind", "outcome", "reason", F.col("count").alias("n"))


def _golden(spark, sf_dir):
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    truth = customer.select(k.alias("id"), F.when(k % 5 > 0, F.col("c_name")).alias("full_name"), F.array("c_mktsegment", F.lit("Go"), F.lit("Excel")).alias("skills"),
                            F.when(k % 4 > 0, F.col("c_nationkey").cast("double")).alias("years_experience"),
                            F.when(k % 3 == 0, F.concat(F.lit("https://github.com/"), F.col("c_name"), F.lit("/"))).alias("github_url"))
    guess = customer.where(k % 10 > 0).select(
        k.alias("id"), (k % 20 > 0).alias("valid"), F.when(k % 7 > 0, F.concat(F.upper("c_name"), F.lit("  "))).alias("full_name"),
        F.array(F.lower("c_mktsegment"), F.lit("golang")).alias("skills"), (F.col("c_nationkey") + F.pmod(k, F.lit(3))).cast("double").alias("years_experience"),
        F.when(k % 6 > 0, F.concat(F.lit("https://GitHub.com/"), F.col("c_name"))).alias("github_url"))
    return truth, guess


def scored(spark, sf_dir):
    row = E.gates(E.scores(*_golden(spark, sf_dir)))
    return row.select("n", "valid_json", "name_n", "name_ok", F.round("skills_at_5", 6).alias("skills_at_5"), "years_n", "years_ok", "github_n",
                      "github_ok", F.round("valid_json_rate", 6).alias("valid_json_rate"), F.col("valid_json_gate").cast("int").alias("valid_json_gate"),
                      F.col("github_gate").cast("int").alias("github_gate"))


def language_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(
        L.looks_english(F.col("text")) == (F.col("lang") == "en")).alias("right"))


QUERIES = {
    "l1_looks_english": english, "l2_language_codes": codes, "l3_chunks": chunk_rows, "l4_apply_memory": translated,
    "l4_work_list": open_chunks, "l4_notes": notes, "l5_display_text": shown, "c1_c4_tidy_text": tidy, "c2_repeated_edges": clean_pages,
    "c3_page_markers": whole_documents, "c5_c6_identifiers": hints, "c5_phones": phone_rows, "c7_rules_profile": rule_profiles,
    "c8_merge_profile": merged, "c9_employers": employer_rows, "c10_languages": tongue_rows, "c11_c12_locations": locations,
    "c13_public_export": exports, "c13_title_context": title_contexts, "c14_answer_checks": checked, "c14_rates": rates, "e1_e2_scores": scored, "e1_language_accuracy": language_gate,
}

_TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}]+'), lambda x: lower(x))"


def english_sql(text: str) -> str:
    tokens = _TOKENS.replace("(text,", f"({text},")
    return f"""(CASE WHEN trim({text}) = '' THEN true WHEN len({tokens}) < 12 THEN NOT list_has_any({tokens}, [{Q.in_list(K.FOREIGN_MARKERS)[1:-1]}])
      WHEN len(list_filter({tokens}, lambda t: t IN {Q.in_list(K.FOREIGN_MARKERS)})) >= 4 THEN false
      ELSE len(list_filter({tokens}, lambda t: t IN {Q.in_list(K.ENGLISH_MARKERS)})) / len({tokens}) >= 0.12
       AND len(list_filter({tokens}, lambda t: t IN {Q.in_list(K.ENGLISH_MARKERS)})) > len(list_filter({tokens}, lambda t: t IN {Q.in_list(K.FOREIGN_MARKERS)})) END)"""


_CHUNKS = """parts AS MATERIALIZED (SELECT doc_id, unnest(ps) AS part, unnest(range(len(ps))) AS i, len(ps) AS n, length(whole) AS size FROM (
  SELECT doc_id, trim(replace(text, chr(10), chr(10) || chr(10)), chr(10) || ' ') AS whole,
    string_split_regex(trim(replace(text, chr(10), chr(10) || chr(10)), chr(10) || ' '), '\\n{2,}') AS ps FROM documents)),
packed AS MATERIALIZED (WITH RECURSIVE step(doc_id, i, open, no) AS (
  SELECT doc_id, 0::BIGINT, length(part)::BIGINT, 0 FROM parts WHERE i = 0
  UNION ALL SELECT s.doc_id, s.i + 1, CASE WHEN s.open + 2 + length(p.part) > 1500 THEN length(p.part) ELSE s.open + 2 + length(p.part) END,
    CASE WHEN s.open + 2 + length(p.part) > 1500 THEN s.no + 1 ELSE s.no END
  FROM step s JOIN parts p ON p.doc_id = s.doc_id AND p.i = s.i + 1) SELECT * FROM step),
blocks AS (SELECT doc_id, no, string_agg(part, chr(10) || chr(10) ORDER BY i) AS block FROM packed JOIN parts USING (doc_id, i) GROUP BY ALL),
chunk_rows AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, cut) - 1 AS INTEGER) AS chunk_no,
  substr(block, cut + 1, 1500) AS chunk, sha256(substr(block, cut + 1, 1500)) AS h
  FROM (SELECT *, unnest(range(0, greatest(length(block), 1), 1500)) AS cut FROM blocks))"""
_MEMORY = f"""{_CHUNKS}, memory AS (SELECT DISTINCT h, 'T: ' || chunk AS t FROM chunk_rows JOIN documents USING (doc_id) WHERE lang IN ('fr', 'de')),
flags AS MATERIALIZED (SELECT doc_id, {english_sql('text')} AS english, trim(replace(text, chr(10), chr(10) || chr(10)), chr(10) || ' ') AS whole FROM documents),
looked AS (SELECT c.doc_id, count(*) FILTER (m.t IS NULL) AS n_missing, string_agg(m.t, chr(10) || chr(10) ORDER BY c.chunk_no) AS joined,
  max(CASE WHEN m.t IS NOT NULL THEN 'fr' END) AS found FROM chunk_rows c JOIN flags f USING (doc_id) LEFT JOIN memory m ON m.h = c.h WHERE NOT english GROUP BY ALL),
applied AS (SELECT doc_id, CASE WHEN english THEN 'en' ELSE found END AS source_language, whole,
  CASE WHEN n_missing = 0 THEN regexp_replace(joined, '\\s+$', '') END AS translated_text, CASE WHEN n_missing = 0 THEN 1 ELSE 0 END AS done,
  coalesce(n_missing, 0) AS n_missing FROM flags LEFT JOIN looked USING (doc_id))"""
_PAGES = """pages0 AS (SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN conv_id % 3 = 0 THEN 'CV of ' || conv_id || chr(10)
    WHEN conv_id % 3 = 1 AND turn > 0 THEN 'CV part' || chr(10) ELSE '' END || text ||
    CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '  Page foot ' || conv_id || '  ' ELSE '' END AS text FROM conversations)"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_MODEL = f"""SELECT c_custkey AS doc_id, c_name, c_mktsegment AS seg, {pick_sql(CITIES, 'c_custkey')} AS city, {pick_sql(COUNTRIES, 'c_custkey')} AS country FROM customer"""
_GEO = ("country_names(k, name) AS (" + Q.rows(K.COUNTRY_NAMES.items()) + "), city_names(k, name) AS (" + Q.rows(
    K.CITY_COUNTRY.items()) + ")")
_PLACES = f"""{_GEO}, places AS (SELECT m.*, nullif(trim(city), '') AS c, coalesce(n.name, nullif(trim(country), ''), t.name) AS n
  FROM ({_MODEL}) m LEFT JOIN country_names n ON n.k = replace(lower(trim(country)), '.', '') LEFT JOIN city_names t ON t.k = lower(trim(city)))"""
_HINTS = f"""hints AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}'), lambda x: x)) AS emails,
  regexp_extract_all(text, '(?i)(?:https?://)?(?:www\\.)?github\\.com/([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)', 1) AS users,
  regexp_extract_all(text, '(?i)(?:https?://)?(?:[\\w-]+\\.)?linkedin\\.com/in/([A-Za-z0-9_-]+)/?', 1) AS slugs,
  regexp_extract_all(text, '(?i)((?:19|20)\\d{{2}})\\s*(?:[–-]|to)\\s*((?:19|20)\\d{{2}}|present|now|current)', 1) AS starts,
  regexp_extract_all(text, '(?i)((?:19|20)\\d{{2}})\\s*(?:[–-]|to)\\s*((?:19|20)\\d{{2}}|present|now|current)', 2) AS ends,
  regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b') AS years,
  nullif(regexp_extract(text, '(?i)\\b(\\d{{1,2}})\\+?\\s+years?(?:\\s+of)?(?:\\s+(?:professional|total))?(?:\\s+experience)?\\b', 1), '') AS stated,
  text FROM skill_docs)"""


def _ordered_distinct(column: str, value: str, keep: str = "true") -> str:
    return (f"coalesce((SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT {value} AS v, min(i) AS i FROM "
            f"(SELECT unnest({column}) AS x, unnest(range(len({column}))) AS i) WHERE {keep} GROUP BY v)), '')")


# The telephone pattern without look-around: letters beyond ASCII become "x", so a digit's edge to a word is \b and that of "+" or "(" is \B.
_SEPARATED = "[\\s.\\-]?"
_PHONE_SQL = (f"(?:\\B\\+\\d{{1,3}}{_SEPARATED}(?:\\(?\\d{{2,4}}\\)?{_SEPARATED})?|\\B\\(\\d{{2,4}}\\)?{_SEPARATED}|\\b\\d{{2,4}}\\)?{_SEPARATED}|\\b)"
              f"\\d{{3,4}}{_SEPARATED}\\d{{3,4}}\\b")
_PHONES = f"""phones AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(regexp_replace(text, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]', 'x', 'g'), '{_PHONE_SQL}'),
  lambda p: length(regexp_replace(p, '\\D', '', 'g')) BETWEEN 8 AND 15), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS ps FROM documents)"""

_FIRST_EMAIL = "regexp_extract(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')"

ORACLE = {
    "l1_looks_english": f"SELECT doc_id, lang, CAST({english_sql('text')} AS INTEGER) AS english FROM documents",
    "l2_language_codes": f"""WITH names(code) AS ({Q.rows([(c,) for c in K.LANGUAGE_NAMES])}), alias(k, code) AS ({Q.rows(K.LANGUAGE_ALIASES.items())}),
        r AS (SELECT c_custkey, trim({pick_sql(REQUESTED, 'c_custkey')}) AS raw FROM customer),
        m AS (SELECT r.*, coalesce(alias.code, raw) AS mapped FROM r LEFT JOIN alias ON alias.k = lower(raw)),
        d AS (SELECT *, raw = '' OR lower(raw) IN {Q.in_list(K.LANGUAGE_OFF)} AS off, CASE WHEN mapped IN (SELECT code FROM names) THEN mapped
          WHEN lower(mapped[1:2]) IN (SELECT code FROM names) THEN lower(mapped[1:2]) END AS found FROM m)
        SELECT c_custkey, CASE WHEN off THEN NULL ELSE found END AS code, CAST(off OR found IS NOT NULL AS INTEGER) AS supported FROM d""",
    "l3_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_no, md5(chunk) AS chunk FROM chunk_rows",
    "l4_apply_memory": f"WITH {_MEMORY} SELECT doc_id, source_language, md5(translated_text) AS translated, done, n_missing FROM applied",
    "l4_work_list": f"""WITH {_MEMORY} SELECT h AS chunk_hash, count(*) AS uses FROM chunk_rows JOIN flags USING (doc_id)
        WHERE NOT english AND h NOT IN (SELECT h FROM memory) GROUP BY h""",
    "l4_notes": f"""WITH {_MEMORY}, t AS (SELECT sum(done)::BIGINT AS translated, count(*) FILTER (n_missing > 0) AS failed FROM applied)
        SELECT translated, failed, array_to_string(list_filter([CASE WHEN translated > 0 THEN 'Translated ' || translated ||
          CASE WHEN translated = 1 THEN ' listing' ELSE ' listings' END || ' into English. The original text is kept.' END,
          CASE WHEN failed > 0 THEN 'Could not translate ' || failed || CASE WHEN failed = 1 THEN ' listing' ELSE ' listings' END || '; showing the original text.' END],
          lambda x: x IS NOT NULL), '|') AS notes FROM t""",
    "l5_display_text": f"""WITH {_MEMORY} SELECT a.doc_id, md5(coalesce(translated_text, replace(d.text, chr(10), chr(10) || chr(10)))) AS shown
        FROM applied a JOIN documents d USING (doc_id)""",
    "c1_c4_tidy_text": """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace('  ' || replace(text, '. ', '.  ' || chr(9)), '[ \\t]{2,}', ' ', 'g'),
          '\\n', chr(10) || chr(10), 'g') || chr(10) AS t FROM documents), u AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM t)
        SELECT doc_id, md5(t) AS text, CASE WHEN length(t) < 200 THEN 'low' ELSE 'ok' END AS quality FROM u""",
    "c2_repeated_edges": f"""WITH {_PAGES}, filled AS (SELECT *, string_split(text, chr(10)) AS ls, list_filter(list_transform(string_split(text, chr(10)),
          lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS f FROM pages0),
        heads AS (SELECT doc_id, f[1] AS v, count(*) AS n FROM filled GROUP BY ALL), feet AS (SELECT doc_id, f[-1] AS v, count(*) AS n FROM filled GROUP BY ALL),
        totals AS (SELECT doc_id, count(*) AS n FROM pages0 GROUP BY ALL),
        drops AS (SELECT doc_id, v FROM (SELECT * FROM heads UNION ALL SELECT * FROM feet) JOIN totals USING (doc_id, n) WHERE n > 1 AND length(v) < 80)
        SELECT p.doc_id, p.page_no, md5(CASE WHEN t.n < 2 THEN p.text ELSE {_STRIP.format("array_to_string(list_filter(p.ls, lambda x: NOT list_contains(coalesce(d.vs, []), "
          + _STRIP.format('x') + ")), chr(10))")} END) AS text FROM filled p JOIN totals t USING (doc_id)
        LEFT JOIN (SELECT doc_id, list(DISTINCT v) AS vs FROM drops GROUP BY doc_id) d USING (doc_id)""",
    "c3_page_markers": f"""WITH {_PAGES} SELECT doc_id, md5(string_agg(regexp_replace('--- page ' || (page_no + 1) || ' ---' || chr(10) || text, '\\s+$', ''),
          chr(10) || chr(10) ORDER BY page_no)) AS text FROM pages0 GROUP BY doc_id""",
    "c5_c6_identifiers": f"""WITH {SKILL_DOCUMENTS}, {_HINTS} SELECT doc_id, {_ordered_distinct('emails', 'x')} AS emails,
        {_ordered_distinct('users', "'https://github.com/' || x", 'lower(x) NOT IN ' + Q.in_list(K.GITHUB_RESERVED))} AS github,
        {_ordered_distinct('slugs', "'https://www.linkedin.com/in/' || x")} AS linkedin,
        array_to_string(list_filter(list_transform(list_zip(starts, ends), lambda p: CASE WHEN NOT regexp_matches(p[2], '^\\d+$') THEN p[1] || '-now'
          WHEN p[2] >= p[1] THEN p[1] || '-' || p[2] END), lambda x: x IS NOT NULL), '|') AS ranges,
        {_ordered_distinct('years', 'x', "x BETWEEN '1980' AND '2030'")} AS years, least(CAST(stated AS INTEGER), 60) AS stated FROM hints""",
    "c5_phones": f"""WITH {_PHONES}, p AS (SELECT doc_id, {_ordered_distinct('ps', 'x')} AS phones FROM phones) SELECT doc_id, phones FROM p WHERE phones <> ''""",
    "c7_rules_profile": f"""WITH {SKILL_DOCUMENTS}, {_HINTS}, p AS (SELECT doc_id, nullif({_FIRST_EMAIL}, '') AS email,
          'https://github.com/' || list_filter(users, lambda u: lower(u) NOT IN {Q.in_list(K.GITHUB_RESERVED)})[1] AS github_url,
          'https://www.linkedin.com/in/' || slugs[1] AS linkedin_url, least(CAST(stated AS INTEGER), 60) AS years FROM hints)
        SELECT *, CASE WHEN email IS NOT NULL OR github_url IS NOT NULL THEN 0.25 ELSE 0.1 END::DOUBLE AS confidence FROM p""",
    "c8_merge_profile": f"""WITH {SKILL_DOCUMENTS}, {_HINTS}, {_PLACES}, r AS (SELECT doc_id, nullif({_FIRST_EMAIL}, '') AS email,
          'https://github.com/' || list_filter(users, lambda u: lower(u) NOT IN {Q.in_list(K.GITHUB_RESERVED)})[1] AS github FROM hints)
        SELECT doc_id, coalesce(r.email, CASE WHEN doc_id % 4 = 0 THEN 'model@example.com' END) AS email,
          coalesce(r.github, CASE WHEN doc_id % 5 = 0 THEN 'https://github.com/model' END) AS github_url, coalesce(c, '-') AS city, coalesce(n, '-') AS country,
          seg || '|Machine learning' AS skills, upper(seg[1]) || lower(seg[2:]) || '|Lead' AS titles, 'CKA|' || seg AS certifications,
          CASE WHEN doc_id % 2 = 0 THEN 1980 END AS birth_year FROM places LEFT JOIN r USING (doc_id)""",
    "c9_employers": f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN c_name || '/' || seg WHEN 1 THEN c_name || ' (Redmond)/-|' || upper(c_name) || '/' ||
          CASE WHEN doc_id % 2 = 0 THEN seg ELSE '-' END ELSE upper(c_name) || '/' || CASE WHEN doc_id % 2 = 0 THEN seg ELSE '-' END END AS employers FROM ({_MODEL})""",
    "c10_languages": f"""SELECT doc_id, {pick_sql(['Dutch/A2', 'English/Native|dutch/B2', 'German/fluent|dutch/B2', 'French (Paris)/-|dutch/B2', 'Polish/-|dutch/B2'], 'doc_id')} AS languages
        FROM ({_MODEL})""",
    "c11_c12_locations": f"""WITH {_PLACES} SELECT doc_id, n AS country, CASE WHEN c IS NOT NULL AND n IS NOT NULL THEN
          CASE WHEN contains(lower(c), lower(n)) OR contains(lower(n), lower(c)) THEN c ELSE c || ', ' || n END ELSE coalesce(c, n, seg) END AS search FROM places""",
    "c13_title_context": "SELECT c_custkey AS doc_id, 1 AS has_skills, 0 AS private FROM customer",
    "c13_public_export": """SELECT c_custkey AS doc_id, c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 1980 END AS birth_year,
          CASE WHEN c_custkey % 2 = 0 THEN 'explicit_cv' END AS age_source, 0 AS has_null FROM customer""",
    "e1_e2_scores": """WITH g AS (SELECT c_custkey AS k, c_name, c_nationkey, c_custkey % 10 > 0 AND c_custkey % 20 > 0 AS valid FROM customer), s AS (SELECT count(*) AS n,
          count(*) FILTER (valid) AS valid_json, count(*) FILTER (valid AND k % 5 > 0) AS name_n, count(*) FILTER (valid AND k % 5 > 0 AND k % 7 > 0) AS name_ok,
          round(avg(CASE WHEN valid THEN 2 / 3 END), 6) AS skills_at_5, count(*) FILTER (valid AND k % 4 > 0) AS years_n,
          count(*) FILTER (valid AND k % 4 > 0 AND k % 3 <= 1) AS years_ok, count(*) FILTER (valid AND k % 3 = 0) AS github_n,
          count(*) FILTER (valid AND k % 3 = 0 AND k % 6 > 0) AS github_ok FROM g)
        SELECT *, round(valid_json / n, 6) AS valid_json_rate, CAST(valid_json / n >= 0.9 AS INTEGER) AS valid_json_gate,
          CAST(github_n = 0 OR github_ok / github_n >= 0.8 AS INTEGER) AS github_gate FROM s""",
    "e1_language_accuracy": f"""SELECT lang, count(*) AS n, count(*) FILTER ({english_sql('text')} = (lang = 'en')) AS right FROM documents GROUP BY lang""",
}
_ANSWERS = """WITH a AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_nationkey * 4 AS years, list_extract(['cv','titles','stories','exercise'], CAST(c_custkey % 4 AS INTEGER) + 1) AS kind,
   c_custkey % 11 = 0 AND c_custkey % 7 > 0 AS broken FROM customer),
checked AS (SELECT k AS answer_id, kind, CASE WHEN broken THEN NULL
  WHEN kind = 'cv' THEN concat_ws('|', CASE WHEN years > 60 THEN 'schema: years_experience' END, CASE WHEN k % 3 = 0 THEN 'missing full_name' END)
  WHEN kind = 'titles' THEN CASE k % 3 WHEN 0 THEN 'missing possible_titles' ELSE 'titles ignore certifications' END
  WHEN kind = 'stories' THEN CASE WHEN k % 3 = 0 THEN 'schema: stories' ELSE '' END
  ELSE concat_ws('|', CASE WHEN k % 3 = 0 THEN 'schema: exercise' END, CASE WHEN k % 5 = 0 THEN 'schema: checks' END) END AS reasons FROM a),
outcomes AS (SELECT answer_id, kind, CASE WHEN reasons IS NULL THEN 'json' ELSE reasons END AS reasons FROM checked)"""
ORACLE["c14_answer_checks"] = _ANSWERS + """ SELECT answer_id, kind, CASE WHEN reasons = '' THEN 'ok' WHEN reasons = 'json' OR contains(reasons, 'schema')
  THEN 'reject' ELSE 'repair' END AS outcome, reasons FROM outcomes"""
ORACLE["c14_rates"] = _ANSWERS + """, flat AS (SELECT kind, CASE WHEN reasons = '' THEN 'ok' WHEN reasons = 'json' OR contains(reasons, 'schema')
  THEN 'reject' ELSE 'repair' END AS outcome, nullif(unnest(string_split(reasons, '|')), '') AS reason FROM outcomes)
  SELECT kind, outcome, reason, count(*) AS n FROM flat GROUP BY ALL"""
