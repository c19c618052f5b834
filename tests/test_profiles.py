from pyspark.sql import functions as F

from fitweave.operators import language as L
from fitweave.operators import profiles as P

CONTACT = """
Alex Rivera
alex.rivera@example.com
+1 (415) 555-0102
https://github.com/arivera-dev
https://www.linkedin.com/in/alex-rivera
Experience: 2019 - 2022 and 2022 - Present
See also github.com/features/actions
"""
DUTCH = "Wij zoeken een ervaren engineer. Je werkt met Azure en Terraform voor onze klanten in Amsterdam. De functie is hybrid."
ENGLISH = "We are looking for an experienced engineer. You will work with Azure and Terraform for our customers in Amsterdam. The role is hybrid."


def test_identifiers(spark):
    texts = [CONTACT, "Contact github.com/foo-bar and linkedin.com/in/foo_bar", "Room 12 page 34 year 2020",
             "Software engineer with 6 years building APIs. 2014 - 2018 B.Sc."]
    rows = P.identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert rows[0].emails == ["alex.rivera@example.com"] and rows[0].github_urls == ["https://github.com/arivera-dev"]
    assert rows[0].linkedin_urls == ["https://www.linkedin.com/in/alex-rivera"] and rows[0].phones
    assert [tuple(r) for r in rows[0].year_ranges] == [(2019, 2022), (2022, None)]
    assert rows[1].github_urls == ["https://github.com/foo-bar"] and rows[1].linkedin_urls == ["https://www.linkedin.com/in/foo_bar"]
    assert rows[2].phones == [] and rows[3].stated_years == 6.0


def test_employers_and_languages(spark):
    rows = spark.createDataFrame([([("Northwind (Client: Contoso)", None), ("Fabrikam B.V.", "Contoso"), ("Microsoft (Redmond)", None), ("northwind", None), ("", None)],
                                   [("English (Native)", None), ("english", None), ("Dutch - A2", None), ("French", None)])],
                                 "e array<struct<name:string,client:string>>, l array<struct<name:string,level:string>>")
    row = rows.select(P.employers(F.col("e")).alias("e"), P.spoken_languages(F.col("l")).alias("l")).first()
    assert [tuple(x) for x in row.e] == [("Northwind", "Contoso"), ("Fabrikam B.V.", "Contoso"), ("Microsoft (Redmond)", None)]
    assert [tuple(x) for x in row.l] == [("English", "Native"), ("Dutch", "A2"), ("French", None)]


def test_search_locations(spark):
    rows = spark.createDataFrame([("Amsterdam", "NL", None), ("Berlin", None, None), (None, "Germany", None), ("Springfield", None, None),
                                  (None, None, None), (None, None, "Remote"), ("Singapore", "SG", None)], "c string, n string, r string")
    got = [r.s for r in rows.select(P.search_location(F.col("c"), F.col("n"), F.col("r")).alias("s")).collect()]
    assert got == ["Amsterdam, Netherlands", "Berlin, Germany", "Germany", "Springfield", None, "Remote", "Singapore"]


def test_repeated_edges_are_dropped_only_when_on_every_page(spark):
    pages = spark.createDataFrame([(1, 1, "Head\nA\nfoot"), (1, 2, "Head\nB\nHead\nother"), (2, 1, "Head\nA"), (3, 1, "H\nA"), (3, 2, "  ")],
                                  "doc_id int, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in P.drop_repeated_edges(pages).collect()}
    assert got == {(1, 1): "A\nfoot", (1, 2): "B\nother", (2, 1): "Head\nA", (3, 1): "H\nA", (3, 2): ""}


def test_language_rule_and_codes(spark):
    rows = spark.createDataFrame([(ENGLISH,), (DUTCH,), ("Build services with Python, SQL and Docker.",), (" ",), ("Привет the and to of",)], "t string")
    assert [r.e for r in rows.select(L.looks_english(F.col("t")).alias("e")).collect()] == [True, False, True, True, False]
    rows = spark.createDataFrame([("EN",), ("zh",), ("off",), ("pt-BR",), ("klingon",)], "t string")
    assert [r.c for r in rows.select(L.language_code(F.col("t")).alias("c")).collect()] == ["en", "zh-CN", None, "pt", None]


def test_chunks(spark):
    def plain(text, limit):
        if len(text) <= limit:
            return [text]
        done, part = [], []
        import re
        for piece in re.split(r"\n{2,}", text):
            if part and len("\n\n".join(part)) + 2 + len(piece) > limit:
                done.append("\n\n".join(part))
                part = []
            part.append(piece)
        done.append("\n\n".join(part))
        return [c[i:i + limit] for c in done for i in range(0, max(len(c), 1), limit)]
    texts = ["a" * 10, ("para\n\n" * 40) + "end", "x" * 75 + "\n\ny\n\n\nz", "\n\n" + "b" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(L.chunks(F.col("t"), 30).alias("c")).collect()
    assert [r.c for r in rows] == [plain(t, 30) for t in texts]


def test_translation_memory(spark):
    texts = spark.createDataFrame([(1, ENGLISH), (2, DUTCH), (3, DUTCH + " Meer.")], "doc_id int, text string")
    known = L.chunk_table(texts.where("doc_id = 2")).select("chunk_hash", F.lit("en").alias("target"), F.lit(ENGLISH).alias("translated"), F.lit("nl").alias("detected"))
    rows = {r.doc_id: r for r in L.apply_memory(texts, known).collect()}
    assert not rows[1].is_translated and rows[1].source_language == "en"
    assert rows[2].is_translated and rows[2].translated_text == ENGLISH and rows[2].source_language == "nl"
    assert not rows[3].is_translated and rows[3].n_missing == 1
    assert L.work_list(texts, known).count() == 1


def test_a_long_document_is_one_row(spark):
    pages = spark.range(1, 402).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.concat(F.lit("page "), "id", F.lit(" mail me@site.example")).alias("text"))
    rows = P.documents(pages).collect()
    assert len(rows) == 1 and rows[0].text.count("--- page ") == 401 and rows[0].text.endswith("page 401 mail me@site.example")
    assert P.identifiers(P.documents(pages)).first().emails == ["me@site.example"]
