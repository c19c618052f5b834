import hashlib
import random

from fitweave.operators import letters as A
from fitweave.operators import profiles as P
from fitweave.plans.overlap_topk import overlap_topk
from fitweave.workloads import reports, texts
from fitweave.workloads.evidence import best_requirements
from fitweave.workloads.postings import d9

DOCUMENTS = "doc_id long, text string, lang string, source string"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_d9_shuffles_texts_not_words(spark, tmp_path):
    pool = random.Random(5)
    made = [(i, " ".join(pool.choice(["a", "A", "Bb", "bB", " ", "\n", "\tc", "é", "É"]) for _ in range(pool.randrange(30)))) for i in range(40)]
    made += [(3, "zz A\nq"), (4, None), (None, "lost"), (50, " \n "), (51, None)]
    folder = stored(spark, tmp_path, documents=([(i, t, "en", "s") for i, t in made], DOCUMENTS))
    by_id = {}
    for i, text in made:
        if i is not None and text is not None:
            by_id.setdefault(i, []).extend((place, word.strip(" ")) for place, word in enumerate(text.replace("\n", " ").split(" ")))

    def model(i):
        first = {}
        for place, word in sorted(by_id.get(i, [])):
            if word:
                first.setdefault(word.lower(), word)
        return hashlib.md5("|".join(first.values()).encode()).hexdigest() if first else None

    got = d9(spark, folder)
    planned = plan(got).split("== Physical Plan ==")[1]
    assert planned.count("Exchange") == 1 and "posexplode" not in plan(got)
    assert sorted((r.doc_id, r.words) for r in got.collect()) == sorted((i, model(i)) for i, _ in made if i is not None and model(i))


def test_costly_work_on_texts_does_not_depend_on_the_number_of_files(spark, tmp_path):
    folder = stored(
        spark, tmp_path, documents=([(1, "erin thwh", "en", "s")], DOCUMENTS),
        conversations=([(1, 0, "user", "hi"), (1, 1, "assistant", "I know Go.")], "conv_id long, turn long, role string, text string"),
        customer=([(1, "Ann", 2, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"))
    for query in (best_requirements, texts.exports, reports.claims, reports.audit_rows, reports.revisions):
        assert "REBALANCE_PARTITIONS" in plan(query(spark, folder)).split("== Physical Plan ==")[1], query


def test_claims_join_letters_once(spark):
    letters = spark.createDataFrame([(1, "I use K8s daily. I do not use Docker! Go, my own, is fine"), (1, "Docker"), (None, "Go"), (2, None)], "letter_id long, letter string")
    gaps = spark.createDataFrame([(1, 0, "Kubernetes"), (1, 1, "Docker"), (1, 2, "Go"), (1, 3, "Rust"), (1, 4, None), (2, 0, "Go"), (None, 0, "Go")], "letter_id long, ord int, name string")
    got = A.unsupported_claims(letters, gaps)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "Kubernetes"), (1, 1, "Docker"), (1, 2, "Go")]
    assert not any("Exchange" in line and "sentence" in line for line in plan(got).splitlines())
    assert "anchor#" not in "".join(line for line in plan(got).split("== Physical Plan ==")[1].splitlines() if "Join" in line)


def test_texts_without_the_sign_are_not_searched(spark):
    rows = spark.createDataFrame([(1, "GitHub.COM/ab x@y.org www.LinkedIn.com/in/c"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.identifiers(rows).select("doc_id", "emails", "github_urls", "linkedin_urls").collect()}
    assert (got[1].emails, got[1].github_urls, got[1].linkedin_urls) == (["x@y.org"], ["https://github.com/ab"], ["https://www.linkedin.com/in/c"])
    assert (got[2].emails, got[2].github_urls, got[3].emails) == ([], [], None)


def test_ranking_shuffles_no_profile_sets_by_posting(spark):
    rng = random.Random(8)
    profiles = {p: {rng.randrange(30) for _ in range(12)} for p in range(20)}
    postings = {p: {rng.randrange(30) for _ in range(4)} for p in range(200)}
    rows = lambda sets, schema: spark.createDataFrame([(p, *[p] * ("ord" in schema), f"i{i}") for p, items in sets.items() for i in items], schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = overlap_topk(rows(profiles, "profile_id long, item string"), rows(postings, "posting_id long, ord long, item string"), 3)
        lines = plan(got).split("== Physical Plan ==")[1].splitlines()
        below = [child for line, child in zip(lines, lines[1:]) if "Exchange hashpartitioning(sig#" in line]
        assert below and not any("own#" in child for child in below)
        found = sorted((r.profile_id, r["rank"], r.posting_id, r.n_matched) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = []
    for p, own in profiles.items():
        best = sorted((-len(own & items), q) for q, items in postings.items() if own & items)[:3]
        want += [(p, i + 1, q, -n) for i, (n, q) in enumerate(best)]
    assert found == sorted(want)
