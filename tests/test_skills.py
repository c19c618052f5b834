import random

from pyspark.sql import functions as F

from fitweave.operators import skills as S
from fitweave.plans.overlap_topk import overlap_topk
from fitweave.plans.posting_rank import rank_by_text

LISTED = ["Python", "Java", "GitHub Actions", "Jenkins", "Jenkins Pipelines", "GitLab CI/CD", "Docker"]


def mentions(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.m for r in rows.orderBy("i").select(S.base_mentions(F.col("t")).alias("m")).collect()]


def compare(spark, found, listed):
    postings = spark.createDataFrame([(1, i, x) for i, x in enumerate(found)], "posting_id int, ord int, label string")
    profile = spark.createDataFrame([(7, i, x) for i, x in enumerate(listed)], "profile_id int, ord int, label string")
    pairs = spark.createDataFrame([(7, 1)], "profile_id int, posting_id int")
    rows = S.compare(pairs, postings, profile).orderBy("ord").collect()
    return {r.name: r.via for r in rows if r.matched}, [r.name for r in rows if not r.matched]


def test_mentions_respect_boundaries_and_order(spark):
    found = mentions(spark, "Excellent communication and Python.", "JavaScript and C++ plus PostgreSQL", "Use Azure DevOps pipelines.",
                     "Azure, Azure DevOps", "ci cd", "", "GitHub Actions, .NET and Node.js; gopher", "Red Hat Enterprise Linux")
    assert found[0] == ["Python"]
    assert found[1] == ["JavaScript", "C++", "PostgreSQL"]
    assert "Azure" not in found[2] and "Azure DevOps" in found[2]
    assert "Azure" in found[3]
    assert {"CI/CD", "CI CD"} <= set(found[4])
    assert found[5] == []
    assert set(found[6]) == {"Node.js", "GitHub Actions", "GitHub"}
    assert {"Linux", "RHEL" if False else "Red Hat", "Red Hat Enterprise Linux"} <= set(found[7])


def test_large_vocabulary_equals_plain_check(spark):
    docs = spark.createDataFrame([(1, "We use React, SQL and My.Special[Tool]!"), (2, "naïve C++11 or c++"), (3, "日本 語 text"), (4, "a Custom Skill.")], "doc_id int, text string")
    labels = spark.createDataFrame([("My.Special[Tool]",), ("C++",), ("日本",), ("custom skill",), ("special",), ("Tool",), ("reac",)], "label string")
    got = {(r.doc_id, r.label) for r in S.vocabulary_mentions(docs, labels).collect()}
    assert got == {(1, "My.Special[Tool]"), (1, "special"), (1, "Tool"), (2, "C++"), (3, "日本"), (4, "custom skill")}


def test_tools_cover_umbrellas_but_not_siblings(spark):
    matched, missing = compare(spark, ["Jenkins", "PostgreSQL", "Docker"], ["CI/CD", "SQL", "Containers"])
    assert matched == {} and missing == ["Jenkins", "PostgreSQL", "Docker"]
    assert compare(spark, ["CI/CD"], ["Jenkins"])[0] == {"CI/CD": ["Jenkins"]}
    matched, missing = compare(spark, ["AWS", "Azure", "PowerShell", "Kubernetes", "Terraform"], LISTED)
    assert not matched and len(missing) == 5
    matched, _ = compare(spark, ["Linux", "Git", "Jenkins"], ["RHEL", "GitHub", "Jenkins Pipelines"])
    assert list(matched) == ["Linux", "Git", "Jenkins"]


def test_aliases_count_once_and_via_names_the_longest_label(spark):
    matched, missing = compare(spark, ["Kubernetes", "K8s", "AWS", "Amazon Web Services"], ["K8s"])
    assert matched == {"Kubernetes": ["K8s"]} and missing == ["AWS"]
    matched, _ = compare(spark, ["CI/CD", "Azure"], LISTED + ["Azure, Azure DevOps"])
    assert matched["CI/CD"] == ["GitHub Actions", "Jenkins Pipelines", "GitLab CI/CD"]
    assert matched["Azure"] == ["Azure, Azure DevOps"]
    assert compare(spark, ["Python"], ["python", "Python developer"])[0] == {"Python": []}


def test_text_rank_counts_own_labels(spark):
    postings = spark.createDataFrame([(1, 1, "Build with React, SQL and a Custom Skill."), (2, 2, "SQL only"), (3, 3, "React")], "posting_id int, ord int, text string")
    profile = spark.createDataFrame([(9, 0, "React"), (9, 1, "Custom Skill"), (9, 2, "Figma")], "profile_id int, ord int, label string")
    rows = rank_by_text(postings, profile, 5).orderBy("rank").collect()
    assert [(r.posting_id, r.n_matched, r.score) for r in rows] == [(1, 2, 0.6667), (3, 1, 0.3333)]


def test_overlap_topk_equals_brute_force(spark):
    rng = random.Random(7)
    for k in (1, 3, 6):
        # item 0 is in most sets: the hot item must not change the result
        profiles = {p: {0} | {rng.randint(0, 12) for _ in range(rng.randint(1, 5))} for p in range(25)}
        postings = {q: ({0} if rng.random() < 0.7 else set()) | {rng.randint(0, 12) for _ in range(rng.randint(1, 4))} for q in range(60)}
        expected = {}
        for p, own in profiles.items():
            scored = sorted(((-len(own & items), q) for q, items in postings.items() if own & items))[:k]
            expected[p] = [(q, -n) for n, q in scored]
        left = spark.createDataFrame([(p, str(i)) for p, s in profiles.items() for i in s], "profile_id int, item string")
        right = spark.createDataFrame([(q, q, str(i)) for q, s in postings.items() for i in s], "posting_id int, ord int, item string")
        got = {}
        for r in overlap_topk(left, right, k).orderBy("profile_id", "rank").collect():
            got.setdefault(r.profile_id, []).append((r.posting_id, r.n_matched))
        assert got == expected


def test_search_terms_and_skill_list(spark):
    rows = spark.createDataFrame([(["A \"x\"", "B", "C", "D"], ["R"]), ([], ["R", "S"]), (None, None)], "p array<string>, r array<string>")
    assert [r.t for r in rows.select(S.search_terms(F.col("p"), F.col("r")).alias("t")).collect()] == ['"A x" OR "B" OR "C"', '"R" OR "S"', None]
    rows = spark.createDataFrame([(["PlatformEngineering", "Platform Engineering", "JavaScript", "java script", " ", "CI-CD", "CICD"],)], "s array<string>")
    assert rows.select(S.tidy_skill_list(F.col("s")).alias("t")).first().t == ["Platform Engineering", "JavaScript", "CI-CD"]
