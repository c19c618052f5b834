import re
from collections import Counter

import corpora
from corpora import blank_words

from fitweave.llm import rules

DOCS = ["", None, "  \n\t", "a b c a b c", "a b c a b", "one two\none two\n\none two", "x x x x x x", "# * $ % & | < > ##", "- a\n* b\n• c\n- d\n- e", "wait...\nwait…\nno\nok", "É é Ñ ñ ß 東京 " * 20, "HEY! " * 60]


def model(text):
    t = text or ""
    w = blank_words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    repeated = {p for i, g in enumerate(grams) if counts[g] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if blank_words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))


def test_measurements_against_a_plain_count(spark):
    docs = DOCS + corpora.texts()
    got = {r.doc_id: r for r in rules.ledger(corpora.documents(spark, docs, 0)).collect()}
    for i, text in enumerate(docs):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == model(text), text
        assert bool(r.failed_rules & rules.BIT["few_words"]) == (r.n_words < 50)
        assert bool(r.failed_rules & rules.BIT["repeated_windows"]) == (r.n_words > 0 and 100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablations_read_the_ledger_only(spark):
    entries = rules.ledger(corpora.documents(spark, DOCS + corpora.texts(), 0)).select("doc_id", "failed_rules").cache()
    bits = [r.failed_rules for r in entries.collect()]
    for policy in rules.POLICIES:
        assert entries.where(rules.kept_by(policy)).count() == sum(not b & policy.mask for b in bits)
    got = {(r.version, r.rule): r for r in rules.ablations(entries, rules.POLICIES).collect()}
    assert len(got) == sum(len(p.rules) for p in rules.POLICIES)
    for policy in rules.POLICIES:
        for rule in policy.rules:
            r, bit = got[policy.version, rule], rules.BIT[rule]
            assert r.n_docs == len(bits)
            assert r.n_kept == sum(not b & policy.mask for b in bits)
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_failed_alone == sum(b & policy.mask == bit for b in bits)
            assert r.n_kept_without == sum(not b & policy.mask & ~bit for b in bits)


def test_verdicts_of_all_policies(spark):
    rows = rules.judged(rules.ledger(corpora.documents(spark, DOCS + corpora.texts(), 0)), rules.POLICIES).collect()
    mask = rules.POLICIES[-1].mask
    for r in rows:
        assert [r[f"kept_{p.version}"] for p in rules.POLICIES] == [not r.failed_rules & p.mask for p in rules.POLICIES]
        sole = [rule for rule, bit in rules.BIT.items() if r.failed_rules & mask == bit]
        assert r.sole_rule == (sole[0] if sole else None)
        assert r.n_kept_without == (sum(not o.failed_rules & mask & ~rules.BIT[sole[0]] for o in rows) if sole else None)
    assert any(r.sole_rule for r in rows)
    assert rules.judged(rules.ledger(corpora.empty(spark)), rules.POLICIES).collect() == []


def test_defined_results(spark):
    df = corpora.awkward(spark)
    assert rules.ledger(df).count() == df.count()
    assert rules.ledger(corpora.empty(spark)).collect() == []
    assert rules.ablations(rules.ledger(corpora.empty(spark)), rules.POLICIES).collect() == []
    assert {r.failed_rules for r in rules.ledger(corpora.documents(spark, ["", None, " \n"])).collect()} == {rules.BIT["few_words"]}
