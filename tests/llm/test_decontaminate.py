import hashlib
import random
import re

import corpora
from corpora import lower, sentence

from fitweave.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def model(docs, items):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if items_there := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_there
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_against_a_plain_search(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 7, 12, 13, 14, 30, 60, 1])] + [(8, ""), (9, None), (None, sentence(rng, 20)), (11, "!!! ...")]
    items += [(12, items[5][1]), (13, "the " * 30), (5, sentence(rng, 15))]
    docs = []
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        docs += [sentence(rng, 60) + " " + (text or "") + " " + sentence(rng, 50), " ".join(w[2:16]), f"{sentence(rng, 5)}, {(text or '').upper()}! {sentence(rng, 300)}"]
    docs += ["the " * 13, "the " * 12, *corpora.texts(), " ".join(t or "" for _, t in items)]
    rows = list(enumerate(docs))
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in got.collect())
    assert got == model(rows, items)
    assert sum(r[4] for r in got) > 10


def test_defined_results(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen", 1)], "item_id bigint, text string, row bigint")
    none = items.limit(0)
    docs = corpora.awkward(spark)
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)
    assert all(r.n_hit == 0 and r.item_ids == [] for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(corpora.empty(spark), items).collect() == []


def test_query_digest(spark, tmp_path):
    text = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5"
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, text), (2, text)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in decontaminate.op10_decontamination(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (14, 14, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"10,2").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
