import hashlib
import random
from collections import Counter

import corpora
import numpy as np
from corpora import sentence

from fitweave.llm import repeats


def model(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist())), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def found(df):
    return sorted((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in repeats.without_repeats(df).collect())


def test_against_a_count_of_all_strings(spark):
    rng = random.Random(9)
    rows = corpora.texts()[:-8] + [sentence(rng, 2000, 3000)]
    common = sentence(rng, 90)
    for length in (195, 199, 200, 201, 202, 230, 263, 264, 330):  # shared strings about the threshold, at any place
        for _ in range(3):
            rows.append(sentence(rng, rng.randrange(0, 60)) + common[rng.randrange(0, 8) :][:length] + sentence(rng, rng.randrange(0, 60)))
    rows += ["ab" * 300, "ab" * 100 + "c", "x" + "ab" * 100, "q" * 200, "q" * 199, "q" * 401, common * 3, common[:200], common[1:201]]
    got = found(corpora.documents(spark, rows))
    assert got == model([(100 + i, t) for i, t in enumerate(rows)])


def test_hot_copies_with_different_edges(spark):
    rng = random.Random(2)
    passage = sentence(rng, 60)
    rows = [f"{sentence(rng, 20)}{passage[k % 7 : len(passage) - k % 5]}{sentence(rng, 20)}" for k in range(60)] + [passage] * 30
    assert found(corpora.documents(spark, rows)) == model([(100 + i, t) for i, t in enumerate(rows)])


def test_defined_results(spark):
    df = corpora.awkward(spark)
    got = repeats.without_repeats(df).collect()
    assert len(got) == df.count()
    whole = [r for r in got if r.doc_id == 5 and r.n_bytes >= 200]
    assert len(whole) >= 3  # equal rows count as occurrences of each other
    want = model([(0, r.text) for r in df.collect()])
    assert sorted((len(r.spans), bytes(r.kept)) for r in got) == sorted((len(s), k) for _, _, s, k in want)
    assert repeats.without_repeats(corpora.empty(spark)).collect() == []


def test_query_digest(spark, tmp_path):
    rows = [(1, "z" * 250), (2, None), (3, "short")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op5_repeats(spark, str(tmp_path)).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {1: (250, 250, 1, digest(b"")), 2: (0, 0, 0, digest(b"")), 3: (5, 0, 0, digest(b"short"))}
