import random

import corpora
import numpy as np
import pyarrow as pa
from corpora import sentence
from pyspark.sql import functions as F

from fitweave.llm import quality, toxicity
from fitweave.llm.steps import crc_fold

BAD = ["moron", "worthless", "pathetic", "stupid"]


def toxic_texts(rng, n):
    out = []
    for i in range(n):
        words = sentence(rng, rng.choice([20, 60, 400]), 900).split()
        if i % 3 == 0:
            for _ in range(3):
                place = rng.randrange(len(words))
                words[place : place + 1] = [rng.choice(BAD), words[place]]
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_toxic_words_and_their_misspellings(spark):
    rng = random.Random(5)
    train = toxic_texts(rng, 600)
    model = toxicity.train([t for t, _ in train], np.array([y for _, y in train]))
    test = toxic_texts(rng, 200)
    p = toxicity.score(pa.array([t for t, _ in test]), model)
    assert np.mean((p >= 0.5) == np.array([y for _, y in test])) > 0.95
    odd = [sentence(rng, 20, 900) + f" {x} " + sentence(rng, 20, 900) for x in ("morron", "worthles", "patheticc", "stupidd")] * 5
    clean = [sentence(rng, 40, 900) for _ in odd]
    scores = toxicity.score(pa.array(odd), model), toxicity.score(pa.array(clean), model)
    assert np.mean(scores[0]) > 5 * np.mean(scores[1])  # one misspelling among forty words, none seen in training


def test_score_is_the_mean_of_slots_of_the_worst_passage():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 1, toxicity.SLOTS).astype(np.float32), 0.3)
    text = sentence(random.Random(2), 100)
    starts, ends, _, _, spans = toxicity._words(pa.array([text]))
    slots, counts = toxicity._word_slots(starts, ends, spans)
    words = [model.slots[s].astype(float).mean() for s in np.split(slots, np.cumsum(counts)[:-1])]
    best = max(sum(words[a : a + 32]) / 36 for a in [0, 16, 32, 48, 64, 68])
    assert abs(toxicity.score(pa.array([text]), model)[0] - 1 / (1 + np.exp(-best - 0.3))) < 1e-6


def test_toxicity_query_learns_from_the_right_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t, y) for i, (t, y) in enumerate(toxic_texts(rng, 400))] + [(900, None, None), (901, "", None), (None, "hello", None)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = crc_fold("doc_id", 5) == 0
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    # wrong labels on held-out rows must not matter
    labels = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and truth.get(r.doc_id) is not None]) > 0.9
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901))


def test_measures_against_plain_counts():
    docs = corpora.texts()
    got = dict(zip(quality.MEASURES, quality.measure(pa.array(docs, pa.string())).T))
    for i, text in enumerate(docs):
        w = corpora.blank_words(corpora.lower(text))
        if not w:
            assert all(got[m][i] == 0 for m in quality.MEASURES)
            continue
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        lines = [x for x in corpora.lower(text).split("\n") if x]
        assert np.isclose(got["log_words"][i], np.log1p(len(w)))
        assert np.isclose(got["distinct_words"][i], len(set(w)) / len(w))
        assert np.isclose(got["distinct_windows"][i], len(set(grams)) / max(1, len(grams)))
        assert np.isclose(got["distinct_lines"][i], len(set(lines)) / len(lines))
        assert np.isclose(got["said_again"][i], sum(a == b for a, b in zip(w, w[1:])) / len(w))
        assert np.isclose(got["upper"][i], sum(c.isascii() and c.isupper() for c in text) / len(text.encode()))


def test_additive_model_learns_tables_and_an_interaction():
    rng = np.random.default_rng(3)
    rows = rng.uniform(0, 1, (6000, len(quality.MEASURES)))
    truth = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.4)) | (rows[:, 2] > 0.9)
    model = quality.train(rows[:4000], truth[:4000].astype(float))
    assert np.mean((quality.score(rows[4000:], model) > 0.5) == truth[4000:]) > 0.95
    assert (1, 0) in model.pairs
    z = np.full(5, model.bias)
    for i in range(5):  # a score is the sum of the cells
        z[i] += sum(t[np.searchsorted(e, rows[i, k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
        z[i] += sum(g[np.searchsorted(model.coarse[a], rows[i, a], side="right"), np.searchsorted(model.coarse[b], rows[i, b], side="right")] for (a, b), g in zip(model.pairs, model.pair_tables))
    assert np.allclose(quality.score(rows[:5], model), 1 / (1 + np.exp(-z)))


def test_defined_results_of_both(spark):
    df, none = corpora.awkward(spark), corpora.empty(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (5, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    for rows, known in ((df, labels), (df, labels.limit(0)), (none, labels)):
        measured = quality.measured(rows)
        got = quality.quality(measured, quality.fit(measured, known, F.lit(True))).collect()
        also = toxicity.toxicity(rows, toxicity.fit(rows, known, F.lit(True))).collect()
        assert len(got) == len(also) == rows.count()
        assert all(0 <= r.score <= 1 for r in [*got, *also])
