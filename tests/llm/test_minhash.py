import random
from itertools import combinations

import corpora
import numpy as np
from corpora import blank_words, documents, lower, sentence

from fitweave.llm import graph, minhash


def model(rows):
    """(set size, component) of each id by comparing all pairs of sets."""
    sets = {}
    for i, text in rows:
        w = blank_words(lower(text))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    want = model([(100 + i, t) for i, t in enumerate(rows)])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_against_all_pairs(spark):
    check(spark, corpora.texts())


def test_groups_of_many_variants(spark):
    """Variants far enough apart that a bucket holds several components, chains included."""
    rng = random.Random(4)
    rows = []
    for _ in range(3):
        base = sentence(rng, 120).split()
        for k in range(40):
            words = list(base)
            for place in rng.sample(range(120), rng.choice([1, 2, 3, 5, 8])):
                words[place] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(words))
        chain = list(base)
        for k in range(0, 60, 3):
            chain[k] = f"c{rng.randrange(10**6)}"
            rows.append(" ".join(chain))
    rng.shuffle(rows)
    check(spark, rows)


def test_defined_results(spark):
    got = minhash.near_duplicates(corpora.awkward(spark)).collect()
    assert len(got) == corpora.awkward(spark).count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id is not None and r.n_shingles == 0)
    assert len({r.component_id for r in got if r.doc_id == 5}) == 1  # one id is one document
    assert minhash.near_duplicates(corpora.empty(spark)).collect() == []


def test_estimate_follows_the_similarity(spark):
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.75, 0.9):
        common = rng.integers(1, 2**62, 1000).astype(np.uint64)
        cut = int(1000 * 2 * share / (1 + share))
        one, two = common, np.concatenate([common[:cut], rng.integers(1, 2**62, 1000 - cut).astype(np.uint64)])
        for bits, minima in ((minhash.BITS, minhash.MINIMA), (1, minhash.LONG_MINIMA)):
            rows = [[int(x) for x in minhash._sketch(minhash._minima(v, minima), bits).view(np.int64)] for v in (one, two)]
            df = spark.createDataFrame([tuple(rows)], "a array<bigint>, b array<bigint>")
            got = df.select(minhash.estimated_similarity(df.a, df.b, bits, minima).alias("s")).first().s
            assert abs(got - share) < 0.12


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + star + [(5000, 5001), (5001, 5000), (6000, 6000)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
