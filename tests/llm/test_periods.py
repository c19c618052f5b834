import hashlib
import random
import zlib
from fractions import Fraction

import corpora
import numpy as np
import pytest
from corpora import blank_words

from fitweave.llm import periods


def plain_runs(words):
    """Every period on its own; a stretch with a smaller period is not of this one."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(s <= i and j + q <= s + length for s, length, _ in found):
                found.append((i, j - i + q, q))
            i = j
    return sorted((s, length, q) for s, length, q in found)


def sequences():
    rng = random.Random(9)
    for _ in range(120):
        yield [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(0, 90))]
    for _ in range(120):  # loops inside loops, cut and pasted
        unit = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        inner = (unit * 9)[: rng.randrange(1, 60)] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        yield [rng.randrange(6) for _ in range(rng.randrange(9))] + (inner * 7)[: rng.randrange(1, 300)] + [rng.randrange(6) for _ in range(rng.randrange(9))]
    yield [1] * 1000
    yield [5, 6, 7] * 200 + [8] + [5, 6, 7] * 100
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    yield b  # a Fibonacci word


def test_runs_against_every_period():
    for words in sequences():
        assert periods.find_runs(np.array(words, dtype=np.int64)) == plain_runs(words), words


def test_occurrences_against_comparison():
    rng = np.random.default_rng(4)
    for size in (1, 2, 4, 16, 64):
        words = np.concatenate([rng.integers(0, 2, 150), np.tile(rng.integers(0, 90000, size + size // 3), 6), rng.integers(0, 3, 100)])
        blocks = np.arange(0, len(words) - size + 1, size)
        want = [(b, d) for b in blocks.tolist() for d in range(size, 2 * size) if b + d + size <= len(words) and (words[b : b + size] == words[b + d : b + d + size]).all()]
        starts, distances = periods.occurrences(words, blocks, size)
        assert list(zip(starts.tolist(), distances.tolist())) == want


@pytest.mark.parametrize("prime", periods.PRIMES)
def test_transform_round_trip_and_convolution(prime):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, prime, (3, 16), dtype=np.uint64) for _ in range(2))
    assert np.array_equal(periods.inverse_ntt(periods.ntt(a, prime), prime), a)
    got = periods.inverse_ntt(periods.ntt(a, prime) * periods.ntt(b, prime) % np.uint64(prime), prime)
    want = [[sum(int(a[r, j]) * int(b[r, (k - j) % 16]) for j in range(16)) % prime for k in range(16)] for r in range(3)]
    assert got.tolist() == want


def test_words_of_slices(monkeypatch):
    text = (corpora.sentence(random.Random(1), 500) + " \t\n  " + "y" * 900 + "\x0b  é " + corpora.sentence(random.Random(2), 300)).encode()
    monkeypatch.setattr(periods, "SLICE", 64)
    words, distinct = periods.numbered(text)
    assert [distinct[w].decode() for w in words] == blank_words(text.decode())


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id, text):
    words = looped(doc_id, blank_words(text))
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept), len(words))


def write(spark, df, tmp_path):
    path = str(tmp_path / "in")
    df.write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in periods.op12_periodic_runs(spark, path).collect()), key=repr)


def test_query_against_a_plain_model(spark, tmp_path):
    rng = random.Random(11)
    texts = [t for t in corpora.texts() if len(t or "") < 20_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 200))) for _ in range(120)] + ["the the the the the the end", "a b " * 400, "x y " * 7]
    df = corpora.documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert write(spark, df, tmp_path) == sorted((digest(*r) for r in rows), key=repr)


def test_awkward_tables(spark, tmp_path):
    df = corpora.awkward(spark).where("length(text) < 20000 or text is null")
    assert write(spark, df, tmp_path) == sorted((digest(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert periods.periodic_runs(corpora.empty(spark)).collect() == []


def test_long_text(spark):
    words = corpora.sentence(random.Random(3), 30_000, 900).split()
    text = " ".join(words + words[:20_000] * 5 + ["end"])
    (row,) = periods.periodic_runs(corpora.documents(spark, [text])).collect()
    assert any(r.period == 20_000 and r.length >= 100_000 for r in row.runs) and len(row.collapsed.split()) < 51_000
