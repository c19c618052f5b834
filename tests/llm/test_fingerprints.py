import hashlib
import random

import numpy as np
import pytest

from fitweave.llm import fingerprints as fp
from fitweave.llm.bytesops import Spans
import corpora


def plain_marks(text: bytes, window: int):
    """Every window looked at on its own."""
    grams = (Spans(np.frombuffer(text, dtype=np.uint8)).grams(fp.GRAM) >> np.uint64(32)).tolist()
    kept = set()
    for low in range(max(1, len(grams) - window + 1)):
        some = grams[low : low + window]
        least = min(some)
        kept.add(low + max(i for i, g in enumerate(some) if g == least))
    return [(i, grams[i]) for i in sorted(kept)]


def marks(text: bytes):
    window, places, hashes = fp.winnow(text)
    return window, list(zip(places.tolist(), hashes.tolist()))


@pytest.mark.parametrize("size", [17, 18, 25, 100, 700, 2000, 6000, 9000])
def test_marks_are_those_of_all_windows(size):
    rng = random.Random(size)
    for text in (rng.randbytes(size), b"ab" * (size // 2), bytes(size), corpora.sentence(rng, size // 4).encode()[:size]):
        window, found = marks(text)
        assert found == plain_marks(text, window)
        for wide in (w for w in (8, 16, 32, 64, 128) if w > window):
            places, hashes = fp.coarser(len(text), window, wide, np.array([p for p, _ in found]), np.array([h for _, h in found], dtype=np.uint32))
            assert list(zip(places.tolist(), hashes.tolist())) == plain_marks(text, min(wide, len(text) - fp.GRAM + 1))


def test_blocks_of_a_long_text_leave_no_trace(monkeypatch):
    text = corpora.sentence(random.Random(2), 60_000, 3000).encode()
    whole = marks(text)
    monkeypatch.setattr(fp, "BLOCK", 5000)
    assert marks(text) == whole


def test_every_long_shared_span_is_found():
    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randrange(200, 9000), rng.randrange(200, 9000)
        a, b = rng.randbytes(n), rng.randbytes(m)
        window = max(fp.window_of(n - fp.GRAM + 1), fp.window_of(m - fp.GRAM + 1))
        size = window + fp.GRAM - 1
        if size > min(n, m):
            continue
        at, to = rng.randrange(n - size + 1), rng.randrange(m - size + 1)
        b = b[:to] + a[at : at + size] + b[to + size :]
        found = fp.matches(fp.encode(n, fp.winnow(a)), fp.encode(m, fp.winnow(b)))
        assert any(at <= p < at + size and q - to == p - at for p, q in found)


def test_decode_and_likeness():
    rng = random.Random(6)
    texts = [t.encode() for t in corpora.texts() if t] + [b"", b"x", bytes(5000)]
    prints = [fp.encode(len(t), fp.winnow(t)) for t in texts]
    for text, mark in zip(texts, prints):
        n, window, places, hashes = fp.decode(mark)
        assert (n, window, list(zip(places.tolist(), hashes.tolist()))) == (len(text), *marks(text))
        assert fp.like(mark, mark) == 1
    assert fp.like(prints[-3], prints[-2]) == 0
    a = corpora.sentence(rng, 800, 10**6).encode()
    b = a[: len(a) * 2 // 3] + corpora.sentence(rng, 267, 10**6).encode()
    c = corpora.sentence(rng, 800, 10**6).encode()
    like = lambda x, y: fp.like(fp.encode(len(x), fp.winnow(x)), fp.encode(len(y), fp.winnow(y)))
    assert 0.55 < like(a, b) < 0.75 and like(a, c) < 0.05 and like(a, b) == like(b, a)


def expected(rows):
    """rows (doc_id, text) in the order of the operator -> set of results."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        copy = text[: len(text) - third] + following[:third]
        one, two, three = (fp.encode(len(t.encode()), fp.winnow(t.encode())) for t in (text, copy, following))
        out.append((doc_id, len(text), hashlib.sha256(copy.encode()).hexdigest(), one, two, fp.like(one, two), fp.like(one, three)))
    return out


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_neighbours_follow_ids_across_parts(spark, partitions):
    rows = [(7 * i - 40, t) for i, t in enumerate(corpora.texts())]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fp.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {r[0]: r for r in expected(sorted(rows, key=lambda r: -r[0]))}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and tuple(r)[5:] == pytest.approx(want[r.doc_id][5:])


def test_awkward_tables(spark):
    df = corpora.awkward(spark)
    got = fp.edited_likeness(df).collect()
    assert len(got) == df.count() and {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    by_text = {}
    for r in fp.fingerprints(df).collect():
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(r.fingerprint in by_text[r.doc_id] for r in got)
    assert fp.edited_likeness(corpora.empty(spark)).collect() == []
    one = fp.edited_likeness(corpora.documents(spark, ["only one text that is here"])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    hot = [(None if i % 3 else 5, f"text number {i} of an id that holds many rows") for i in range(300)] + [(i, "x") for i in range(10)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        parts = fp.neighbours(spark.createDataFrame(hot, "doc_id bigint, text string")).where("not guest").groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in parts) == len(hot) and max(r["count"] for r in parts) < 80
