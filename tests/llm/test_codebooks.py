import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from fitweave.llm import codebooks

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error bigint, part int, ints array<int>, total int"


def test_transform_is_hadamard_in_sequency_order():
    for width in (1, 2, 4, 8, 32):
        rows = codebooks.transform(np.eye(width, dtype=np.int64)).T
        assert np.array_equal(rows @ rows.T, width * np.eye(width, dtype=np.int64))
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(width))


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for width, most in ((1, 3), (3, 2), (8, 4), (8, 4000), (5, 1 << 40)):
        rows, entries = rng.integers(-most, most, (500, width)), rng.integers(-most, most, (16, width))
        entries[9] = entries[2]
        rows[:20] = entries[3]
        if most > 1 << 30:
            rows, entries = rows.astype(object), entries.astype(object)
        d = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        full = 1 << (width - 1).bit_length()
        entry, least = codebooks.nearest(codebooks.transform(codebooks.padded(rows)), codebooks.transform(codebooks.padded(entries)))
        assert entry.tolist() == np.argmin(d, axis=1).tolist()
        assert (least // full).tolist() == d.min(axis=1).tolist() and not (least % full).any()


def model(rows, parts=8, entries=16, rounds=6):
    kept = [(r[0], [max(-codebooks.LIMIT, min(codebooks.LIMIT, math.floor(x * 4096))) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted((i for i in range(len(kept)) if kept[i][0] is not None), key=lambda i: (kept[i][0], kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        groups = defaultdict(list)
        for c, a in zip(cut, assign()):
            for p in range(parts):
                groups[p, a[p][1]].append(c[p])
        books = [[[sum(x) // len(x) for x in zip(*groups[p, k])] if groups[p, k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    errors = defaultdict(int)
    out = []
    for (i, _, label), a in zip(kept, assign()):
        errors[label] += sum(d for d, _ in a)
        out.append((i, label, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = codebooks.LONGEST
    return sorted(((i, label, code, min(e, most), min(errors[label], most)) for i, label, code, e in out), key=repr), digest


def run(spark, rows):
    codes, books = codebooks.compressed(spark.createDataFrame(rows, SCHEMA))
    got = codebooks.with_label_error(codes).collect()
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=repr), books and books.digest()


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("case", ["plain", "odd lengths", "large", "few"])
def test_against_plain_rounds(spark, case):
    rng = random.Random(7)
    wide = {"plain": 1.0, "odd lengths": 0.01, "large": 1e17, "few": 1.0}[case]
    size = lambda: rng.randrange(0, 20) if case == "odd lengths" else 24
    rows = [(i, [single(rng.uniform(-wide, wide)) for _ in range(size())], None if i % 3 else i % 5, "c", 1, 1, [1], 2) for i in range(9 if case == "few" else 150)]
    rows += [rows[0], rows[4], (4, *rows[5][1:]), (None, *rows[6][1:])]
    rows += [(1000, None, 1, "c", 1, 1, [], 1), (-5, [None] * 24, 1, "c", 1, 1, [], 1), (-6, [single(1.0), float("nan")], 1, "c", 1, 1, [], 1), (-7, [float("-inf")] * 24, 1, "c", 1, 1, [], 1)]
    assert run(spark, rows) == model(rows)


def test_nothing_to_code(spark):
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None, 1, "c", 1, 1, [], 1)]) == ([], None)
