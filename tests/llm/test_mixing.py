import heapq
from fractions import Fraction
from math import ceil, floor

import corpora
import pytest

from fitweave.llm import mixing


def places(spark, weights, slots):
    df = spark.createDataFrame(list(weights.items()), "source string, weight bigint")
    out = {}
    for r in sorted(mixing.schedule(df, slots).collect(), key=lambda r: r.slot):
        out.setdefault(r.source, []).append((r.block, r.slot))
    return out


def plain(weights, slots):
    """Every slot on its own, with a heap of released and one of waiting blocks."""
    total, out = sum(weights.values()), {}
    waiting = [(0, ceil(Fraction(total, w)), s, 0) for s, w in sorted(weights.items())]
    ready = []
    heapq.heapify(waiting)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            released, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        assert t < due
        out.setdefault(s, []).append((j, t))
        heapq.heappush(waiting, ((j + 1) * total // weights[s], -(-(j + 2) * total // weights[s]), s, j + 1))
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 97, "b": 1, "c": 1, "d": 1}, {f"s{i}": 1 + i * i % 7 for i in range(20)}])
def test_schedule_against_a_plain_one(spark, weights):
    assert places(spark, weights, 700) == plain(weights, 700)


@pytest.mark.parametrize("sources, slots", [(20, 3000), (500, 3000), (5000, 1500)])
def test_less_than_one_block_from_any_target(spark, sources, slots):
    """One source has half of the mixture, the others share the rest unevenly; far fewer slots than sources, at the end."""
    shares = {"hot": 0.5} | {f"s{i}": 0.5 * (1 + i * 7919 % 13) / sum(1 + k * 7919 % 13 for k in range(sources - 1)) for i in range(sources - 1)}
    weights = {r.source: r.weight for r in mixing.exact_weights(spark.createDataFrame(list(shares.items()), "source string, share double")).collect()}
    got = places(spark, weights, slots)
    assert sorted(t for own in got.values() for _, t in own) == list(range(slots))
    for source, share in shares.items():
        own = got.get(source, [])
        assert [j for j, _ in own] == list(range(len(own)))
        for j, t in own:  # the distance is greatest just before and just after a slot of the source; shares are met to 2^-39
            assert abs(j - share * t) < 1 + 1e-6 and abs(j + 1 - share * (t + 1)) < 1 + 1e-6
        assert len(own) - share * slots > -1


def test_against_a_plain_scheduler(spark):
    df = corpora.documents(spark, [corpora.sentence(__import__("random").Random(i), 5 + i % 30) for i in range(300)])
    shares = spark.createDataFrame([("s0", 0.5), ("s1", 0.3), ("s2", 0.2)], "source string, share double")
    rows = mixing.mixture(df, shares, block_bytes=256, horizon=100, passes=1).collect()
    sizes = {r.doc_id: len(r.text) for r in df.collect()}
    slots = {s: dict(own) for s, own in plain({r.source: r.weight for r in mixing.exact_weights(shares).collect()}, 100).items()}
    for source in slots:
        start = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: ((r.h >> 52) & 0xFFF, r.h, r.doc_id)):
            assert (r.block, r.slot) == (start // 256, slots[source].get(start // 256))
            start += sizes[r.doc_id]
    assert all(r.kept == (r.slot is not None) for r in rows) and len(rows) == 300 and not all(r.kept for r in rows)


def test_passes_start_again(spark):
    df = corpora.documents(spark, ["x" * 100] * 30)
    shares = spark.createDataFrame([("s0", 0.9), ("s1", 0.1)], "source string, share double")
    rows = mixing.mixture(df, shares, block_bytes=100, horizon=100, passes=3).collect()
    mine = sorted((r.slot, r.epoch) for r in rows if r.source == "s0")
    assert len(mine) == 30 and [e for _, e in mine] == [0] * 10 + [1] * 10 + [2] * 10 and len({s for s, _ in mine}) == 30
    assert not any(r.kept for r in rows if r.source == "s2")


def test_a_tiny_source_is_not_repeated_without_limit(spark):
    rows = [(i, "x" * 1000, "en", f"s{i % 2}", 0) for i in range(400)] + [(900, "tiny", "en", "t", 0)]
    df = spark.createDataFrame(rows, corpora.SCHEMA)
    shares = spark.createDataFrame([("t", 0.5), ("s0", 0.3), ("s1", 0.2)], "source string, share double")
    got = mixing.mixture(df, shares, block_bytes=2000, passes=4).collect()
    assert {r.doc_id for r in got if r.kept and r.epoch == 0} == {r[0] for r in rows}
    count = lambda s: sum(r.kept and r.source == s for r in got)
    assert 1 <= count("t") <= 4 and abs(count("s0") / count("s1") - 1.5) < 0.05


def test_defined_results(spark):
    df = corpora.awkward(spark)
    rows = mixing.mixture(df, mixing.tempered_shares(df), block_bytes=512).collect()
    assert sum(r.epoch == 0 for r in rows) == df.count() and "" in {r.source for r in rows}
    assert all(r.released <= r.slot < r.due for r in rows)
    none = corpora.empty(spark)
    assert mixing.mixture(none, mixing.tempered_shares(none)).collect() == []


def test_whole_mixture_keeps_all_and_meets_the_target(spark):
    sizes = {"hot": 300, "b": 60, "c": 25, "d": 20}
    rows = [(i, "x" * (50 + i * 37 % 100), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows + [(900, "x", "en", "none", 0)], corpora.SCHEMA)
    target = {"hot": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    shares = spark.createDataFrame(list(target.items()), "source string, share double")
    got = mixing.mixture(df, shares, block_bytes=256).collect()
    length = {r[0]: len(r[1]) for r in rows}
    assert {r.doc_id for r in got if r.kept and r.epoch == 0} == set(length)
    assert [r.kept for r in got if r.source == "none"] == [False]
    kept = [r for r in got if r.kept]
    total = sum(length[r.doc_id] for r in kept)
    end = max(r.slot for r in kept) + 1
    for source, share in target.items():
        mine = [r for r in kept if r.source == source]
        assert abs(sum(length[r.doc_id] for r in mine) / total - share) < 0.01, source
        assert abs(len({r.block for r in mine}) - share * end) < 2, source
        times = {}
        for r in mine:
            times.setdefault(r.doc_id, []).append(r.epoch)
        assert max(map(len, times.values())) - min(map(len, times.values())) <= 1 and all(sorted(e) == list(range(len(e))) for e in times.values())


def test_the_query_reads_every_document(spark, tmp_path):
    rows = [(i, "y" * 70000, "en", "hot", 0) for i in range(30)] + [(100 + i, "z" * 60000, "en", f"s{i}", 0) for i in range(6)]
    spark.createDataFrame(rows, corpora.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows} and len(got) > len(rows)
    assert all(r.released <= r.slot < r.due for r in got)


def test_no_switch_by_the_size_of_the_input(spark, monkeypatch):
    """A given block is taken as it is, however many there are; the default is one rule for few and many bytes."""
    df = corpora.documents(spark, ["x" * (50 + i) for i in range(60)])
    shares = mixing.tempered_shares(df)
    total = sum(len(r.text) for r in df.collect())

    def rows(**options):
        return sorted(mixing.mixture(df, shares, **options).collect())
    given = rows(block_bytes=256)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    assert rows(block_bytes=256) == given
    assert rows() == rows(block_bytes=ceil(total / 8)) != given
