import random

from fitweave.llm import revisits

SCHEMA = "record_id bigint, url string, at bigint, kind string, etag string, last_modified string, digest string, headers map<string,string>, key string"


def model(rows):
    out = {}
    for r in (r for r in rows if r[3] == "revisit"):
        if r[1] is None or r[2] is None:
            out[r[0]] = ("no key", None, None)
            continue
        past = [(o[2], o[0], o) for o in rows if o[3] == "response" and o[1] == r[1] and o[2] is not None and o[2] < r[2]]
        if not past:
            out[r[0]] = ("no response", None, None)
            continue
        o = max(past, key=lambda x: x[:2])[2]
        both = lambda k: r[k] is not None and o[k] is not None and r[k].removeprefix("W/") != o[k].removeprefix("W/")
        name = "etag differs" if both(4) else "modified" if both(5) else "digest differs" if both(6) else "resolved"
        new = {k: v for k, v in (r[7] or {}).items() if k.lower() in revisits.PERMITTED}
        old = {k: v for k, v in (o[7] or {}).items() if k.lower() not in {n.lower() for n in new}}
        out[r[0]] = (name, o[0], old | new) if name == "resolved" else (name, None, None)
    return out


def test_against_a_plain_search(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["https://a.example/x", "https://a.example/x", "https://b.example/y", None]), rng.choice([None, *range(0, 40000, 700)]), rng.choice(["response", "revisit"]),
             rng.choice([None, "1", "W/1", "2"]), rng.choice([None, "m"]), rng.choice([None, "d", "d", "e"]), rng.choice([None, {"Date": str(i), "X-A": "1"}, {"date": "z", "Server": "s"}]), "k") for i in range(300)]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.record_id: (r.outcome, r.response_id, r.headers) for r in got} == model(rows)
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
