import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from fitweave.operators import merge as D
from fitweave.operators import schedule as T
from fitweave.session import step_folder
from fitweave.streaming import feed, reviews, versions
from fitweave.workloads import reports

SCHEMA = "profile_id int, skill_id string, ts timestamp, event_id long, rating string"


def sequential(events, start=0):
    interval, before, last = start, 0, None
    for ts, _, rating in sorted(events):
        base = before if last == ts.date() else interval
        interval = {"again": 1, "effort": 3}.get(rating, min(30, max(7, 2 * base)))
        before, last = base, ts.date()
    return interval, before, last


def sample():
    rng = random.Random(11)
    rows = []
    for n in range(400):
        rows.append((rng.randint(1, 4), rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 40)), n,
                     rng.choice(["again", "effort", "independent", "independent", "independent"])))
    return rows


def state(df):
    return {(r.profile_id, r.skill_id): (r.interval_days, r.interval_before, r.last_reviewed) for r in df.collect()}


def test_schedule_equals_event_by_event_rule(spark):
    rows = sample()
    expected = {}
    for key in {(r[0], r[1]) for r in rows}:
        expected[key] = sequential([r[2:] for r in rows if (r[0], r[1]) == key])
    assert state(T.review_state(spark.createDataFrame(rows, SCHEMA))) == expected
    begin = spark.createDataFrame([(p, s, 10 + p) for p, s in expected], "profile_id int, skill_id string, interval_days int")
    for key in expected:
        expected[key] = sequential([r[2:] for r in rows if (r[0], r[1]) == key], 10 + key[0])
    assert state(T.review_state(spark.createDataFrame(rows, SCHEMA), begin)) == expected


def test_stream_equals_batch_with_late_files(spark):
    rows = sample()
    folder = f"{step_folder(spark)}/stream-test-{uuid.uuid4().hex}"
    for part in (rows[1::2], rows[0::2]):  # the second arrival holds events older than the first
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        reviews.start_review_stream(stream, f"{folder}/reviews", f"{folder}/checkpoint").awaitTermination()
    assert state(reviews.current_state(spark, f"{folder}/reviews")) == state(T.review_state(spark.createDataFrame(rows, SCHEMA)))


def test_stream_goes_on_from_stored_state(spark):
    """Later days, a repeat on the last day, a late day and a new key, one micro-batch each."""
    at = lambda day, hour: dt.datetime(2024, 3, day, hour)
    batches = [[(1, "a", at(1, 9), 1, "independent"), (2, "a", at(1, 9), 2, "independent")], [(1, "a", at(9, 9), 3, "independent")], [(1, "a", at(9, 18), 4, "effort")],
               [(2, "a", at(20, 8), 5, "independent"), (3, "b", at(2, 2), 6, "again")], [(2, "a", at(8, 8), 7, "independent")]]
    folder = f"{step_folder(spark)}/stream-test-{uuid.uuid4().hex}"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        reviews.start_review_stream(stream, f"{folder}/reviews", f"{folder}/checkpoint").awaitTermination()
        seen = [r for b in batches[: n + 1] for r in b]
        assert state(reviews.current_state(spark, f"{folder}/reviews")) == state(T.review_state(spark.createDataFrame(seen, SCHEMA)))


def test_days_do_not_depend_on_the_session_zone(spark):
    rows = spark.sql("select 1 profile_id, 'a' skill_id, timestamp'2024-03-01 03:00:00+00:00' ts, 1L event_id, 'again' rating")
    got = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got += [str(T.review_days(rows).first().day), str(T.review_days(rows, zone="America/New_York").first().day)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-01", "2024-02-29"] * 2


def test_feed_equals_batch_with_a_reverted_text_and_late_rows(spark):
    schema = "source string, job_id string, fetched_at timestamp, seq long, description string, description_source string, content_hash string"
    day = lambda d: dt.datetime(2024, 5, d)
    batches = [[("s", "1", day(1), 0, "A", "source", "a"), ("s", "2", day(1), 0, "own", "pasted", "p")], [("s", "1", day(2), 1, "B", "source", "b"), ("s", "2", day(3), 1, "board", "source", "q")],
               [("s", "1", day(30), 2, "A", "source", "a")], [("s", "1", day(5), 3, "late", "source", "l"), ("s", "2", day(2), 4, "older paste", "pasted", "o")]]
    folder = f"{step_folder(spark)}/feed-test-{uuid.uuid4().hex}"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feed.start_posting_feed(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        whole = feed.latest_versions(spark.createDataFrame([r for b in batches[: n + 1] for r in b], schema))
        assert sorted(map(tuple, feed.catalogue(spark, f"{folder}/table").select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    final = {r.job_id: (r.description, r.seq) for r in feed.catalogue(spark, f"{folder}/table").collect()}
    assert final == {"1": ("A", 2), "2": ("own", 1)}


def test_feed_and_upsert_replay_one_row_after_the_other(spark):
    """Both follow one rule: rows in order, the first paste stays with its skills, later rows clear the translation."""
    rng = random.Random(8)
    names = ["description", "description_source", "skills", "translated_description", "title"]

    def replay(rows, shown):
        for job, *values in rows:
            row, old = dict(zip(names, values)), shown.get(job)
            if old and old["description_source"] == "pasted":
                row |= {n: old[n] for n in names[:3]} | {"translated_description": None}
            shown[job] = row
        return shown

    draw = lambda n: [(str(rng.randrange(12)), f"d{rng.randrange(99)}", rng.choice(["source", "source", "pasted"]), [f"s{rng.randrange(9)}"], rng.choice([None, "t"]), f"title {i}") for i in range(n)]
    schema = "job_id string, description string, description_source string, skills array<string>, translated_description string, title string"
    told = lambda df, key: {r[key]: {n: r[n] for n in names} for r in df.collect()}
    for _ in range(3):
        first, second, keep = draw(9), draw(30), [str(i) for i in range(0, 12, 2)]
        before = replay(first, {})
        old = spark.createDataFrame([(k, *v.values()) for k, v in before.items()], schema.replace("job_id", "id"))
        new = spark.createDataFrame([(*r, i) for i, r in enumerate(second)], schema.replace("job_id", "id") + ", ord int")
        got = told(D.upsert_catalogue(old, new, spark.createDataFrame([(k,) for k in keep], "id string")), "id")
        incoming = {r[0] for r in second}
        assert got == {k: v for k, v in replay(second, dict(before)).items() if k in keep or k in incoming}
        rows = [("s", dt.datetime(2024, 5, 1) + dt.timedelta(hours=i // 3), i, *r) for i, r in enumerate(first + second)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "source string, fetched_at timestamp, seq long, " + schema)
        assert told(feed.latest_versions(df), "job_id") == replay(first + second, {})


def test_a_batch_writes_the_buckets_of_its_keys_alone(spark):
    table, keys = f"{step_folder(spark)}/versions-test-{uuid.uuid4().hex}", ["k"]
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k int, v int")

    def apply(batch_id, ks, v):
        new = rows(ks, v)
        versions.merge_version(batch_id, table, keys, new, lambda before: new if before is None else before.join(new, "k", "left_anti").unionByName(new))
        return {r.k: r.v for r in versions.last_version(spark, table).collect()}

    assert apply(0, range(300), 0) == dict.fromkeys(range(300), 0)
    want = dict.fromkeys(range(300), 0) | {5: 1, 900: 1}
    assert apply(1, [5, 900], 1) == want
    assert len([n for n in versions._names(spark, f"{table}/data/version=1") if n.startswith("bucket=")]) <= 2
    assert apply(1, [5, 900], 1) == want  # a replay
    assert apply(2, [7], 2) == want | {7: 2} and apply(3, [5], 3) == want | {7: 2, 5: 3}
    assert apply(4, [8], 4) == want | {7: 2, 5: 3, 8: 4}
    mine = spark.sql("select 5 k").select(versions.bucket_of(keys).alias("b")).first().b
    assert [v for v in range(5) if f"bucket={mine}" in versions._names(spark, f"{table}/data/version={v}")] == [3]


def test_feed_drops_rows_neither_kept_nor_incoming(spark):
    schema = "source string, job_id string, fetched_at timestamp, seq long, description string, description_source string"
    folder, keep = f"{step_folder(spark)}/feed-test-{uuid.uuid4().hex}", spark.createDataFrame([("s", "1")], "source string, job_id string")
    for n, jobs in enumerate((["1", "2", "3"], ["3", "4"])):
        spark.createDataFrame([("s", j, dt.datetime(2024, 5, n + 1), n, j, "source") for j in jobs], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feed.start_posting_feed(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/table", f"{folder}/checkpoint", keep).awaitTermination()
    assert {r.job_id for r in feed.catalogue(spark, f"{folder}/table").collect()} == {"1", "3", "4"}


def test_due_queue(spark):
    applications = spark.createDataFrame([(1, "a", "Engineer", "A", "Interview", dt.date(2026, 9, 15)), (1, "b", "Engineer", "B", "Closed", dt.date(2026, 1, 1))],
                                         "profile_id int, job_id string, title string, company string, status string, followup date")
    lessons = spark.createDataFrame([(1, "a", "s", "SQL", 20)], "profile_id int, job_id string, skill_id string, skill string, minutes int")
    due = spark.createDataFrame([(1, "s", dt.date(2026, 9, 12))], "profile_id int, skill_id string, review_on date")
    assert [r.action for r in T.due_items(applications, lessons, due, "2026-09-14").collect()] == ["coaching-lesson"]
    assert [r.title for r in T.in_due_order(T.due_items(applications, lessons, due, "2026-09-15")).collect()] == ["Review SQL", "Follow up · Engineer"]


def test_stale(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    saved = rows.select("id", T.fingerprint(F.col("id"), F.col("text")).alias("fingerprint"))
    changed = rows.withColumn("text", F.when(F.col("id") == 2, "z").otherwise(F.col("text")))
    assert {r.id: r.stale for r in T.stale(saved, changed, ["id"], ["id", "text"]).collect()} == {1: False, 2: True}


def test_feed_reads_documents_from_a_file_and_from_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"text {i // 3}", "en", "s", 6) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "file/documents.parquet")
    want = sorted(map(tuple, reports.posting_feed_batch(spark, f"{tmp_path}/folder").drop("seq").collect()))
    assert len(want) == 10
    for form in ("folder", "file"):
        assert sorted(map(tuple, reports.posting_feed(spark, f"{tmp_path}/{form}").collect())) == want
