"""Stored tables, whole runs and streaming ingest."""

import json
import time

import pytest
from pyspark.sql import functions as F, types as T

from rolefold.__main__ import main
from rolefold.operators.lifecycle import stage_events
from rolefold.plans.board import stage_counts
from rolefold.plans.campaign import run_campaign
from rolefold.plans.queues import pending_queue
from rolefold.plans.store import ListingStore
from rolefold.plans.tracker import Tracker
from rolefold.schemas import RESUME
from rolefold.session import read_or_empty, run_dir, shared_dir
from rolefold.sources.resumes import json_resumes, read_text_resumes, resolve_resume
from rolefold.streaming.ingest import append_events, ingest_once, live_board, merge_batch, read_ingested, stream_files

NOW = F.lit("2026-09-01 00:00:00").cast("timestamp")


@pytest.fixture
def store(spark):
    return ListingStore(spark, run_dir(spark, "store"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "platform string, job_id_on_platform string, title string")


def test_insert_if_absent(spark, store):
    first = store.upsert_listings(batch(spark, [("LinkedIn", "1", "a"), ("linkedin ", " 1 ", "b"), ("Naukri", "1", "c"), ("X", "", "d")]).withColumn(
        "arrival", F.when(F.col("title") == "a", 2).otherwise(1)), NOW)
    assert sorted((r["platform_key"], r["is_new"]) for r in first.collect()) == [("linkedin", True), ("naukri", True), ("x", True)]
    again = store.upsert_listings(batch(spark, [("LINKEDIN", "1", "changed"), ("X", None, "d"), ("New", "9", "n")]), NOW)
    got = {r["platform_key"]: (r["id"], r["is_new"]) for r in again.collect()}
    before = {r["platform_key"]: r["id"] for r in first.collect()}
    assert got == {"linkedin": (before["linkedin"], False), "x": (before["x"], False), "new": (4, True)}
    stored = store.read("listings")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert stored.filter("platform_key = 'linkedin'").first()["title"] == "b"
    assert stored.filter("platform_key = 'x' and length(job_id_on_platform) = 16").count() == 1


def test_scores_statuses_and_purge(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(4)] + [("RemoteOK", "1", "t")]), NOW)
    ids = {r["job_id_on_platform"] + r["platform"]: r["id"] for r in store.read("listings").collect()}
    scores = spark.createDataFrame([(ids["0A"], 40, "low"), (ids["1A"], None, "none")], "job_id bigint, match_score int, match_reasoning string")
    store.apply_scores(scores, NOW)
    store.apply_scores(scores.filter("match_score = 40").withColumn("match_score", F.lit(90)), NOW + F.expr("interval 1 hour"))
    rows = {r["id"]: r for r in store.listings().collect()}
    assert (rows[ids["0A"]]["match_score"], rows[ids["0A"]]["status"]) == (90, "evaluated")
    # A listing scored without a result is done with: it is in no queue any more.
    assert (rows[ids["1A"]]["match_score"], rows[ids["1A"]]["status"]) == (None, "evaluated")
    assert pending_queue(store.listings(), store.applications()).count() == 3
    assert store.purge() == 1 and store.read("listings").count() == 4 and store.purge() == 0
    store.reset()
    assert store.read("listings").count() == 0
    assert store.upsert_listings(batch(spark, [("A", "0", "t")]), NOW).first()["id"] == 1


def test_thousand_rows_with_repeats(spark, store):
    started = time.time()
    store.upsert_listings(batch(spark, [("P", str(i), "t") for i in range(1000)]), NOW)
    again = store.upsert_listings(batch(spark, [("P", str(i), "t") for i in range(500)]), NOW)
    assert again.filter("is_new").count() == 0 and again.count() == 500 and store.read("listings").count() == 1000
    assert time.time() - started < 10.0


def feed(spark, *items):
    return spark.createDataFrame([("1", json.dumps({"jobs": list(items)}))], "payload_id string, body string")


def test_run_and_rerun(spark, store):
    landed = {"Remotive": feed(
        spark, {"id": 1, "title": "Python Engineer", "company_name": "A", "description": "Python, SQL and AWS"},
        {"id": 2, "title": "Rust Engineer", "company_name": "B", "description": "Rust and Scala"}), "Himalayas": lambda: 1 / 0}
    job = {"company": "Acme", "role": "Dev", "dates": "", "location": "", "bullets": ["Cooked", "Wrote Python", "Ran SQL"]}
    resume = spark.createDataFrame([{"resume_id": "r", "name": "Ada", "email": "", "phone": "", "summary": "Python SQL AWS", "experience": [job],
                                     "skills": ["Python", "SQL"], "education": "", "certifications": []}], RESUME)
    (row,) = run_campaign(spark, store, landed, NOW, resume, ["engineer"]).collect()
    assert (row["total_scraped"], row["newly_stored"], row["evaluated"], row["ready"], row["status"]) == (2, 2, 2, 1, "success")
    assert len(row["errors"]) == 1 and row["errors"][0].startswith("Himalayas")
    app = store.applications().first()
    tailored = json.loads(app["resume_json"])
    assert tailored["experience"][0]["bullets"][0] in ("Wrote Python", "Ran SQL") and "<h1>Ada</h1>" in app["resume_html"]
    assert (app["status"], app["notes"]) == ("Ready to Apply", "Auto-tailored by pipeline")
    assert store.listings().filter("status = 'ready'").count() == 1
    (row,) = run_campaign(spark, store, landed, NOW, resume, ["engineer"]).collect()
    assert (row["total_scraped"], row["newly_stored"], row["evaluated"], row["ready"]) == (2, 0, 0, 0)
    assert spark.read.parquet(f"{store.root}/metrics").count() == 2
    moves = spark.createDataFrame([(store.next_event_id(), app["id"], "Applied", None)], "event_id bigint, application_id bigint, stage string, note string")
    accepted, _ = stage_events(moves.withColumn("created_at", NOW + F.expr("interval 1 day")), store.read("events"))
    store.append_events(accepted)
    assert {r["stage"]: r["n"] for r in stage_counts(spark, store.applications()).collect()}["Applied"] == 1


def test_a_run_of_which_all_sources_fail(spark, store):
    store.upsert_listings(batch(spark, [("P", "1", "python")]), NOW)
    resume = spark.createDataFrame([("python",)], "raw_text string")
    (row,) = run_campaign(spark, store, {"Himalayas": lambda: 1 / 0}, NOW, resume, ["engineer"]).collect()
    assert (row["total_scraped"], row["evaluated"], row["status"], len(row["errors"])) == (0, 1, "failed", 1)


def test_command_line(spark):
    base = run_dir(spark, "cli")
    body = json.dumps({"jobs": [{"id": 5, "title": "Python Dev", "description": "python"}]})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{base}/landed/Remotive")
    html = '<div class="tuple"><a class="title" href="/python-1234567">Python</a></div>'
    spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string").write.parquet(f"{base}/landed/Naukri")
    spark.createDataFrame([("Ada\nSkills\npython",)], "value string").coalesce(1).write.text(f"{base}/resume")
    args = ["--root", f"{base}/store", "--landed", f"{base}/landed", "--keywords", "python", "--resume-path", f"{base}/resume"]
    row = main(args)
    assert (row["total_scraped"], row["newly_stored"], row["evaluated"], row["ready"], row["errors"]) == (2, 2, 2, 2, [])
    assert main([*args, "--sources", "Remotive"])["total_scraped"] == 1


def test_threshold(spark, store):
    landed = {"Remotive": feed(spark, {"id": 1, "title": "x", "description": "Python and Rust"})}
    resume = spark.createDataFrame([("python",)], "raw_text string")
    assert run_campaign(spark, store, landed, NOW, resume, ["x"], min_score=51).first()["ready"] == 0
    assert run_campaign(spark, store, landed, NOW, resume, ["x"], min_score=50).first()["ready"] == 1


def test_tracker(spark, store):
    tracker = Tracker(store)
    store.upsert_listings(batch(spark, [("A", "1", "one"), ("A", "2", "two"), ("B", "3", "three")]), NOW)
    jobs = spark.createDataFrame([(1, "first"), (2, None)], "job_id bigint, notes string")
    made = {r["job_id"]: r["application_id"] for r in tracker.create(jobs, NOW).collect()}
    again = tracker.create(spark.createDataFrame([(2,), (3,)], "job_id bigint"), NOW, "Applied").collect()
    assert {r["job_id"]: r["is_new"] for r in again} == {2: False, 3: True}
    later = NOW + F.expr("interval 1 day")
    moves = spark.createDataFrame([(made[1], "Applied", None), (999, "Offer", None)], "application_id bigint, stage string, note string")
    assert [r[0] for r in tracker.move(moves, later).collect()] == [999]
    notes = spark.createDataFrame([(made[1], "n", "2026-10-01"), (998, "x", None)], "application_id bigint, notes string, follow_up_date string")
    assert [r[0] for r in tracker.annotate(notes, later + F.expr("interval 1 hour")).collect()] == [998]
    assert tracker.mark_applied(spark.createDataFrame([(made[2],)], "application_id bigint"), later).count() == 0
    assert {r["stage"]: r["n"] for r in tracker.stage_counts().collect() if r["n"]} == {"Applied": 3}
    assert [r["stage"] for r in tracker.timeline(made[1]).collect()] == ["Ready to Apply", "Applied", "Applied"]
    row = tracker.applications().filter(F.col("id") == made[1]).first()
    assert (row["notes"], str(row["follow_up_date"]), row["status"]) == ("n", "2026-10-01 00:00:00", "Applied")
    assert tracker.table().count() == tracker.board().count() == 3 and tracker.ready().count() == 0
    assert tracker.pending().count() == tracker.candidates().count() == 0 and tracker.listings().count() == 3
    assert all(r["is_applied"] for r in tracker.applied_flags().collect())
    assert tracker.history().filter(F.col("application_id") == made[1]).count() == 2
    assert {r["status"] for r in store.listings().collect()} == {"applied"}


def test_older_files_without_newer_columns_read_as_null(spark, store):
    spark.createDataFrame([(7, "P", "k", "p")], "id bigint, platform string, job_id_on_platform string, platform_key string").write.parquet(
        f"{store.root}/v000000/listings")
    (row,) = store.read("listings").collect()
    assert row["id"] == 7 and row["salary_range"] is None
    store.upsert_listings(batch(spark, [("P", "k", "t"), ("P", "l", "t")]), NOW)
    assert store.read("listings").count() == 2


def test_resume_choice(spark):
    texts = [resolve_resume(spark, *args).first().asDict() for args in (
        ({"name": "Ada", "skills": ["Go"]},), ('{"name": "Bob"}',), ("plain words",), (None, "free text"), (None, None))]
    assert (texts[0]["name"], texts[0]["skills"], texts[1]["name"]) == ("Ada", ["Go"], "Bob")
    assert [t["raw_text"] for t in texts[2:4]] == ["plain words", "free text"] and "Data Engineer" in texts[4]["raw_text"]
    base = spark.createDataFrame([("stored",)], "raw_text string")
    assert resolve_resume(spark, base=base).first()["raw_text"] == "stored"


def test_undecodable_resume_bytes_are_replaced(spark):
    base = run_dir(spark, "bytes")
    spark.sql("select x'416461FF0A536B696C6C730A476F' as value").selectExpr("cast(value as string) value").coalesce(1).write.text(base)
    (row,) = read_text_resumes(spark, base).collect()
    assert row["name"] == "Ada\ufffd" and row["skills"] == ["Go"]


SCHEMA = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("k", T.StringType())])


def test_replayed_batch_changes_nothing(spark):
    target = run_dir(spark, "replay")
    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in ([(1, "a"), (2, "b")], [(3, "b"), (4, "c"), (5, "c")]))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        merge_batch(batch, number, ["k"], ["n"], target)
        if number == 1:
            assert sorted(tuple(r) for r in read_ingested(spark, target, SCHEMA).collect()) == [(1, "a"), (2, "b"), (4, "c")]


def test_leftovers_of_a_failed_purge_are_ignored(spark, store):
    store.upsert_listings(batch(spark, [("A", "1", "t"), ("RemoteOK", "1", "t")]), NOW)
    store.append("listings", store.read("listings"), "v000001-of-a-run-that-died")
    assert store.read("listings").count() == 2
    assert store.purge() == 1
    assert [r["platform"] for r in store.read("listings").collect()] == ["A"]
    assert store.snapshot()[0] == 1


def test_streamed_ingest_stores_each_key_once(spark):
    base = run_dir(spark, "stream")
    rows = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, "a")]]
    for part in rows[:2]:
        spark.createDataFrame(part, "n int, k string").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream = stream_files(spark, f"{base}/in", "n int, k string", per_trigger=1)
        ingest_once(stream, ["k"], ["n"], f"{base}/out", f"{base}/progress")
        return sorted(r["k"] for r in read_ingested(spark, f"{base}/out", SCHEMA).collect())

    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]  # nothing new arrived
    spark.createDataFrame(rows[2], "n int, k string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert run() == ["a", "b", "c"]


def test_streamed_log_orders_late_events_by_time(spark):
    base = run_dir(spark, "board")
    schema = "event_id int, app int, stage string, t int"
    for part in ([(1, 1, "Applied", 10), (2, 2, "Applied", 10)], [(3, 1, "Offer", 30)], [(4, 1, "Reply Received", 20)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        append_events(stream_files(spark, f"{base}/in", schema), f"{base}/log", f"{base}/progress")
    counts = live_board(spark.read.schema(schema).parquet(f"{base}/log"), "app", "stage", ["t", "event_id"])
    assert {r["stage"]: r["n"] for r in counts.collect()} == {"Offer": 1, "Applied": 1}


def test_resume_files(spark):
    base = run_dir(spark, "resumes")
    spark.createDataFrame([("Ada\nSkills\nPython, SQL",)], "value string").coalesce(1).write.text(base)
    (row,) = read_text_resumes(spark, base).collect()
    assert (row["name"], row["skills"]) == ("Ada", ["Python", "SQL"])
    texts = [("bare", '{"name":"Ada","skills":["Go"],"experience":[{"company":"A","bullets":["x"]}]}'),
             ("wrapped", '{"format":"json","data":{"name":"Bob"}}'), ("broken", "{")]
    got = {r["resume_id"]: r for r in json_resumes(spark.createDataFrame(texts, "resume_id string, raw_text string")).collect()}
    assert got["bare"]["experience"][0]["bullets"] == ["x"] and got["wrapped"]["name"] == "Bob" and got["broken"]["name"] is None


def test_shared_folder_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert run_dir(spark, "x") != run_dir(spark, "x")


def test_what_is_joined_to_a_missing_table_is_not_shuffled(spark, tmp_path):
    missing = read_or_empty(spark, f"{tmp_path}/none", "id long, names array<string>, at struct<a: int, b: timestamp>")
    assert missing.dtypes == [("id", "bigint"), ("names", "array<string>"), ("at", "struct<a:int,b:timestamp>")]
    assert missing.collect() == [] and missing.inputFiles() == []
    wide = spark.range(5).withColumn("text", F.lit("x"))
    joined = wide.join(missing, "id", "left").join(missing.select("id"), "id", "left_anti")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in joined.collect()) == [0, 1, 2, 3, 4] and wide.join(missing, "id").count() == 0
