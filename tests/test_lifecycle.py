"""Event log, derived state, boards, filters and queues on small known inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolefold.functions.stages import STAGES
from rolefold.operators.filters import distinct_platforms, filter_applications, filter_listings, sort_applications
from rolefold.operators.lifecycle import (
    audit_trail, created_events, current_state, history_entries, history_json, notes_events, stage_events, without_application,
)
from rolefold.operators.purge import is_deprecated, orphans, purge_cascade
from rolefold.plans.board import applied_flags, applications_table, board, ready_list, stage_counts, totals
from rolefold.plans.queues import all_listings, candidate_queue, pending_queue
from rolefold.schemas import EVENTS


def ts(text):
    return F.lit(text).cast("timestamp")


def make_log(spark, stage_rows=(), note_rows=(), apps=((1, 10), (2, 20))):
    """Applications created at 00:00:00, then (event, app, stage, note, time) and notes rows."""
    new = spark.createDataFrame([(a, a, j) for a, j in apps], "event_id bigint, application_id bigint, job_id bigint")
    log = created_events(new, ts("2026-09-01 00:00:00"))
    moves = spark.createDataFrame(list(stage_rows), "event_id bigint, application_id bigint, stage string, note string, created_at string")
    accepted, unknown = stage_events(moves.withColumn("created_at", F.col("created_at").cast("timestamp")), log)
    notes = spark.createDataFrame(list(note_rows), "event_id bigint, application_id bigint, notes string, interview_date string, "
                                  "follow_up_date string, recruiter_info string, created_at string")
    noted, unknown_notes = notes_events(notes.withColumn("created_at", F.col("created_at").cast("timestamp")), log)
    return log.unionByName(accepted).unionByName(noted), unknown, unknown_notes


MOVES = [(100 + i, 1, s, None, f"2026-09-0{i + 2} 10:00:00") for i, s in enumerate(STAGES[1:4] + ["Offer"])]


def test_lifecycle_progression(spark):
    notes = [(200, 1, "call", "2026-09-20 14:00", "", "Eve <e@x>", "2026-09-04 12:00:00")]
    log, _, _ = make_log(spark, MOVES, notes)
    assert log.schema == EVENTS or [f.name for f in log.schema] == EVENTS.fieldNames()
    state = {r["application_id"]: r for r in current_state(log).collect()}
    assert (state[1]["status"], state[2]["status"]) == ("Offer", "Ready to Apply")
    assert state[1]["notes"] == "call\n[Recruiter: Eve <e@x>]"
    assert str(state[1]["interview_date"]) == "2026-09-20 14:00:00" and state[1]["follow_up_date"] is None
    assert str(state[1]["first_applied_at"]) == "2026-09-02 10:00:00" and state[2]["first_applied_at"] is None
    assert str(state[1]["created_at"]) == str(state[1]["applied_at"]) == "2026-09-01 00:00:00"
    trail = [tuple(r)[2:4] for r in audit_trail(log).filter("application_id = 1").orderBy("created_at", "id").collect()]
    assert trail == [
        ("Ready to Apply", "Application initialized"), ("Applied", "Transitioned from Ready to Apply to Applied"),
        ("Reply Received", "Transitioned from Applied to Reply Received"),
        ("Interview Scheduled", "Transitioned from Reply Received to Interview Scheduled"),
        ("Interview Scheduled", "Updated application notes (Interview: 2026-09-20 14:00)"),
        ("Offer", "Transitioned from Interview Scheduled to Offer")]
    (history,) = [r["history"] for r in history_json(history_entries(log)).filter("application_id = 1").collect()]
    entries = json.loads(history)
    assert [e["stage"] for e in entries] == STAGES[:4] + ["Offer"]
    assert [e.get("previous_stage") for e in entries] == [None] + STAGES[:4]
    assert entries[0]["note"] == "Application created" and entries[1]["note"] == "Stage transitioned to Applied"


def test_rejection_and_reactivation(spark):
    moves = [(100, 1, "Rejected", "", "2026-09-02 00:00:00"), (101, 1, "Ready to Apply", "again", "2026-09-03 00:00:00")]
    log, _, _ = make_log(spark, moves)
    assert current_state(log).filter("application_id = 1").first()["status"] == "Ready to Apply"
    assert audit_trail(log).filter("id = 101").first()["note"] == "again"


def test_unknown_application_is_refused(spark):
    log, unknown, unknown_notes = make_log(
        spark, [(100, 99, "Applied", None, "2026-09-02 00:00:00")], [(200, 99, "x", None, None, None, "2026-09-02 00:00:00")])
    assert log.count() == 2 and unknown.count() == 1 and unknown_notes.count() == 1


def test_bad_date_keeps_the_good_one_and_is_audited(spark):
    notes = [(200, 1, "a", "2026-09-20 14:00", None, None, "2026-09-04 00:00:00"),
             (201, 1, "", "not-a-date", "2026-10-01", "Eve", "2026-09-05 00:00:00"),
             (202, 1, None, None, "bad", None, "2026-09-06 00:00:00")]
    log, _, _ = make_log(spark, (), notes)
    row = current_state(log).filter("application_id = 1").first()
    assert str(row["interview_date"]) == "2026-09-20 14:00:00" and str(row["follow_up_date"]) == "2026-10-01 00:00:00"
    assert row["notes"] is None
    texts = [r["note"] for r in audit_trail(log).filter("id >= 200").orderBy("id").collect()]
    assert texts[1] == "Updated application notes (Interview: not-a-date) (Follow-up: 2026-10-01)"
    assert texts[2] == "Updated application notes (Follow-up: bad)"


def test_creation_is_idempotent_per_job(spark):
    log, _, _ = make_log(spark)
    jobs = spark.createDataFrame([(10,), (30,)], "job_id bigint")
    assert [r["job_id"] for r in without_application(jobs, log).collect()] == [30]


def test_state_equals_sequential_replay_and_large_groups_agree(spark):
    rng = random.Random(1)
    apps = [(a, a * 10) for a in range(1, 6)]
    moves, expected, history = [], {a: "Ready to Apply" for a, _ in apps}, {a: ["Ready to Apply"] for a, _ in apps}
    for i in range(150):
        app = rng.choice([1, 1, 1, 2, 3, 4])
        stage = rng.choice(STAGES)
        moves.append((100 + i, app, stage, None, f"2026-09-02 00:{i // 60:02d}:{i % 60:02d}"))
        expected[app] = stage
        history[app].append(stage)
    rng.shuffle(moves)
    log, _, _ = make_log(spark, moves, apps=apps)
    assert {r["application_id"]: r["status"] for r in current_state(log.repartition(5)).collect()} == expected
    large = {"block_rows": 10}
    for limits in ({}, large):
        got = {}
        for r in history_entries(log, **limits).orderBy("application_id", "seq").collect():
            got.setdefault(r["application_id"], []).append(r["stage"])
        assert got == history
    assert sorted(map(repr, audit_trail(log, **large).collect())) == sorted(map(repr, audit_trail(log).collect()))
    chunks = history_json(history_entries(log), chunk=7).filter("application_id = 1").orderBy("chunk").collect()
    assert [e["stage"] for c in chunks for e in json.loads(c["history"])] == history[1]
    assert max(c["n_entries"] for c in chunks) == 7


# -- boards and filters ----------------------------------------------------------------------

APPS = [
    (1, "LinkedIn", "Principal Solutions Architect", "CloudNova", "aws, terraform", None, 96, "Ready to Apply"),
    (2, "Naukri", "Data Engineer", "Analytics Grid", "python, sql", "portfolio sent", 82, "Applied"),
    (3, "Hirist", "ML Engineer", "Vision", "pytorch", None, 65, "Reply Received"),
    (4, "Wellfound", "Staff Architect", "Seed", "go", "", 88, "Interview Scheduled"),
    (5, "LinkedIn", "Tester", "QA", "selenium", None, 40, "Rejected"),
    (6, "Naukri", "Lead", "Big", "java", None, 91, "Offer"),
    (7, "Remotive", "Writer", "Docs", None, None, None, None),
]


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame(
        APPS, "app_id int, platform string, title string, company string, skills string, notes string, match_score int, app_status string"
    ).withColumn("match_reasoning", F.lit(None).cast("string")).withColumn("app_updated_at", F.col("app_id")).withColumn(
        "app_created_at", F.col("app_id"))


def ids(df):
    return sorted(r["app_id"] for r in df.collect())


def test_search(apps):
    for text, expected in [("architect", [1, 4]), (" Analytics GRID ", [2]), ("pytorch", [3]), ("portfolio", [2]), ("absent", []), ("  ", [1, 2, 3, 4, 5, 6, 7])]:
        assert ids(filter_applications(apps, text)) == expected


def test_score_platform_and_stage_filters(apps):
    assert [len(ids(filter_applications(apps, min_score=s))) for s in (0, 80, 95, 100)] == [7, 4, 1, 0]
    assert ids(filter_applications(apps, platforms=["Naukri"], stages=["Offer"])) == [6]
    assert ids(filter_applications(apps, stages=["Ready to Apply"])) == [1, 7]
    assert ids(filter_applications(apps, platforms=[])) == ids(filter_applications(apps, stages=[])) == []
    assert ids(filter_applications(apps, platforms=None, stages=None)) == [1, 2, 3, 4, 5, 6, 7]


def test_explorer_treats_an_empty_list_as_no_filter(apps):
    listings = apps.withColumn("description", F.lit("Text"))
    assert ids(filter_listings(listings, platforms=[])) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(filter_listings(listings, platforms=["Hirist"])) == [3]
    assert ids(filter_listings(listings, evaluated=False)) == [7] and len(ids(filter_listings(listings, evaluated=True))) == 6
    assert len(ids(filter_listings(listings, "TEXT"))) == 7
    assert distinct_platforms(listings).count() == 5


def test_sorts(apps):
    order = lambda by: [r["app_id"] for r in sort_applications(apps, by).collect()]
    assert order("Newest First") == [7, 6, 5, 4, 3, 2, 1]
    assert order("Match Score (High to Low)") == [1, 6, 4, 2, 3, 5, 7]
    assert order("Company (A-Z)")[:3] == [2, 6, 1]
    assert order("Title (A-Z)")[:2] == [2, 6]
    assert order("Stage")[0] == 7
    assert sort_applications(apps, "Unknown") is apps


def listing_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, status string, match_score int, scraped_at string, created_at string").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("scraped_at", "created_at")})


def applied(spark, *job_ids, status="Applied"):
    return spark.createDataFrame([(i, j, status) for i, j in enumerate(job_ids)], "id bigint, job_id bigint, status string")


def test_queues_and_exclusion(spark):
    d = "2026-08-0"
    rows = [(1, "evaluated", 85, d + "1", None), (2, "evaluated", 90, d + "2", None), (3, "evaluated", 60, d + "3", None),
            (4, "scraped", None, d + "4", None), (5, "scraped", None, None, d + "5"), (6, "scraped", None, d + "5", None),
            (7, "evaluated", None, d + "9", None)]
    listings = listing_rows(spark, rows)
    none = applied(spark)
    queue = lambda df: [r["id"] for r in df.collect()]
    assert queue(pending_queue(listings, none)) == [6, 5, 4]
    assert queue(candidate_queue(listings, none)) == [2, 1]
    assert queue(candidate_queue(listings, applied(spark, 2), 0)) == [1, 3]
    assert queue(pending_queue(listings, applied(spark, 5, 6), 1)) == [4]
    # An application without a listing must not empty the queues.
    assert queue(candidate_queue(listings, applied(spark, None, 2))) == [1]
    assert queue(all_listings(listings)) == [7, 6, 5, 4, 3, 2, 1]
    assert queue(all_listings(listings, newest_first=False)) == [1, 2, 3, 4, 5, 6, 7]


def test_candidate_order(spark):
    rows = [(1, "evaluated", 80, "2026-08-01", None), (2, "evaluated", 95, "2026-08-01", None),
            (3, "evaluated", 80, "2026-08-02", None), (4, "evaluated", 90, "2026-08-01", None), (5, "evaluated", 80, "2026-08-02", None)]
    assert [r["id"] for r in candidate_queue(listing_rows(spark, rows), applied(spark)).collect()] == [2, 4, 5, 3, 1]


def test_board_reads(spark):
    apps = spark.createDataFrame(
        [(1, 11, "ready", "2026-01-01"), (2, 12, "Offer", "2026-01-02"), (3, 13, "APPLIED", "2026-01-03"), (4, 14, "odd", "2026-01-04"),
         (5, 99, "Offer", "2026-01-05")], "id bigint, job_id bigint, status string, t string").withColumns(
        {c: F.col("t").cast("timestamp") for c in ("created_at", "updated_at")}).drop("t")
    listings = spark.createDataFrame([(11, "a", 50), (12, "b", None), (13, "c", 70), (14, "d", None)], "id bigint, title string, match_score int")
    cards = [(r["app_status"], r["app_id"], r["position"]) for r in board(apps, listings).orderBy("app_status", "position").collect()]
    assert cards == [("Applied", 3, 1), ("Offer", 2, 1), ("Ready to Apply", 4, 1), ("Ready to Apply", 1, 2)]
    assert [r["app_id"] for r in applications_table(apps, listings).collect()] == [4, 3, 2, 1]
    assert [r["app_id"] for r in ready_list(apps.withColumn("status", F.lit("READY")), listings).collect()] == [3, 1, 4, 2]
    assert [tuple(r) for r in stage_counts(spark, apps).orderBy("stage_no").collect()] == [
        (0, "Ready to Apply", 2), (1, "Applied", 1), (2, "Reply Received", 0), (3, "Interview Scheduled", 0), (4, "Rejected", 0), (5, "Offer", 2)]
    assert [tuple(r) for r in totals(listings, apps).collect()] == [(4, 5)]
    flags = {r["id"]: r["is_applied"] for r in applied_flags(listings, apps.filter("id < 4")).collect()}
    assert flags == {11: False, 12: True, 13: True, 14: False}


def test_purge_cascade(spark):
    listings = spark.createDataFrame([(1, "RemoteOK"), (2, "WeWorkRemotely"), (3, "remoteok"), (4, "LinkedIn"), (5, None)], "id int, platform string")
    apps = spark.createDataFrame([(1, 1), (2, 4)], "id int, job_id int")
    timeline = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, application_id int")
    kept = purge_cascade(listings, apps, timeline, is_deprecated(F.col("platform")))
    assert kept.removed.count() == 3
    assert [sorted(r["id"] for r in t.collect()) for t in (kept.listings, kept.applications, kept.timeline)] == [[4, 5], [2], [3]]
    assert orphans(timeline, kept.applications, "application_id").count() == 2
