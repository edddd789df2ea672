"""Folders of the store: what an insert, a purge and a compaction read and write."""

import re

import pytest
from pyspark.sql import functions as F

from rolefold.operators.lifecycle import current_state, merged_state, partial_state, state_values
from rolefold.plans.store import ListingStore
from rolefold.plans.tracker import Tracker
from rolefold.session import run_dir

NOW = F.lit("2026-09-01 00:00:00").cast("timestamp")


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return ListingStore(spark, run_dir(spark, "store"), buckets=4)


def folder_filters(plan):
    return re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]


def batch(spark, rows):
    return spark.createDataFrame(rows, "platform string, job_id_on_platform string, title string")


def listed(store):
    return {(r["platform_key"], r["job_id_on_platform"]): r["id"] for r in store.read("listings").collect()}


def files(spark, store, tables=("listings", "scores", "events")):
    """Name and time of every file of the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store.root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = {}
    while found.hasNext():
        one = found.next()
        name = one.getPath().toString()
        if name.endswith(".parquet") and any(f"/{t}/" in name for t in tables):
            out[name] = one.getModificationTime()
    return out


def test_an_insert_reads_the_buckets_it_touches(spark, store):
    store.upsert_listings(batch(spark, [(p, str(i), "t") for p in "ABC" for i in range(40)]), NOW)
    assert len(files(spark, store, ["listings"])) == 12      # one file for each folder
    ids = listed(store)
    again = batch(spark, [("B", "7", "t")])
    key = spark.createDataFrame([("b", "7")], "platform_key string, job_id_on_platform string")
    bucket = key.select(F.pmod(F.xxhash64("*"), F.lit(4))).first()[0]
    keys = store.stored_keys(["b"], [bucket])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    filters = folder_filters(plan)
    assert "bucket" in filters and "platform_key" in filters
    assert keys.count() < 30 and keys.where("job_id_on_platform = '7'").count() == 1
    scan = next(n for n in plan.splitlines() if "FileScan" in n)
    assert "title" not in scan.split("ReadSchema")[1]
    assert [tuple(r) for r in store.upsert_listings(again, NOW).select("id", "is_new").collect()] == [(ids["b", "7"], False)]


def test_known_keys_are_not_shuffled_for_a_small_batch(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(300)]), NOW)
    small = spark.createDataFrame([("a", "1"), ("a", "x")], "platform_key string, job_id_on_platform string")
    stored = store.stored_keys(["a"], [0, 1, 2, 3])
    plan = stored.join(F.broadcast(small), ["platform_key", "job_id_on_platform"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_buckets_are_those_of_the_first_write(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(30)]), NOW)
    other = ListingStore(spark, store.root, buckets=7)
    assert other.layout().buckets == 4
    assert other.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(31)]), NOW).where("is_new").count() == 1
    assert sorted(listed(store).values()) == list(range(1, 32))


def test_a_purge_leaves_all_files_and_hides_its_platforms(spark, store):
    store.upsert_listings(batch(spark, [("A", "1", "t"), ("RemoteOK", "1", "t"), ("RemoteOK", "2", "t"), ("B", "1", "t")]), NOW)
    ids, tracker = listed(store), Tracker(store)
    jobs = spark.createDataFrame([(i, k[0]) for k, i in ids.items()], "job_id long, notes string")
    made = {r["job_id"]: r["application_id"] for r in tracker.create(jobs, NOW).collect()}
    tracker.mark_applied(spark.createDataFrame([(a,) for a in made.values()], "application_id long"), NOW + F.expr("interval 1 day"))
    store.apply_scores(jobs.select("job_id", F.lit(50).alias("match_score")), NOW)
    before = files(spark, store)
    assert store.purge(["remoteOK"]) == 2
    assert files(spark, store) == before
    assert set(listed(store)) == {("a", "1"), ("b", "1")}
    kept = {made[ids["a", "1"]], made[ids["b", "1"]]}
    assert {r["id"] for r in store.applications().collect()} == kept and store.read("scores").count() == 2
    assert {r["application_id"] for r in store.read("events").collect()} == kept and store.read("events").count() == 4
    for table in ("listings", "scores", "events"):
        assert "remoteok" in folder_filters(store.rows(table)._jdf.queryExecution().executedPlan().toString())
    # The platform may come back, with ids of its own.
    assert [r["id"] for r in store.upsert_listings(batch(spark, [("RemoteOK", "1", "t")]), NOW).collect()] == [5]
    assert set(listed(store)) == {("a", "1"), ("b", "1"), ("remoteok", "1")} and store.purge(["x"]) == 0


def requests(spark, rows):
    return spark.createDataFrame(rows, "application_id long, stage string, created_at string")


def test_compacted_state_equals_replay(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(6)] + [("RemoteOK", "1", "t")]), NOW)
    tracker, ids = Tracker(store), listed(store)
    made = [r["application_id"] for r in tracker.create(spark.createDataFrame([(i,) for i in ids.values()], "job_id long"), NOW).orderBy("job_id").collect()]
    tracker.move(requests(spark, [(made[0], "Applied", "2026-09-03"), (made[1], "Offer", "2026-09-09")]), NOW)
    tracker.annotate(spark.createDataFrame([(made[0], "n", "2026-10-01")], "application_id long, notes string, follow_up_date string"), NOW)
    jobs = spark.createDataFrame([(i, i * 10) for i in ids.values()], "job_id long, match_score int")
    store.apply_scores(jobs, NOW)
    store.apply_scores(jobs.where("job_id < 3").withColumn("match_score", F.lit(5)), NOW)

    def seen():
        # Replayed from the whole log, and read from the last compaction and the tail.
        replay = current_state(store.read("events")).withColumnRenamed("application_id", "id")
        state = store.applications()
        assert sorted(map(tuple, replay.select(*state.columns).collect())) == sorted(map(tuple, state.collect()))
        return {r["id"]: r["status"] for r in state.collect()}, {r["id"]: (r["match_score"], r["status"]) for r in store.listings().collect()}

    first = seen()
    assert store.compact() == 1 and seen() == first
    folded = store.state()
    tail = store.rows("events").where("epoch >= 1")
    assert tail.count() == 0 and folded.count() == len(made) and store.read("scores").count() == len(ids)
    # A late event takes its place by its time; later scores count.
    tracker.move(requests(spark, [(made[1], "Applied", "2026-09-05"), (made[2], "Rejected", "2026-09-05")]), NOW)
    store.apply_scores(jobs.where("job_id = 1").withColumn("match_score", F.lit(77)), NOW)
    after = seen()
    assert after[0][made[1]] == "Offer" and after[0][made[2]] == "Rejected" and after[1][1][0] == 77
    assert store.rows("events").where("epoch >= 1").count() == 2
    plan = store.rows("events").where("epoch >= 1")._jdf.queryExecution().executedPlan().toString()
    assert "epoch" in folder_filters(plan)
    assert store.compact() == 2 and seen() == after and tracker.history().where(F.col("application_id") == made[1]).count() == 3
    assert store.purge(["remoteok"]) == 1 and len(seen()[0]) == len(made) - 1
    store.reset()
    assert store.applications().count() == store.listings().count() == 0


def test_partial_states_merge_in_any_order(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(3)]), NOW)
    tracker = Tracker(store)
    made = [r["application_id"] for r in tracker.create(spark.createDataFrame([(i,) for i in (1, 2, 3)], "job_id long"), NOW).collect()]
    tracker.move(requests(spark, [(a, s, f"2026-09-0{2 + k}") for a in made for k, s in enumerate(["Applied", "Offer", "Applied"])]), NOW)
    events = store.read("events")
    parts = [partial_state(events.where(F.col("event_id") % 3 == k)) for k in (2, 0, 1)]
    merged = merged_state(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[1]))
    whole = current_state(events)
    assert sorted(map(str, state_values(merged).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_timeline_of_one_application_skips_files_and_row_groups(spark, store):
    store.upsert_listings(batch(spark, [("A", str(i), "t") for i in range(400)]), NOW)
    tracker = Tracker(store)
    tracker.create(store.read("listings").select(F.col("id").alias("job_id")), NOW)
    one = store.applications().first()["id"]
    found = store.read("events").where(F.col("application_id") == one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(application_id,{one})" in plan and found.count() == 1
    assert [r["stage"] for r in tracker.timeline(one).collect()] == ["Ready to Apply"]
