"""Streams deduplicated by keyed state."""

import pytest
from pyspark.sql import functions as F

from rolefold.session import run_dir
from rolefold.streaming.ingest import stream_files
from rolefold.streaming.stateful import distinct_stream, ingest_distinct

SCHEMA = "n int, k string, at timestamp"


@pytest.fixture
def base(spark):
    return run_dir(spark, "state")


def land(spark, base, rows):
    shaped = spark.createDataFrame(rows, "n int, k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    shaped.coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, **bounds):
    stream = stream_files(spark, f"{base}/in", SCHEMA, per_trigger=1)
    query = ingest_distinct(stream, ["k"], f"{base}/out", f"{base}/progress", **bounds)
    return query, sorted((r.k or "-") for r in spark.read.schema(SCHEMA).parquet(f"{base}/out").collect())


def test_equals_distinct_and_survives_restarts(spark, base):
    for rows in ([(1, "a", "2026-01-01"), (2, "b", "2026-01-01"), (3, "a", "2026-01-02"), (4, None, "2026-01-02")],
                 [(5, "b", "2026-01-03"), (6, "c", "2026-01-03"), (7, None, "2026-01-03")]):
        land(spark, base, rows)
    query, keys = run(spark, base)
    assert keys == ["-", "a", "b", "c"]
    assert query.lastProgress["stateOperators"][0]["customMetrics"].keys() >= {"rocksdbBytesCopied"}
    assert run(spark, base)[1] == keys        # nothing has arrived
    land(spark, base, [(8, "a", "2020-01-01"), (9, "d", "2020-01-01"), (10, "d", "2026-01-03")])
    assert run(spark, base)[1] == ["-", "a", "b", "c", "d"]


def test_a_horizon_bounds_the_state(spark, base):
    bounds = {"time": "at", "horizon": "1 day"}
    land(spark, base, [(k, f"k{k}", "2026-01-01 00:00:00") for k in range(50)])
    assert len(run(spark, base, **bounds)[1]) == 50
    # Within the horizon a key is known.
    land(spark, base, [(99, "k1", "2026-01-01 12:00:00"), (100, "new", "2026-01-01 12:00:00")])
    assert len(run(spark, base, **bounds)[1]) == 51
    land(spark, base, [(101, "later", "2026-02-01 00:00:00")])
    run(spark, base, **bounds)
    land(spark, base, [(102, "last", "2026-02-01 00:00:01")])
    query, keys = run(spark, base, **bounds)
    assert len(keys) == 53
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_both_bounds_or_none(spark):
    with pytest.raises(ValueError):
        distinct_stream(spark.createDataFrame([], SCHEMA), ["k"], time="at")
