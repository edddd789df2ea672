"""The paths for large inputs, forced on small ones: no broadcast joins, every partition taken for skewed,
blocks of a few rows. Rows must stay the same."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.rolefold.blockRows": "50",
}


@pytest.fixture(scope="module")
def forced(spark):
    before = {key: spark.conf.get(key, None) for key in FORCED}
    for key, value in FORCED.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [
    "token_coverage_score", "score_router_band", "assigned_pair_scores", "top_bullets", "tailored_resumes", "pending_queue",
    "applications_table", "application_sorts", "kanban_rank", "applied_flags", "notes_fold", "stage_transitions", "history_json",
    "audit_trail", "purge_cascade", "upsert_is_new", "tracked_applications", "run_metrics",
])
def test_same_rows(forced, oracle, name):
    assert compare(forced, oracle, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_no_broadcast_is_left(forced):
    plan = entry.queries()["score_router_band"](forced, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
