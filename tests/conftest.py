import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from rolefold.session import build_session  # noqa: E402


# Built on import: column expressions at module level need a running session.
SPARK = build_session("tests", **{
    "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.driver.memory": "4g",
    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
})
SPARK.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture
def values(spark):
    """Evaluate named expressions over one-column rows and return plain tuples."""
    def run(rows, *exprs, schema="x string"):
        df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
        out = [tuple(r) for r in df.select(*exprs).collect()]
        return [r[0] for r in out] if len(exprs) == 1 else out

    return run
