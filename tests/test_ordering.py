"""The large-group path must give what a plain window gives, hot groups and block borders included."""

import random

import pytest
from pyspark.sql import Window, functions as F

from rolefold.operators.ordering import fill_forward, lag_within, rank_within, with_position


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = []
    for n in range(400):
        # One key holds well over a third of all rows and spans many blocks.
        key = rng.choice([7, 7, 7, rng.randrange(12), rng.randrange(12)])
        rows.append((key, rng.randrange(40), n, rng.choice(["a", "b", None, None])))
    return spark.createDataFrame(rows, "k int, t int, n int, v string")


ORDER = [F.col("t"), F.col("n")]
LARGE = [{"block_rows": size} for size in (1, 7, 64, 1000)]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def test_positions_are_consecutive(log):
    got = [r["pos"] for r in with_position(log, [F.col("k"), *ORDER]).orderBy("k", "t", "n").collect()]
    assert got == list(range(400))


@pytest.mark.parametrize("limits", LARGE, ids=lambda x: str(x["block_rows"]))
def test_lag(log, limits):
    values = {"v": "before", "n": "n_before"}
    plain = Window.partitionBy("k").orderBy(*ORDER)
    expected = log.withColumns({out: F.lag(src).over(plain) for src, out in values.items()})
    assert rows(lag_within(log, ["k"], ORDER, values, **limits)) == rows(expected)


@pytest.mark.parametrize("limits", LARGE, ids=lambda x: str(x["block_rows"]))
def test_rank(log, limits):
    expected = log.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*ORDER)))
    assert rows(rank_within(log, ["k"], ORDER, "r", **limits)) == rows(expected)


@pytest.mark.parametrize("limits", LARGE, ids=lambda x: str(x["block_rows"]))
def test_fill(log, limits):
    upto = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    expected = log.withColumn("now", F.last("v", ignorenulls=True).over(upto))
    assert rows(fill_forward(log, ["k"], ORDER, {"v": "now"}, **limits)) == rows(expected)


def test_descending_order_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4), (None, 5)], "k string, t int")
    order = [F.col("t").desc_nulls_last()]
    assert rows(rank_within(df, ["k"], order, "r", 2)) == rows(rank_within(df, ["k"], order, "r"))
    assert rows(lag_within(df, ["k"], order, {"t": "p"}, 2)) == rows(lag_within(df, ["k"], order, {"t": "p"}))
