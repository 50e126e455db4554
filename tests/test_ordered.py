"""Running values: hot keys cut into segments give the values of one plain window."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import (
    lagged, leading, position, running, running_last, running_last_before, running_sum,
)


@pytest.mark.parametrize("hot_rows", [2, 40, 10_000])
@pytest.mark.parametrize("seconds", [1, 3_000, 90_000])
def test_segments_equal_plain_window(spark, hot_rows, seconds):
    """Times within a second, an hour and beyond a day; every ninth time is null."""
    df = spark.range(600).select(
        F.when(F.col("id") % 7 == 0, None)
        .otherwise(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)))
        .alias("key"),
        F.when(F.col("id") % 9 != 0, F.timestamp_micros(
            F.lit(1704067200_000_000) + F.pmod(F.hash("id"), F.lit(90_000)).cast("bigint") * (seconds * 1_000_000 // 90_000))).alias("t"),
        F.col("id"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"),
    )
    got = running(df, ["key"], ["t", "id"], [
        running_sum("total", F.col("v")), running_last("last_v", F.col("v")),
        running_last_before("before_v", F.col("v")), lagged("lag_v", F.col("v")),
        leading("lead_v", F.col("v")), position("n"),
    ], hot_rows=hot_rows)
    w = Window.partitionBy("key").orderBy("t", "id")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("total"),
        F.last("v", ignorenulls=True).over(upto).alias("last_v"),
        F.last("v", ignorenulls=True).over(prior).alias("before_v"),
        F.lag("v").over(w).alias("lag_v"), F.lead("v").over(w).alias("lead_v"),
        F.row_number().over(w).alias("n"))
    cols = ["key", "id", "total", "last_v", "before_v", "lag_v", "lead_v", "n"]
    assert rows(got, *cols) == rows(want, *cols)


def test_numeric_segments(spark):
    df = spark.range(500).select(F.lit("k").alias("key"), F.col("id").alias("v"))
    got = running(df, ["key"], ["v"], [running_sum("s", F.col("v"))], hot_rows=10,
                  segment_of=F.floor(F.col("v") / 30))
    assert all(r["s"] == r["v"] * (r["v"] + 1) // 2 for r in got.collect())


def test_hot_key_within_one_hour_is_split(spark):
    from tidemark.functions import ordered

    df = spark.range(20_000).select(F.lit("k").alias("key"), F.timestamp_millis("id").alias("t"), "id")
    got = running(df, ["key"], ["t", "id"], [position("n")], hot_rows=1_000)
    assert got.filter(F.col("n") != F.col("id") + 1).isEmpty()
    plan = got._jdf.queryExecution().analyzed().toString()
    assert ordered._SEG in plan and "percentile_approx" in plan


def test_null_order_does_not_depend_on_size(spark):
    df = spark.createDataFrame(
        [("k", None, 1), ("k", None, 2), ("k", 0, 3), ("k", 7200, 4)], "key string, s int, id int"
    ).select("key", F.timestamp_seconds("s").alias("t"), "id")
    for hot_rows in (1, 2, 1_000):
        got = running(df, ["key"], ["t", "id"], [position("n"), lagged("p", F.col("id"))], hot_rows=hot_rows)
        assert rows(got, "id", "n", "p") == [(1, 1, None), (2, 2, 1), (3, 3, 2), (4, 4, 3)]
