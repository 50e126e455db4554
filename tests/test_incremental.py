"""Daily loads with incremental facts equal a rebuild; guards stop a load before it writes."""

import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.plans import incremental
from tidemark.plans.daily_run import MarkerError, UpdateError, check_marker, run_day

DAYS = [dt.date(2024, 1, 10) + dt.timedelta(days=i) for i in range(4)]
ENTITIES = ("users", "user_updates", "devices", "models", "subscription_plans", "subscriptions", "conversations", "messages", "completions", "payments", "purchases")


def batches(lake, day):
    """Rows that landed on a day; the first day brings everything before it."""
    out = {}
    for e in ENTITIES:
        rows = lake.bronze(e)
        landed = F.to_date("ingested_at") if "ingested_at" in rows.columns else F.col("dt")
        rows = rows.filter(landed == F.lit(day))
        out[e] = rows.drop("dt") if "ingested_at" in rows.columns else rows.withColumn("dt", F.lit(day))
    return out


@pytest.fixture(scope="module")
def loaded(spark, lake, tmp_path_factory):
    root, written = str(tmp_path_factory.mktemp("daily")), {}
    for day in DAYS:
        day_batches = batches(lake, day)
        known = lake.bronze("users").filter(F.to_date("ingested_at") <= F.lit(DAYS[-1])) if day == DAYS[0] else None
        if known is not None:
            day_batches["users"] = known.drop("dt").withColumn("ingested_at", F.lit(f"{day} 00:00:00").cast("timestamp")).dropDuplicates(["user_id"])
            for e in ("models", "devices", "subscription_plans"):
                day_batches[e] = lake.bronze(e).withColumn("dt", F.lit(day))
        for e in ("models", "devices", "subscription_plans"):
            if day != DAYS[0]:
                day_batches.pop(e)
        day_batches["user_updates"] = day_batches["user_updates"].join(spark.read.parquet(f"{root}/bronze/users").select("user_id") if day != DAYS[0] else day_batches["users"].select("user_id"), "user_id", "left_semi")
        run_day(spark, root, day, {e: b for e, b in day_batches.items()})
        written[day] = incremental.update_facts(spark, root, ("fact_message", "fact_completion", "fact_payment"))
    return root, written


def test_three_days_equal_a_rebuild(spark, loaded):
    root, written = loaded
    whole = incremental.BronzeLake(spark, root)
    for fact in ("fact_message", "fact_completion", "fact_payment"):
        want = getattr(whole, fact)
        got = spark.read.parquet(f"{root}/facts/{fact}").select(*want.columns)
        assert want.count() and rows(got) == rows(want), fact
    assert all(len(days["fact_message"]) <= 4 for days in written.values())


def test_scans_are_pruned(spark, loaded):
    root, _ = loaded
    lake = incremental.BronzeLake(spark, root)
    low = incremental.Bounds(dt.datetime(2024, 1, 12), dt.date(2024, 1, 12))
    ids = incremental.recent_rows(lake.physical("messages"), "created_at", low, "dt").select("message_id")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "(dt#" in plan and plan.count("PartitionFilters: [isnotnull(dt") == 2
    assert "GreaterThanOrEqual(created_at" in plan
    assert "message_text" not in plan


def test_merge_moves_rows_between_partitions(spark, make, tmp_path):
    path, ddl = f"{tmp_path}/t", "id string, v int, source_partition_date date"
    first = make([("a", 1, "2024-01-01"), ("b", 1, "2024-01-02"), ("c", 1, "2024-01-03"), ("d", 1, None)], ddl)
    incremental.merge_partitions(spark, path, first, "id", f"{tmp_path}/s")
    before = os.stat(f"{path}/source_partition_date=2024-01-03").st_mtime_ns
    fresh = make([("b", 2, "2024-01-01"), ("d", 2, "2024-01-04")], ddl)
    days = incremental.merge_partitions(spark, path, fresh, "id", f"{tmp_path}/s")
    assert set(days) == {None, dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 4)}
    got = rows(spark.read.parquet(path).selectExpr("id", "v", "string(source_partition_date)"))
    assert got == [("a", 1, "2024-01-01"), ("b", 2, "2024-01-01"), ("c", 1, "2024-01-03"), ("d", 2, "2024-01-04")]
    assert os.stat(f"{path}/source_partition_date=2024-01-03").st_mtime_ns == before


UPDATES = "update_id string, user_id string, field_name string, new_value string, updated_at timestamp, ingested_at timestamp"


@pytest.mark.parametrize("user,field", [("nobody", "email"), ("u", "shoe_size"), ("u", None)])
def test_bad_updates_stop_the_load(spark, make, tmp_path, user, field):
    at = "2024-01-01 00:00:01"
    batch = {
        "users": make([("u", at)], "user_id string, ingested_at timestamp"),
        "user_updates": make([(f"x{user}", user, field, "v", at, at)], UPDATES),
    }
    with pytest.raises(UpdateError):
        run_day(spark, str(tmp_path), dt.date(2024, 1, 1), batch)
    assert not os.path.exists(f"{tmp_path}/bronze") and not os.path.exists(f"{tmp_path}/state")


def test_marker_is_read_again(spark, loaded):
    with pytest.raises(MarkerError):
        check_marker(spark, loaded[0], DAYS[0], {"users": -1})
