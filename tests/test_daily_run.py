"""Daily load: order, retry, gaps, and nothing written when a check fails."""

import datetime as dt

import pytest
from conftest import rows

from tidemark.plans.daily_run import DateSequenceError, run_day
from tidemark.sources.partitions import SchemaMismatch

DDL = "conversation_id string, user_id string, created_at timestamp, ingested_at timestamp"


def test_days_in_order(make, spark, tmp_path):
    root = str(tmp_path)

    def day(n, *ids, landed=None):
        text = f"2024-01-{landed or n:02d} 00:00:01"
        return run_day(spark, root, dt.date(2024, 1, n),
                       {"conversations": make([(i, "u", text, text) for i in ids], DDL)})

    assert day(1, "a", "b")["rows"] == {"conversations": 2}
    assert day(1, "x")["status"] == "ALREADY_COMPLETED"
    with pytest.raises(DateSequenceError):
        day(3, "c")
    with pytest.raises(SchemaMismatch):
        day(2, "c", landed=3)
    assert day(2, "c")["mode"] == "new_day"
    got = spark.read.parquet(f"{root}/bronze/conversations")
    assert rows(got, "conversation_id") == [("a",), ("b",), ("c",)]
    counts = spark.read.parquet(f"{root}/state/daily_counts")
    assert rows(counts, "activity_date", "row_count") == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 2), 1)]
