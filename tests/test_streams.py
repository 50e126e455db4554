"""Streaming twins on rows that come later than any watermark would allow."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import upserts
from tidemark.streaming import twins
from tidemark.streaming.tables import KeyedTable, read_batches, read_files

ARRIVALS = [
    [("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 10:00:00"), ("b", "2024-03-01 10:00:00")],
    [("c", "2024-03-02 10:00:00"), ("b", "2024-03-02 11:00:00")],
    # First copies and whole days two months behind, and replays of everything.
    [("d", "2024-01-01 12:00:00"), ("e", None), ("a", "2024-01-01 10:00:00"), ("c", "2024-06-01 10:00:00"), (None, "2024-01-01 13:00:00")],
    [("d", "2024-01-01 12:00:00"), ("b", "2024-02-01 10:00:00")],
]


@pytest.fixture
def drained(spark, make, tmp_path):
    def run(twin):
        for arrival in ARRIVALS:
            df = make(arrival, "id string, ingested_at timestamp")
            df.write.mode("append").parquet(f"{tmp_path}/in")
            twin(read_files(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return f"{tmp_path}/out"

    return run


def test_dedup_keeps_rows_behind_any_watermark(spark, drained):
    out = drained(lambda s, o, c: twins.dedup(s, "id", o, c, "ingested_at", buckets=4))
    got = KeyedTable(spark, out, ["id"], 4).read()
    assert got.columns == ["id", "ingested_at"]
    assert rows(got.selectExpr("id", "string(ingested_at)")) == sorted([
        ("a", "2024-01-01 10:00:00"), ("b", "2024-02-01 10:00:00"), ("c", "2024-03-02 10:00:00"),
        ("d", "2024-01-01 12:00:00"), ("e", None), (None, "2024-01-01 13:00:00")], key=repr)


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_keyed_table_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], 8, keep=2)
    read, want, size = [], {}, []
    original = table.read

    def counted(versions=None):
        if versions is not None:
            read.append(sum(folder_bytes(f"{tmp_path}/t/rows/batch_id={b}/bucket={k}") for k, b in versions.items()))
        return original(versions)

    table.read = counted
    for n in range(20):
        ids = [n % 5, 100 + n % 3]
        want |= {i: n for i in ids}
        batch = spark.createDataFrame([(i, n) for i in ids], "id int, v int")
        for _ in range(1 + (n == 7)):
            table.merge(batch, n, lambda both: upserts.latest_per_key(both, "id", ("v",)))
        size.append(folder_bytes(f"{tmp_path}/t"))
    assert rows(original()) == sorted(want.items(), key=repr)
    # Neither what a batch reads nor the folder grows with the number of batches.
    assert max(read[12:]) <= 1.5 * max(read[4:12]) and size[-1] <= 1.5 * size[9]


def test_keyed_table_repeats_a_batch_from_the_state_before_it(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], 2)

    def add(n, batch_id):
        batch = spark.createDataFrame([(1, n)], "id int, v int")
        table.merge(batch, batch_id, lambda both: both.groupBy("id").agg(F.sum("v").cast("int").alias("v")))

    for batch_id in (0, 1, 1, 1, 2):
        add(10, batch_id)
    assert rows(table.read()) == [(1, 30)]


def test_daily_counts_keep_days_behind_any_watermark(spark, drained):
    got = twins.summed_days(read_batches(spark, drained(twins.daily_counts)))
    assert rows(got.selectExpr("string(activity_date)", "row_count")) == sorted([
        ("2024-01-01", 5), ("2024-01-02", 1), ("2024-02-01", 1), ("2024-03-01", 1), ("2024-03-02", 2), ("2024-06-01", 1), (None, 1)], key=repr)
