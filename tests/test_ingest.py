"""Conforming, parsing, idempotent loads and partition selection."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.sources import partitions as S

DDL = "conversation_id string, user_id string, created_at timestamp, ingested_at timestamp, dt date"


def batch(make, *ids, day="2024-01-01"):
    return make([(i, "u", f"{day} 00:00:00", f"{day} 00:00:01", day) for i in ids], DDL)


def test_conform(make):
    target = schemas.entity_schema("conversations")
    got = S.conform(batch(make, "a").drop("user_id"), target)
    assert got.schema.fieldNames() == target.fieldNames()
    assert rows(got, "user_id") == [(None,)]
    with pytest.raises(S.SchemaMismatch):
        S.conform(batch(make, "a").withColumn("extra", F.lit(1)), target)
    with pytest.raises(S.SchemaMismatch):
        S.conform(batch(make, "a").withColumn("user_id", F.lit(1)), target)


def test_strict_parse_fails_and_lenient_keeps_text(make):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    df = make([('{"a": 1}',), ('{"a": "x"}',)], "line string")
    with pytest.raises(Exception):
        S.parse_strict(df, "line", schema).collect()
    got = S.parse_lenient(df, "line", schema)
    assert rows(got, "a", "_corrupt_record") == sorted([(1, None), (None, '{"a": "x"}')], key=repr)


def test_daily_load_is_idempotent_and_reprocesses(make, spark, tmp_path):
    path = str(tmp_path / "conversations")
    S.append_partitions(batch(make, "a", "b"), path)
    S.append_partitions(batch(make, "c", day="2024-01-02"), path)
    S.append_partitions(batch(make, "a", "b"), path)
    assert spark.read.parquet(path).count() == 3
    # Reprocessing a day replaces exactly that partition.
    S.append_partitions(batch(make, "z"), path)
    assert rows(spark.read.parquet(path), "conversation_id") == [("c",), ("z",)]
    S.full_refresh(batch(make, "n"), path)
    assert rows(spark.read.parquet(path), "conversation_id") == [("n",)]


def test_entities_load_in_order_and_create_once(make, spark, tmp_path):
    loaded = S.append_entities({"conversations": batch(make, "a", "b"), "users": None}, str(tmp_path / "bronze"))
    assert loaded == {"conversations": 2}
    once = str(tmp_path / "once")
    assert S.create_once(batch(make, "a"), once) == 1
    with pytest.raises(Exception):
        S.create_once(batch(make, "b"), once)
    assert not S.table_exists(spark, str(tmp_path / "nothing"))


def test_ndjson_partitions(make, spark, tmp_path):
    root = str(tmp_path / "raw")
    batch(make, "a").unionByName(batch(make, "b", day="2024-01-02")).write.partitionBy("dt").json(root)
    got = S.read_ndjson(spark, root, schemas.entity_schema("conversations"))
    assert rows(got, "conversation_id", "dt") == [("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 1, 2))]
    assert S.partition_mismatch(got).isEmpty()


def test_incremental_selection(make):
    days = make([(f"2024-01-0{d}",) for d in range(1, 8)], "dt date")
    mark = make([("2024-01-04",)], "watermark date")
    none = make([(None,)], "watermark date")

    def picked(*a, **k):
        return [r["dt"].day for r in S.incremental_partitions(days, *a, **k).orderBy("dt").collect()]

    assert picked(mark) == [5, 6, 7]
    assert picked(mark, lookback_days=2) == [5, 6, 7]
    assert picked(mark, lookback_days=4) == [3, 4, 5, 6, 7]
    assert picked(none) == list(range(1, 8))
    assert picked(none, lookback_days=2) == list(range(1, 8))
    assert picked(mark, start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 3)) == [2, 3]


def test_representative_rows(make):
    src = make([("a", 1), ("b", 2), ("c", None)], "id string, v int")
    dst = make([("a", 1), ("b", 3), ("c", None)], "id string, v int")
    assert rows(S.representative_mismatches(src, dst, "id", ["v"])) == [("b",)]
    assert rows(S.table_diff(src, dst), "id", "v", "surplus") == [("b", 2, 1), ("b", 3, -1)]
    assert rows(S.digest_tree({"t": src})) == rows(S.digest_tree({"t": src.orderBy(F.desc("id"))}))
    assert S.table_digest(src).first() != S.table_digest(dst).first()


def test_reports_and_file_summary(make, spark, tmp_path):
    from tidemark.operators.profiling import entity_summary

    S.write_report(make([("a", 1)], "k string, v int"), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 1
    path = str(tmp_path / "t")
    S.append_partitions(batch(make, "a").unionByName(batch(make, "b", day="2024-01-02")), path)
    got = entity_summary({"conversations": spark.read.parquet(path)}, files=True).first()
    assert (got["rows"], got["partitions"], got["files"]) == (2, 2, 2) and got["bytes"] > 0


def test_incremental_filter_prunes_and_handles_empty(make, spark, tmp_path):
    from tidemark.operators.facts import incremental_rows

    path = str(tmp_path / "s")
    for d in ("2024-01-01", "2024-01-05", "2024-01-09"):
        S.append_partitions(batch(make, d, day=d), path)
    src = spark.read.parquet(path)
    target = make([("2024-01-09 00:00:00", "2024-01-09")], "created_at timestamp, source_partition_date date")
    got = incremental_rows(src, target, "created_at", source_partition="dt")
    assert rows(got, "conversation_id") == [("2024-01-09",)]
    assert incremental_rows(src, target.limit(0), "created_at", source_partition="dt").count() == 3
