"""Queries that read a few columns of the facts do not carry, sort or store whole rows."""

import pytest
from conftest import SF_DIR
from conftest import rows as rows_of
from pyspark.sql import functions as F

from tidemark.catalog import load
from tidemark.functions.columns import first_of_repeated, first_row
from tidemark.operators import assertions as A
from tidemark.plans.lake import COUNTED_COLUMNS, Lake, monitored_columns


def test_rows_of_their_own_key_stay_where_they_are(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") % 100 == 0, F.lit("twice")).when(F.col("id") % 501 != 0, F.col("id").cast("string")).alias("k"),
        "id")
    got = first_of_repeated(df, "k", [F.col("id").desc()])
    assert rows_of(got) == rows_of(first_row(df, ["k"], [F.col("id").desc()]))
    first, _ = got._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)
    assert "LeftOuter" in first


def test_narrow_facts_equal_whole_ones(spark):
    whole, lake = Lake(spark, SF_DIR), Lake(spark, SF_DIR)
    columns = {"fact_payment": ["payment_id", "user_key", "date_key"], "fact_message": ["message_id", "user_key_match_count"]}
    narrow = lake.narrowed(columns)
    for name, kept in columns.items():
        assert rows_of(getattr(narrow, name).select(*kept)) == rows_of(getattr(whole, name).select(*kept))
        assert getattr(narrow, name).columns == getattr(whole, name).columns
    assert not {"once.fact_payment", "once.stg_payments"} & set(lake._memo)
    with pytest.raises(Exception, match="was not kept"):
        narrow.fact_payment.select("payment_amount").collect()


def test_narrow_lakes_keep_their_tables_apart(spark):
    lake = Lake(spark, SF_DIR)
    first = lake.monitored.dq_freshness
    others = [lake.narrowed(monitored_columns(rates=False, totals=False)).dq_freshness, lake.dq_freshness]
    assert len({f for df in [first, *others] for f in df.inputFiles()}) == sum(len(df.inputFiles()) for df in [first, *others])
    assert rows_of(first) == rows_of(others[0]) == rows_of(others[1])


def test_parents_are_not_looked_up_for_an_unused_flag(spark):
    narrow = Lake(spark, SF_DIR).narrowed({})

    def joined(*columns):
        return "__parent_at" in narrow.stg_payments.select(*columns)._jdf.queryExecution().optimizedPlan().toString()

    assert joined("payment_id", "is_timestamp_order_valid") and not joined("payment_id", "user_id")


def test_missing_keys_and_repeats_by_hash(make):
    child = make([("a", 1), ("b", 2), ("b", 3), (None, 4), ("c", 5)], "k string, n int")
    parent = make([("a",), ("c",)], "k string")
    assert rows_of(A.few_orphans(child, "k", parent, "k").select("k", "n")) == rows_of(A.orphans(child, "k", parent, "k"))
    assert rows_of(A.few_not_unique(child, "k")) == rows_of(A.not_unique(child, ["k"])) == [("b", 2)]


@pytest.mark.parametrize("key", [
    "chk_fact_keys",
    "chk_fact_counts",
    "declared_tests",
    "health_rollup",
    "chk_pit_unique",
    "dq_freshness",
    "dq_issues",
    "chk_dq_ranges",
    "violations_all",
    "combined_status",
    "dq_reconciliation",
])
def test_no_whole_fact_is_built(spark, key):
    lake = Lake(spark, SF_DIR)
    load()[key].build(lake)
    assert not [n for n in lake._memo if n.startswith(("once.fact_", "once.gold_", "once.stg_pay", "once.stg_mess"))]


@pytest.mark.parametrize("key", ["dq_quality_counts", "dq_quality", "chk_gold_silver", "dq_volume", "dq_volume_default"])
def test_counts_are_taken_from_counted_columns(spark, key):
    lake = Lake(spark, SF_DIR)
    load()[key].build(lake)
    assert not [n for n in lake._memo if n.startswith(("once.fact_", "once.gold_", "once.dq_", "once.stg_pay", "once.stg_mess"))]


def test_overlapping_versions_multiply_counted_rows_too(spark):
    whole, lake = Lake(spark, SF_DIR), Lake(spark, SF_DIR)
    users = whole.dim_user
    for k in (whole, lake):
        k._memo["once.dim_user"] = users.unionByName(users.withColumn("user_key", F.concat("user_key", F.lit("x"))))
    days = rows_of(lake.narrowed(COUNTED_COLUMNS).fact_payment.groupBy("date_key").count())
    assert days == rows_of(whole.fact_payment.groupBy("date_key").count())
    assert sum(n for _, n in days) > whole.stg_payments.count()
