"""Physical plans keep the shape that holds at scale."""

from pyspark.sql import functions as F

from tidemark.operators import monitoring, staging
from tidemark.sources.tables import read_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_limits_copies_before_the_shuffle(lake):
    text = plan(staging.dedup_replay(staging.typed(lake.clean("payments"), "payments"), "payment_id"))
    exchange = text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[exchange:]


def test_filters_and_columns_reach_the_scan(spark, lake):
    df = read_table(spark, lake.sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))
    text = plan(df.select("l_orderkey"))
    assert "LessThan(l_shipdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp>" in text


def test_one_scan_per_fact_for_all_rates(lake):
    text = plan(monitoring.quality_counts(lake.facts))
    assert text.count("FileScan") == len(monitoring.QUALITY_METRICS)


def test_stored_dimension_is_broadcast_by_its_size(spark, lake):
    def joined():
        return plan(lake.fact_message.select("device_key").join(lake.dim_device, "device_key"))

    assert "BroadcastHashJoin" in joined()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "BroadcastHashJoin" not in joined()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cartesian_products_in_facts(lake):
    from tidemark.operators import facts

    df = facts.fact_message(lake.stg_messages, lake.dim_user, lake.dim_device, lake.dim_date)
    text = plan(df)
    assert "CartesianProduct" not in text
    # The only joins without a key meet one row: the number of all rows, against which keys are hot.
    loops = [line for line in text.splitlines() if "BroadcastNestedLoopJoin" in line]
    assert all("__all" in line for line in loops)
