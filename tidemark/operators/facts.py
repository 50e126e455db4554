"""Point-in-time joins and the nine facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import whole_seconds
from tidemark.functions.ordered import HOT_ROWS, running, running_last, running_sum


def _bounds(versions: DataFrame, key: str, version_key: str, start: str, end: str) -> DataFrame:
    """Start (+1) and end (-1) rows of every non-empty version, from one pass.

    At equal times ends sort before starts, and both before facts, which makes the
    intervals half-open.
    """
    s, e = F.col(start), F.col(end)
    version = F.struct(e.alias("e"), F.col(version_key).alias("v"))
    opening = F.struct(s.alias("t"), F.lit(1).alias("kind"), version.alias("opened"))
    closing = F.struct(e.alias("t"), F.lit(0).alias("kind"), F.lit(None).alias("opened"))
    return (
        versions.filter(F.col(key).isNotNull() & s.isNotNull() & (e.isNull() | (e > s)))
        .select(F.col(key).alias("k"), F.col(version_key).cast("string").alias("tie"),
                F.explode(F.array(opening, closing)).alias("b"))
        .filter(F.col("b.t").isNotNull())
        .select("k", "b.t", "b.kind", "tie", "b.opened",
                F.when(F.col("b.kind") == 1, 1).otherwise(-1).cast("bigint").alias("step"))
    )


def disjoint(
    versions: DataFrame, key: str, start: str = "effective_start_at", end: str = "effective_end_at",
    version_key: str = "user_key", hot_rows: int = HOT_ROWS,
) -> bool:
    """True when no two versions of a key are valid at the same time."""
    swept = running(_bounds(versions, key, version_key, start, end), ["k"], ["t", "kind", "tie"],
                    [running_sum("active", F.col("step"))], hot_rows=hot_rows)
    return swept.filter(F.col("active") > 1).isEmpty()


def pit_join(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    at: str,
    fact_id: str,
    version_key: str = "user_key",
    start: str = "effective_start_at",
    end: str = "effective_end_at",
    hot_rows: int = HOT_ROWS,
    disjoint_versions: bool = False,
) -> DataFrame:
    """Left join each fact to the versions valid at its time, ``start <= at < end``.

    Adds ``version_key`` and ``<version_key>_match_count``. Facts and version bounds are
    swept together in time order per key, so the cost is linear in both and never the
    product of a key's facts and versions, and a hot key is cut into time segments. Facts
    covered by overlapping versions (a data fault) get every matching version from a
    range join, unless ``disjoint`` has shown that there are none.
    """
    count_name = f"{version_key}_match_count"
    bounds = _bounds(versions, key, version_key, start, end)
    # Facts without key or time match nothing; their own id spreads them over all tasks.
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    # Flat columns, so that those nobody asks for do not travel. Facts leave the sums as they are, so
    # their order among themselves does not matter.
    inside = {c: f"__f_{c}" for c in facts.columns}
    lane = facts.select(
        F.when(usable, F.col(key)).otherwise(F.concat(F.lit("\x01"), F.col(fact_id))).alias("k"),
        F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp")).alias("t"),
        F.lit(2).alias("kind"), F.lit(None).cast("string").alias("tie"),
        F.lit(0).cast("bigint").alias("step"), *[F.col(c).alias(n) for c, n in inside.items()],
    )
    own = [F.col(n).alias(c) for c, n in inside.items()]
    swept = (
        running(
            lane.unionByName(bounds, allowMissingColumns=True), ["k"], ["t", "kind", "tie"],
            [running_sum("active", F.col("step")), running_last("newest", F.col("opened"))],
            hot_rows=hot_rows)
        .filter(F.col("kind") == 2)
        .select(*inside.values(), "k", "t", "active", "newest")
    )
    covered = F.col("newest.e").isNull() | (F.col("newest.e") > F.col("t"))
    single = (F.col("active") == 0) | ((F.col("active") == 1) & covered)
    resolved = (swept if disjoint_versions else swept.filter(single)).select(
        *own,
        F.when(F.col("active") == 1, F.col("newest.v")).alias(version_key),
        F.col("active").alias(count_name),
    )
    if disjoint_versions:
        return resolved
    valid = versions.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"),
                            F.col(version_key).alias("v"))
    several = (
        swept.filter(~single)
        .alias("a")
        .join(
            valid.alias("b"),
            (F.col("a.k") == F.col("b.k"))
            & (F.col("a.t") >= F.col("b.s"))
            & (F.col("b.e").isNull() | (F.col("a.t") < F.col("b.e"))),
        )
        .select(*own, F.col("b.v").alias(version_key), F.col("a.active").alias(count_name))
    )
    return resolved.unionByName(several)


def _with_user(
    rows: DataFrame, users: DataFrame, fact_id: str, at: str, hot_rows: int, disjoint_versions: bool
) -> DataFrame:
    return pit_join(
        rows,
        users.select("user_id", "user_key", "effective_start_at", "effective_end_at"),
        "user_id", at, fact_id, hot_rows=hot_rows, disjoint_versions=disjoint_versions,
    )


def _lookup(rows: DataFrame, dim: DataFrame, natural: str, key: str) -> DataFrame:
    return rows.join(dim.select(natural, key), natural, "left")


def _with_date(rows: DataFrame, dates: DataFrame, at: str) -> DataFrame:
    d = dates.select("date_key", F.col("full_date").alias("__day"))
    return rows.join(d, F.col(at).cast("date") == F.col("__day"), "left").drop("__day")


def _finish(rows: DataFrame, columns: list[str | Column]) -> DataFrame:
    return rows.withColumnRenamed("physical_partition_date", "source_partition_date").select(*columns)


def fact_conversation(
    conversations: DataFrame, users: DataFrame, dates: DataFrame, hot_rows: int = HOT_ROWS,
    disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(conversations, users, "conversation_id", "created_at", hot_rows, disjoint_versions)
    return _finish(_with_date(rows, dates, "created_at"), [
        "conversation_id", "user_key", "user_key_match_count", "date_key", "user_id",
        "created_at", "ingested_at", "source_partition_date",
    ])


def fact_message(
    messages: DataFrame, users: DataFrame, devices: DataFrame, dates: DataFrame,
    hot_rows: int = HOT_ROWS, disjoint_versions: bool = False,
) -> DataFrame:
    slim = messages.withColumn("message_length_chars", F.length("message_text")).drop("message_text")
    rows = _with_user(slim, users, "message_id", "created_at", hot_rows, disjoint_versions)
    rows = _lookup(rows, devices, "device_id", "device_key")
    return _finish(_with_date(rows, dates, "created_at"), [
        "message_id", "conversation_id", "user_key", "user_key_match_count", "device_key",
        "date_key", "user_id", "device_id", "sequence_number", "message_length_chars",
        "created_at", "ingested_at", "source_partition_date", "is_message_text_missing",
        "is_timestamp_order_valid",
    ])


def fact_completion(
    completions: DataFrame, users: DataFrame, dates: DataFrame, hot_rows: int = HOT_ROWS,
    disjoint_versions: bool = False,
) -> DataFrame:
    slim = completions.drop("response_text")
    rows = _with_user(slim, users, "completion_id", "requested_at", hot_rows, disjoint_versions)
    rows = rows.withColumn(
        "completion_duration_seconds",
        F.when(
            F.col("is_timestamp_order_valid"),
            whole_seconds(F.col("requested_at"), F.col("completed_at")),
        ),
    )
    return _finish(_with_date(rows, dates, "requested_at"), [
        "completion_id", "message_id", "conversation_id", "user_key", "user_key_match_count",
        "date_key", "user_id", "source_user_id", "completion_status", "requested_at",
        "completed_at", "completion_duration_seconds", "ingested_at", "source_partition_date",
        "is_user_id_recovered", "is_user_id_missing", "is_timestamp_order_valid",
    ])


def fact_model_inference(
    inferences: DataFrame, users: DataFrame, models: DataFrame, dates: DataFrame,
    hot_rows: int = HOT_ROWS, disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(inferences, users, "inference_id", "request_at", hot_rows, disjoint_versions)
    rows = _lookup(rows, models, "model_id", "model_key").withColumn(
        "total_tokens", F.col("input_tokens") + F.col("output_tokens")
    )
    return _finish(_with_date(rows, dates, "request_at"), [
        "inference_id", "completion_id", "user_key", "user_key_match_count", "model_key",
        "date_key", "user_id", "model_id", "request_at", "response_at", "latency_ms",
        "input_tokens", "output_tokens", "total_tokens", "inference_status", "ingested_at",
        "source_partition_date", "is_model_id_missing", "is_timestamp_order_valid",
    ])


def fact_feedback(
    feedback: DataFrame, users: DataFrame, dates: DataFrame, hot_rows: int = HOT_ROWS,
    disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(feedback, users, "feedback_id", "created_at", hot_rows, disjoint_versions)
    return _finish(_with_date(rows, dates, "created_at"), [
        "feedback_id", "completion_id", "user_key", "user_key_match_count", "date_key",
        "user_id", "feedback_type", "feedback_score", "created_at", "ingested_at",
        "source_partition_date", "is_feedback_type_missing",
    ])


def fact_error(
    errors: DataFrame, users: DataFrame, models: DataFrame, dates: DataFrame,
    hot_rows: int = HOT_ROWS, disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(errors, users, "error_id", "occurred_at", hot_rows, disjoint_versions)
    rows = _lookup(rows, models, "model_id", "model_key")
    return _finish(_with_date(rows, dates, "occurred_at"), [
        "error_id", "conversation_id", "message_id", "completion_id", "inference_id",
        "user_key", "user_key_match_count", "model_key", "date_key", "user_id", "model_id",
        "error_source", "error_type", "error_code", "severity", "occurred_at", "ingested_at",
        "source_partition_date",
    ])


def fact_subscription(
    subscriptions: DataFrame, users: DataFrame, plans: DataFrame, dates: DataFrame,
    hot_rows: int = HOT_ROWS, disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(subscriptions, users, "subscription_id", "started_at", hot_rows, disjoint_versions)
    rows = _lookup(rows, plans, "plan_id", "subscription_plan_key")
    return _finish(_with_date(rows, dates, "started_at"), [
        "subscription_id", "user_key", "user_key_match_count", "subscription_plan_key",
        "date_key", "user_id", "plan_id", "subscription_status", "started_at", "ended_at",
        "actual_monthly_price", "updated_at", "ingested_at", "source_partition_date",
    ])


def fact_purchase(
    purchases: DataFrame, users: DataFrame, plans: DataFrame, dates: DataFrame,
    hot_rows: int = HOT_ROWS, disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(purchases, users, "purchase_id", "purchase_created_at", hot_rows, disjoint_versions)
    rows = _lookup(rows, plans, "plan_id", "subscription_plan_key")
    return _finish(_with_date(rows, dates, "purchase_created_at"), [
        "purchase_id", "subscription_id", "user_key", "user_key_match_count",
        "subscription_plan_key", "date_key", "user_id", "plan_id", "purchase_type",
        "purchase_status", "subtotal_amount", "discount_amount", "tax_amount", "total_amount",
        "purchase_created_at", "updated_at", "ingested_at", "source_partition_date",
        "is_purchase_type_missing",
    ])


def fact_payment(
    payments: DataFrame, users: DataFrame, dates: DataFrame, hot_rows: int = HOT_ROWS,
    disjoint_versions: bool = False,
) -> DataFrame:
    rows = _with_user(payments, users, "payment_id", "processed_at", hot_rows, disjoint_versions)
    return _finish(_with_date(rows, dates, "processed_at"), [
        "payment_id", "purchase_id", "user_key", "user_key_match_count", "date_key", "user_id",
        "payment_status", "payment_method", "payment_amount", "refund_amount", "processed_at",
        "refunded_at", "updated_at", "ingested_at", "source_partition_date",
        "is_payment_method_missing", "is_timestamp_order_valid",
    ])


def incremental_rows(
    source: DataFrame, target: DataFrame, at: str, lookback_days: int = 2,
    source_partition: str = "physical_partition_date",
    target_partition: str = "source_partition_date",
) -> DataFrame:
    """Source rows within the lookback of the target's newest event or newest partition.

    The two bounds are read first (one aggregate row), so the filter holds literals and
    prunes partitions. An empty target selects everything.
    """
    newest = target.agg(
        F.max(at).alias("event"), F.max(target_partition).alias("partition")
    ).first()
    if newest["event"] is None and newest["partition"] is None:
        return source
    condition = F.lit(False)
    if newest["event"] is not None:
        condition = condition | (F.col(at) >= F.lit(newest["event"] - dt.timedelta(days=lookback_days)))
    else:
        condition = condition | F.col(at).isNotNull()
    if newest["partition"] is not None:
        condition = condition | (
            F.col(source_partition) >= F.lit(newest["partition"] - dt.timedelta(days=lookback_days))
        )
    else:
        condition = condition | F.col(source_partition).isNotNull()
    return source.filter(condition)
