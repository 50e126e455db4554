"""Calendar and reference dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import date_key, surrogate_key


def day_bounds(sources: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Smallest and largest day over several date or timestamp columns of several tables.

    Each table is reduced to one row before the results meet.
    """
    parts = []
    for df, columns in sources:
        lows = [F.min(F.col(c).cast("date")) for c in columns]
        highs = [F.max(F.col(c).cast("date")) for c in columns]
        parts.append(
            df.agg(
                F.array_min(F.array(*lows)).alias("first_day"),
                F.array_max(F.array(*highs)).alias("last_day"),
            )
        )
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    return joined.agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def calendar(bounds: DataFrame, margin: int = 1) -> DataFrame:
    """Gap-free calendar from the bounds widened by ``margin`` days on both sides."""
    days = bounds.filter(F.col("first_day").isNotNull()).select(
        F.explode(
            F.sequence(
                F.date_sub("first_day", margin),
                F.date_add("last_day", margin),
                F.expr("interval 1 day"),
            )
        ).alias("full_date")
    )
    day = F.col("full_date")
    iso_day = F.weekday(day) + 1
    return days.select(
        date_key(day).alias("date_key"),
        day,
        iso_day.alias("day_of_week"),
        F.dayofmonth(day).alias("day_of_month"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        iso_day.isin(6, 7).alias("is_weekend"),
    )


def dim_date(
    models: DataFrame, current_users: DataFrame, subscriptions: DataFrame, snapshot: DataFrame
) -> DataFrame:
    return calendar(
        day_bounds(
            [
                (models, ["release_date"]),
                (current_users, ["signup_at", "source_user_partition_date", "latest_user_update_at"]),
                (subscriptions, ["started_at", "ended_at", "updated_at"]),
                (snapshot, ["dbt_valid_from", "dbt_valid_to"]),
            ]
        )
    )


def keyed(reference: DataFrame, key: Column, key_name: str) -> DataFrame:
    """Reference dimension with a surrogate key in front."""
    columns = [c for c in reference.columns if c != "physical_partition_date"]
    return reference.select(
        surrogate_key(key).alias(key_name),
        *columns,
        F.col("physical_partition_date").alias("source_partition_date"),
    )


def dim_device(devices: DataFrame) -> DataFrame:
    return keyed(devices, F.col("device_id"), "device_key")


def dim_model(models: DataFrame) -> DataFrame:
    return keyed(models, F.col("model_id"), "model_key")


def dim_subscription_plan(plans: DataFrame) -> DataFrame:
    return keyed(plans, F.col("plan_id"), "subscription_plan_key")
