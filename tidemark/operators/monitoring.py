"""Freshness, volume, rate drift, reconciliation and health roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, whole_seconds

# Event-time column per monitored entity.
MONITORED = {
    "messages": "created_at",
    "conversations": "created_at",
    "completions": "requested_at",
    "model_inferences": "request_at",
    "feedback": "created_at",
    "errors": "occurred_at",
    "subscriptions": "started_at",
    "purchases": "purchase_created_at",
    "payments": "processed_at",
}

_LATE = "is_timestamp_order_valid = false"

# Rate metrics per entity, as SQL predicates.
QUALITY_METRICS: dict[str, dict[str, str]] = {
    "messages": {
        "missing_message_text_rate": "is_message_text_missing",
        "invalid_message_timestamp_rate": _LATE,
        "unresolved_message_user_key_rate": "user_id is not null and user_key is null",
        "unresolved_message_device_key_rate":
            "device_id is not null and device_key is null",
    },
    "completions": {
        "invalid_completion_timestamp_rate": _LATE,
        "recovered_completion_user_id_rate": "is_user_id_recovered",
        "failed_completion_rate": "completion_status = 'FAILED'",
    },
    "model_inferences": {
        "missing_inference_model_rate": "is_model_id_missing",
        "invalid_inference_timestamp_rate": _LATE,
        "failed_inference_rate": "inference_status = 'FAILED'",
    },
    "feedback": {"missing_feedback_type_rate": "is_feedback_type_missing"},
    "purchases": {"missing_purchase_type_rate": "is_purchase_type_missing"},
    "payments": {
        "missing_payment_method_rate": "is_payment_method_missing",
        "invalid_payment_timestamp_rate": _LATE,
        "failed_payment_rate": "payment_status = 'FAILED'",
    },
}


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def freshness(facts: Mapping[str, DataFrame], warn_hours: float = 72.0) -> DataFrame:
    """Delay of each entity behind the newest event over all entities."""
    seen = union_all([
        facts[name].agg(
            F.max(at).alias("latest_event_at"),
            F.max("ingested_at").alias("latest_ingested_at"),
            F.max("source_partition_date").alias("latest_partition_date"),
        ).select(F.lit(name).alias("entity_name"), "*")
        for name, at in MONITORED.items()
    ])
    # One row per entity, so the unpartitioned window holds nine rows.
    newest = F.max("latest_event_at").over(Window.partitionBy(F.lit(1)))
    delay = whole_seconds(F.col("latest_event_at"), F.col("monitoring_reference_at")) / F.lit(3600.0)
    return (
        seen.withColumn("monitoring_reference_at", newest)
        .withColumn("freshness_delay_hours", delay)
        .withColumn("freshness_warning_threshold_hours", F.lit(float(warn_hours)))
        .withColumn(
            "freshness_status",
            F.when(F.col("latest_event_at").isNull(), "FAIL")
            .when(F.col("freshness_delay_hours") > warn_hours, "WARN")
            .otherwise("PASS"),
        )
    )


def daily_entity_counts(facts: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([
        facts[name].groupBy("date_key").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("entity_name"), "date_key", "row_count")
        for name in MONITORED
    ])


def trailing(column: str, partition: Sequence[str], order: str, days: int = 7) -> Column:
    """Mean of the preceding ``days`` rows, current row excluded."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-days, -1)
    return F.avg(column).over(w)


def volume(facts: Mapping[str, DataFrame], dates: DataFrame, warning_pct: float = 0.5) -> DataFrame:
    """Rows per entity and day on the entity's own spine against the trailing mean.

    The windows run over entity-days, a table bounded by entities times calendar days.
    """
    counts = daily_entity_counts(facts).filter(F.col("date_key").isNotNull())
    bounds = counts.groupBy("entity_name").agg(
        F.min("date_key").alias("lo"), F.max("date_key").alias("hi")
    )
    spine = dates.select("date_key", F.col("full_date").alias("activity_date")).join(
        F.broadcast(bounds), F.col("date_key").between(F.col("lo"), F.col("hi"))
    )
    filled = spine.join(counts, ["entity_name", "date_key"], "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )
    ordered = Window.partitionBy("entity_name").orderBy("activity_date")
    mean, change = F.col("rolling_7_day_average"), F.col("rolling_7_day_change_pct")
    return (
        filled.withColumn("previous_day_row_count", F.lag("row_count").over(ordered))
        .withColumn("rolling_7_day_average", trailing("row_count", ["entity_name"], "activity_date"))
        .withColumn("previous_day_change_pct",
                    ratio(F.col("row_count") - F.col("previous_day_row_count"),
                          F.col("previous_day_row_count")))
        .withColumn("rolling_7_day_change_pct", ratio(F.col("row_count") - mean, mean))
        .withColumn("volume_warning_threshold_pct", F.lit(float(warning_pct)))
        .withColumn(
            "volume_status",
            F.when(mean.isNull(), "PASS")
            .when((mean == 0) & (F.col("row_count") > 0), "WARN")
            .when((mean > 0) & (F.abs(change) > warning_pct), "WARN")
            .otherwise("PASS"),
        )
        .drop("lo", "hi")
    )


def quality_counts(facts: Mapping[str, DataFrame]) -> DataFrame:
    """Daily numerator and denominator of every rate: one aggregate per fact, then unpivot."""
    parts = []
    for entity, metrics in QUALITY_METRICS.items():
        daily = facts[entity].groupBy("date_key").agg(
            F.count(F.lit(1)).alias("denominator"),
            *[F.count_if(F.expr(c)).alias(n) for n, c in metrics.items()],
        )
        parts.append(
            daily.unpivot(["date_key", "denominator"], list(metrics), "metric_name", "numerator")
            .select("date_key", F.lit(entity).alias("entity_name"), "metric_name", "numerator",
                    "denominator")
        )
    return union_all(parts)


def quality(facts: Mapping[str, DataFrame], dates: DataFrame, delta: float = 0.005) -> DataFrame:
    """Rates against the mean of the seven preceding observed rows; only increases warn."""
    series = ["entity_name", "metric_name"]
    rates = (
        quality_counts(facts)
        .join(dates.select("date_key", F.col("full_date").alias("metric_date")), "date_key")
        .withColumn("metric_rate", ratio(F.col("numerator"), F.col("denominator")))
    )
    rate, base = F.col("metric_rate"), F.col("rolling_7_day_rate")
    return (
        rates.withColumn(
            "previous_rate",
            F.lag("metric_rate").over(Window.partitionBy(*series).orderBy("metric_date")))
        .withColumn("rolling_7_day_rate", trailing("metric_rate", series, "metric_date"))
        .withColumn("quality_warning_delta", F.lit(float(delta)))
        .withColumn(
            "quality_status",
            F.when(rate.isNull() | base.isNull(), "PASS")
            .when(rate - base > delta, "WARN")
            .otherwise("PASS"),
        )
    )


def row_total(df: DataFrame, name: str, measure: Column | None = None) -> DataFrame:
    """One row (name, total): a row count, or the sum of a measure."""
    total = F.count(F.lit(1)) if measure is None else F.sum(measure)
    return df.agg(total.cast("bigint").alias("total")).select(F.lit(name).alias("name"), "total")


def reconcile(pairs: Sequence[tuple[str, str, str, str, str]], totals: DataFrame) -> DataFrame:
    """Compare named totals pairwise: (name, source layer, target layer, source, target).

    ``totals`` has one row per table, so each table is scanned once however many
    reconciliations use it.
    """
    spark = totals.sparkSession
    plan = F.broadcast(spark.createDataFrame(
        pairs, "reconciliation_name string, source_layer string, target_layer string,"
               " source_name string, target_name string"))
    source = totals.select(F.col("name").alias("source_name"), F.col("total").alias("source_count"))
    target = totals.select(F.col("name").alias("target_name"), F.col("total").alias("target_count"))
    gap = F.col("target_count") - F.col("source_count")
    return (
        source.join(plan, "source_name", "right")
        .join(F.broadcast(target), "target_name", "left")
        .select(
            "reconciliation_name", "source_layer", "target_layer", "source_count", "target_count",
            gap.alias("difference"),
            ratio(gap, F.col("source_count")).alias("difference_pct"),
            F.when(gap == 0, "PASS").otherwise("FAIL").alias("status"),
        )
    )


# Staging-to-fact and fact-to-mart comparisons (mart, measure).
STAGING_TO_FACT = ("conversations", "messages", "completions", "model_inferences", "feedback",
                   "errors", "subscriptions", "purchases", "payments")
FACT_TO_MART = {
    "messages": ("product", "message_count"),
    "conversations": ("product", "conversation_count"),
    "completions": ("product", "completion_count"),
    "feedback": ("product", "feedback_count"),
    "model_inferences": ("ml", "inference_count"),
    "purchases": ("finance", "purchase_count"),
    "payments": ("finance", "payment_attempt_count"),
}


def pipeline_reconciliation(
    staging: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], marts: Mapping[str, DataFrame]
) -> DataFrame:
    totals = [row_total(staging[e], f"staging.{e}") for e in STAGING_TO_FACT]
    totals += [row_total(facts[e], f"fact.{e}") for e in STAGING_TO_FACT]
    pairs = [(f"staging_to_fact_{e}", "staging", "silver", f"staging.{e}", f"fact.{e}")
             for e in STAGING_TO_FACT]
    for mart in sorted({m for m, _ in FACT_TO_MART.values()}):
        measures = {e: c for e, (m, c) in FACT_TO_MART.items() if m == mart}
        sums = marts[mart].agg(*[F.sum(c).cast("bigint").alias(f"gold.{e}") for e, c in measures.items()])
        totals.append(sums.unpivot([], [f"`gold.{e}`" for e in measures], "name", "total"))
        pairs += [(f"silver_to_gold_{e}", "silver", "gold", f"fact.{e}", f"gold.{e}") for e in measures]
    return reconcile(pairs, union_all(totals))


def check_rows(
    fresh: DataFrame, vol: DataFrame, qual: DataFrame, recon: DataFrame
) -> DataFrame:
    """All check results as (category, check_name, reference_date, status)."""
    return union_all([
        fresh.select(F.lit("freshness").alias("category"), F.col("entity_name").alias("check_name"),
                     F.to_date("monitoring_reference_at").alias("reference_date"),
                     F.col("freshness_status").alias("status")),
        vol.select(F.lit("volume"), "entity_name", "activity_date", "volume_status")
        .toDF("category", "check_name", "reference_date", "status"),
        qual.select(F.lit("quality"), F.concat_ws(".", "entity_name", "metric_name"), "metric_date",
                    "quality_status").toDF("category", "check_name", "reference_date", "status"),
        recon.select(F.lit("reconciliation"), "reconciliation_name", F.lit(None).cast("date"),
                     "status").toDF("category", "check_name", "reference_date", "status"),
    ])


def latest_checks(checks: DataFrame) -> DataFrame:
    """Rows of each category's newest reference date; undated categories are kept whole."""
    newest = checks.groupBy("category").agg(F.max("reference_date").alias("newest"))
    return (
        checks.join(F.broadcast(newest), "category")
        .filter(F.col("newest").isNull() | (F.col("reference_date") == F.col("newest")))
        .drop("newest")
    )


def issue_counts(checks: DataFrame) -> DataFrame:
    """Non-passing rows per category."""
    status = F.upper("status")
    return checks.groupBy("category").agg(
        F.count_if(status != "PASS").alias("issue_count"),
        F.count(F.lit(1)).alias("check_count"),
    )


# Raw state to check status.
STATUS_MAP = {
    "PASS": ("PASS", "SUCCESS"),
    "WARN": ("WARN", "WARNING"),
    "FAIL": ("FAIL", "FAILED", "ERROR", "INTERNAL_ERROR", "TIMED_OUT", "CANCELED", "CANCELLED"),
    "UNAVAILABLE": ("UNAVAILABLE",),
}


def normalise_status(raw: Column) -> Column:
    """Map raw states to PASS, WARN, FAIL, UNAVAILABLE or UNKNOWN."""
    text = F.upper(F.coalesce(raw, F.lit("")))
    known = [F.when(text.isin(*words), status) for status, words in STATUS_MAP.items()]
    return F.coalesce(*known, F.lit("UNKNOWN"))


def health_rollup(
    checks: DataFrame, now: Column, stale_hours: float = 36.0
) -> DataFrame:
    """Counts per category and overall with the worst status and staleness."""
    status = F.col("status")
    rows = checks.select("category", normalise_status(F.col("status")).alias("status"), "reference_date")
    rolled = rows.rollup("category").agg(
        F.count_if(status == "PASS").alias("pass_count"),
        F.count_if(status == "WARN").alias("warn_count"),
        F.count_if(status == "FAIL").alias("fail_count"),
        F.count_if(status.isin("UNKNOWN", "UNAVAILABLE")).alias("unknown_count"),
        F.max("reference_date").alias("latest_reference_date"),
        F.count_distinct("reference_date").alias("reference_dates"),
    )
    age = whole_seconds(F.col("latest_reference_date").cast("timestamp"), now) / F.lit(3600.0)
    return rolled.select(
        F.coalesce("category", F.lit("ALL")).alias("category"),
        "pass_count", "warn_count", "fail_count", "unknown_count", "latest_reference_date",
        "reference_dates",
        F.when(F.col("fail_count") > 0, "FAIL")
        .when(F.col("warn_count") + F.col("unknown_count") > 0, "WARN")
        .when(F.col("pass_count") > 0, "PASS").otherwise("UNKNOWN").alias("overall_status"),
        F.when(age.isNull(), "UNKNOWN").when(age > stale_hours, "STALE").otherwise("CURRENT")
        .alias("staleness"),
    )


def combined_status(pipeline: Column, monitoring: Column, staleness: Column) -> Column:
    """Overall state of a pipeline and its monitoring; a null state means unavailable."""
    return (
        F.when(pipeline.isNull() & monitoring.isNull(), "UNAVAILABLE")
        .when((pipeline == "FAIL") | (monitoring == "FAIL"), "FAIL")
        .when(pipeline.isNull() | monitoring.isNull(), "PARTIAL")
        .when((monitoring == "WARN") | (staleness == "STALE"), "WARN")
        .when(monitoring == "UNKNOWN", "UNKNOWN")
        .when(pipeline.isin("RUNNING", "UNKNOWN"), pipeline)
        .otherwise("PASS")
    )


def run_status(result_state: Column, lifecycle_state: Column) -> Column:
    """State of a run: any result but SUCCESS is a failure, no result may be running."""
    result = F.upper(F.coalesce(result_state, F.lit("")))
    return (
        F.when(result == "SUCCESS", "PASS")
        .when(result != "", "FAIL")
        .when(F.upper(lifecycle_state).isin("PENDING", "QUEUED", "RUNNING", "TERMINATING"), "RUNNING")
        .otherwise("UNKNOWN")
    )


def run_rollup(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task outcome counts per run with the run's own state."""
    result = F.upper(F.coalesce("result_state", F.lit("")))
    per_run = tasks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(result == "SUCCESS").alias("passed_tasks"),
        F.count_if((result != "") & (result != "SUCCESS")).alias("failed_tasks"),
        F.max("end_time").alias("last_task_end"),
    )
    return runs.join(per_run, "run_id", "left").select(
        "run_id", "job_id",
        run_status(F.col("result_state"), F.col("lifecycle_state")).alias("run_status"),
        F.coalesce("task_count", F.lit(0)).alias("task_count"),
        F.coalesce("passed_tasks", F.lit(0)).alias("passed_tasks"),
        F.coalesce("failed_tasks", F.lit(0)).alias("failed_tasks"),
        "last_task_end",
    )
