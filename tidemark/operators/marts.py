"""Daily marts over the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio

# Which feedback is positive or negative; a rating of three is neither.
POSITIVE_FEEDBACK = (
    "feedback_type = 'THUMBS_UP' or (feedback_type = 'RATING' and feedback_score >= 4)"
)
NEGATIVE_FEEDBACK = (
    "feedback_type = 'THUMBS_DOWN' or (feedback_type = 'RATING' and feedback_score <= 2)"
)


def per_day(fact: DataFrame, *measures: Column, key: str = "date_key") -> DataFrame:
    """Aggregate a fact per day before it meets other facts."""
    return fact.groupBy(key).agg(*measures)


def date_spine(dates: DataFrame, dailies: Sequence[DataFrame]) -> DataFrame:
    """Calendar days between the smallest and largest key of the daily tables.

    Calendar and bounds are small (days, one row); the range condition joins them.
    """
    keys = dailies[0].select("date_key")
    for d in dailies[1:]:
        keys = keys.unionByName(d.select("date_key"))
    bounds = keys.agg(F.min("date_key").alias("lo"), F.max("date_key").alias("hi"))
    return (
        dates.select("date_key", "full_date")
        .join(F.broadcast(bounds), F.col("date_key").between(F.col("lo"), F.col("hi")))
        .select("date_key", "full_date")
    )


def on_spine(spine: DataFrame, dailies: Sequence[DataFrame]) -> DataFrame:
    """Left join the daily tables; counts stay null where a day has no rows."""
    for d in dailies:
        spine = spine.join(d, "date_key", "left")
    return spine


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def product_daily(
    messages: DataFrame, conversations: DataFrame, completions: DataFrame, feedback: DataFrame,
    dates: DataFrame,
) -> DataFrame:
    status = F.col("completion_status")
    dailies = [
        per_day(messages, F.count(F.lit(1)).alias("message_count"),
                F.count_distinct("user_id").alias("active_users")),
        per_day(conversations, F.count(F.lit(1)).alias("conversation_count")),
        per_day(
            completions,
            F.count(F.lit(1)).alias("completion_count"),
            F.count_if(status == "SUCCESS").alias("successful_completion_count"),
            F.count_if(status == "FAILED").alias("failed_completion_count"),
            F.count_if(status == "CANCELLED").alias("cancelled_completion_count"),
        ),
        per_day(
            feedback,
            F.count(F.lit(1)).alias("feedback_count"),
            F.count_if(F.expr(POSITIVE_FEEDBACK)).alias("positive_feedback_count"),
            F.count_if(F.expr(NEGATIVE_FEEDBACK)).alias("negative_feedback_count"),
        ),
    ]

    def rate(n: str, d: str, name: str) -> Column:
        return ratio(F.coalesce(F.col(n), F.lit(0)), F.col(d)).alias(name)

    return on_spine(date_spine(dates, dailies), dailies).select(
        "date_key", "full_date", zero("active_users"), zero("conversation_count"),
        zero("message_count"), zero("completion_count"), zero("successful_completion_count"),
        zero("failed_completion_count"), zero("cancelled_completion_count"),
        rate("successful_completion_count", "completion_count", "completion_success_rate"),
        zero("feedback_count"), zero("positive_feedback_count"), zero("negative_feedback_count"),
        rate("feedback_count", "completion_count", "feedback_rate"),
        rate("positive_feedback_count", "feedback_count", "positive_feedback_rate"),
    )


def user_activity_daily(
    messages: DataFrame, conversations: DataFrame, completions: DataFrame, feedback: DataFrame,
    inferences: DataFrame, dates: DataFrame,
) -> DataFrame:
    """One row per user and active day.

    Every fact contributes sparse measure columns to one union and a single grouped sum
    replaces five key unions and five joins: one shuffle after map-side combine.
    """
    one = F.lit(1).cast("bigint")

    def flag(condition: Column) -> Column:
        return condition.cast("bigint")

    measures = {
        "message_count": (messages, one),
        "conversation_count": (conversations, one),
        "completion_count": (completions, one),
        "successful_completion_count": (completions, flag(F.col("completion_status") == "SUCCESS")),
        "feedback_count": (feedback, one),
        "positive_feedback_count": (feedback, flag(F.expr(POSITIVE_FEEDBACK))),
        "inference_count": (inferences, one),
        "input_tokens": (inferences, F.col("input_tokens")),
        "output_tokens": (inferences, F.col("output_tokens")),
        "total_tokens": (inferences, F.col("total_tokens")),
    }
    sparse = None
    for fact in (messages, conversations, completions, feedback, inferences):
        rows = fact.filter(F.col("user_id").isNotNull() & F.col("date_key").isNotNull()).select(
            "user_id", "date_key",
            *[(m if owner is fact else F.lit(None).cast("bigint")).alias(name)
              for name, (owner, m) in measures.items()],
        )
        sparse = rows if sparse is None else sparse.unionByName(rows)
    summed = sparse.groupBy("user_id", "date_key").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures]
    )
    return summed.join(dates.select("date_key", "full_date"), "date_key").select(
        "date_key", "full_date", "user_id", (F.col("message_count") > 0).alias("active_flag"),
        *measures,
    )


def model_daily(inferences: DataFrame, dates: DataFrame, models: DataFrame) -> DataFrame:
    """Volume, latency percentiles and tokens per model and day; unresolved models kept.

    The percentile buffers hold counts per distinct millisecond value, so their size is
    bounded by the value range and not by the rows of a model-day.
    """
    valid = F.col("is_timestamp_order_valid") & (F.col("latency_ms") >= 0)
    latency = F.when(valid, F.col("latency_ms"))
    status = F.col("inference_status")
    daily = inferences.groupBy("date_key", "model_key", "model_id").agg(
        F.count(F.lit(1)).alias("inference_count"),
        F.count_if(status == "SUCCESS").alias("successful_inference_count"),
        F.count_if(status == "FAILED").alias("failed_inference_count"),
        F.avg(latency).alias("average_latency_ms"),
        F.percentile(latency, [0.5, 0.95, 0.99]).alias("__p"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("input_tokens").alias("average_input_tokens"),
        F.avg("output_tokens").alias("average_output_tokens"),
    )
    return (
        daily.join(dates.select("date_key", "full_date"), "date_key", "left")
        .join(models.select("model_key", "model_name", "model_version", "provider"),
              "model_key", "left")
        .select(
            "date_key", "full_date", "model_key", "model_id", "model_name", "model_version",
            "provider", "inference_count", "successful_inference_count",
            "failed_inference_count",
            ratio(F.col("successful_inference_count"), F.col("inference_count"))
            .alias("inference_success_rate"),
            "average_latency_ms",
            F.col("__p")[0].alias("p50_latency_ms"),
            F.col("__p")[1].alias("p95_latency_ms"),
            F.col("__p")[2].alias("p99_latency_ms"),
            "total_input_tokens", "total_output_tokens", "total_tokens",
            "average_input_tokens", "average_output_tokens",
        )
    )


def subscription_starts(subscriptions: DataFrame) -> DataFrame:
    return per_day(subscriptions, F.count(F.lit(1)).alias("subscription_start_count"))


def subscription_ends(subscriptions: DataFrame, dates: DataFrame) -> DataFrame:
    """Ends counted on their own day: a second calendar lookup re-dates them."""
    ended = subscriptions.filter(F.col("ended_at").isNotNull()).select(
        "subscription_status", F.to_date("ended_at").alias("full_date")
    )
    daily = ended.groupBy("full_date").agg(
        F.count(F.lit(1)).alias("subscription_end_count"),
        F.count_if(F.col("subscription_status") == "CANCELLED").alias("cancelled_subscription_count"),
        F.count_if(F.col("subscription_status") == "EXPIRED").alias("expired_subscription_count"),
    )
    return daily.join(dates.select("full_date", "date_key"), "full_date").drop("full_date")


def purchases_per_day(purchases: DataFrame) -> DataFrame:
    status, kind = F.col("purchase_status"), F.col("purchase_type")

    def completed(amount: str) -> Column:
        return F.sum(F.when(status == "COMPLETED", F.col(amount)))

    return per_day(
        purchases,
        F.count(F.lit(1)).alias("purchase_count"),
        F.count_if(status == "COMPLETED").alias("completed_purchase_count"),
        F.count_if(status == "FAILED").alias("failed_purchase_count"),
        F.count_if(status == "REFUNDED").alias("refunded_purchase_count"),
        F.count_if(kind == "NEW_SUBSCRIPTION").alias("new_subscription_purchase_count"),
        F.count_if(kind == "RENEWAL").alias("renewal_purchase_count"),
        F.count_if(kind == "UPGRADE").alias("upgrade_purchase_count"),
        completed("subtotal_amount").alias("completed_subtotal_amount"),
        completed("discount_amount").alias("completed_discount_amount"),
        completed("tax_amount").alias("completed_tax_amount"),
        completed("total_amount").alias("completed_purchase_amount"),
    )


def payments_per_day(payments: DataFrame) -> DataFrame:
    status = F.col("payment_status")
    return per_day(
        payments,
        F.count(F.lit(1)).alias("payment_attempt_count"),
        F.count_if(status == "SUCCESS").alias("successful_payment_count"),
        F.count_if(status == "FAILED").alias("failed_payment_count"),
        F.count_if(status == "REFUNDED").alias("refunded_payment_count"),
        F.sum(F.when(status.isin("SUCCESS", "REFUNDED"), F.col("payment_amount")).otherwise(0))
        .alias("gross_collected_amount"),
        F.sum("refund_amount").alias("refund_amount"),
    )


def payment_retries(payments: DataFrame) -> DataFrame:
    """Attempts per purchase, dated by the purchase's first payment, then per day."""
    attempts = payments.groupBy("purchase_id").agg(
        F.min("date_key").alias("date_key"), F.count(F.lit(1)).alias("attempt_count")
    )
    n = F.col("attempt_count")
    return per_day(
        attempts,
        F.count(F.lit(1)).alias("purchases_with_payment_attempts"),
        F.count_if(n > 1).alias("purchases_with_multiple_payment_attempts"),
        F.sum(F.greatest(n - 1, F.lit(0))).alias("retry_attempt_count"),
    )


def finance_daily(
    subscriptions: DataFrame, purchases: DataFrame, payments: DataFrame, dates: DataFrame
) -> DataFrame:
    dated = [
        subscription_starts(subscriptions),
        subscription_ends(subscriptions, dates),
        purchases_per_day(purchases),
        payments_per_day(payments),
    ]
    gross, refund = (
        F.coalesce(F.col("gross_collected_amount"), F.lit(0)),
        F.coalesce(F.col("refund_amount"), F.lit(0)),
    )
    return on_spine(date_spine(dates, dated), [*dated, payment_retries(payments)]).select(
        "date_key", "full_date", zero("subscription_start_count"), zero("subscription_end_count"),
        zero("cancelled_subscription_count"), zero("expired_subscription_count"),
        zero("purchase_count"), zero("completed_purchase_count"), zero("failed_purchase_count"),
        zero("refunded_purchase_count"), zero("new_subscription_purchase_count"),
        zero("renewal_purchase_count"), zero("upgrade_purchase_count"),
        zero("completed_subtotal_amount"), zero("completed_discount_amount"),
        zero("completed_tax_amount"), zero("completed_purchase_amount"),
        zero("payment_attempt_count"), zero("successful_payment_count"),
        zero("failed_payment_count"), zero("refunded_payment_count"),
        ratio(F.coalesce(F.col("successful_payment_count"), F.lit(0)),
              F.col("payment_attempt_count")).alias("payment_success_rate"),
        gross.alias("gross_collected_amount"), refund.alias("refund_amount"),
        (gross - refund).alias("net_revenue"),
        zero("purchases_with_payment_attempts"),
        zero("purchases_with_multiple_payment_attempts"), zero("retry_attempt_count"),
        ratio(F.coalesce(F.col("purchases_with_multiple_payment_attempts"), F.lit(0)),
              F.col("purchases_with_payment_attempts")).alias("retry_purchase_rate"),
    )
