"""Typed, deduplicated, flagged views of the physical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import first_of_repeated, first_row, in_order


def typed(df: DataFrame, entity: str) -> DataFrame:
    """Project an entity to its declared types; unparsable values become null."""
    fields = schemas.entity_schema(entity).fields
    out = []
    for f in fields:
        same = df.schema[f.name].dataType == f.dataType
        col = F.col(f.name) if same else F.col(f.name).try_cast(f.dataType)
        out.append(col.alias("physical_partition_date" if f.name == "dt" else f.name))
    return df.select(*out)


def dedup_replay(
    df: DataFrame, key: str, ingested: str = "ingested_at", partition: str = "physical_partition_date"
) -> DataFrame:
    """Keep the earliest copy per key; missing times rank last, content breaks ties."""
    return first_row(df, [key], _earliest(df, ingested, partition))


def _earliest(df: DataFrame, ingested: str, partition: str) -> list[Column]:
    return [
        F.col(ingested).asc_nulls_last(),
        F.col(partition).asc_nulls_last(),
        F.xxhash64(*df.columns).asc(),
    ]


def dedup_few(
    df: DataFrame, key: str, ingested: str = "ingested_at", partition: str = "physical_partition_date"
) -> DataFrame:
    """The same for a scan in which few keys repeat: rows of other keys are not shuffled."""
    return first_of_repeated(df, key, _earliest(df, ingested, partition))


def dedup_latest(df: DataFrame, key: str, partition: str = "physical_partition_date") -> DataFrame:
    """Keep the newest snapshot row per key; content breaks ties."""
    return first_row(
        df, [key], [F.col(partition).desc_nulls_last(), F.xxhash64(*df.columns).asc()]
    )


def missing_flag(column: str, name: str) -> Column:
    return F.col(column).isNull().alias(name)


def against_parent(
    child: DataFrame, parent: DataFrame, key: str, at: str, parent_at: str
) -> DataFrame:
    """Flag whether the child is not earlier than its parent; null without a parent.

    ``parent`` must be unique on ``key``.
    """
    # Grouped, so that the join goes where the flag is not asked for.
    p = parent.groupBy(key).agg(F.first(parent_at).alias("__parent_at"), F.lit(True).alias("__found"))
    return (
        child.join(p, key, "left")
        .withColumn(
            "is_timestamp_order_valid",
            F.when(F.col("__found"), F.col(at) >= F.col("__parent_at")),
        )
        .select(*child.columns, "is_timestamp_order_valid")
    )


def recover_key(child: DataFrame, parent: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a lost key of the child from its parent and say so.

    The child's own value stays as ``source_<column>``.
    """
    p = parent.select(key, F.col(column).alias("__parent_value"))
    own = F.col(f"source_{column}")
    joined = child.withColumnRenamed(column, f"source_{column}").join(p, key, "left")
    return joined.select(
        *[F.col(c) if c != column else F.col(f"source_{column}") for c in child.columns],
        F.coalesce(own, F.col("__parent_value")).alias(column),
        (own.isNull() & F.col("__parent_value").isNotNull()).alias(f"is_{column}_recovered"),
        F.coalesce(own, F.col("__parent_value")).isNull().alias(f"is_{column}_missing"),
    )


def _deduplicated(df: DataFrame, entity: str) -> DataFrame:
    """Conversations are grouped from events, which is not done over for each pass; others are scans."""
    keep = dedup_replay if entity == "conversations" else dedup_few
    return keep(typed(df, entity), schemas.ENTITY_ID[entity])


def _latest(df: DataFrame, entity: str) -> DataFrame:
    return dedup_latest(typed(df, entity), schemas.ENTITY_ID[entity])


def stg_models(bronze: DataFrame) -> DataFrame:
    return _latest(bronze, "models")


def stg_devices(bronze: DataFrame) -> DataFrame:
    return _latest(bronze, "devices")


def stg_subscription_plans(bronze: DataFrame) -> DataFrame:
    return _latest(bronze, "subscription_plans")


def stg_users(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "users").select("*", missing_flag("email", "is_email_missing"))


def stg_user_updates(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "user_updates")


def stg_conversations(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "conversations")


def stg_messages(bronze: DataFrame, conversations: DataFrame) -> DataFrame:
    flagged = _deduplicated(bronze, "messages").select(
        "*", missing_flag("message_text", "is_message_text_missing")
    )
    return against_parent(flagged, conversations, "conversation_id", "created_at", "created_at")


def stg_completions(bronze: DataFrame, messages: DataFrame) -> DataFrame:
    recovered = recover_key(
        _deduplicated(bronze, "completions"), messages, "message_id", "user_id"
    )
    return recovered.withColumn(
        "is_timestamp_order_valid", in_order(F.col("requested_at"), F.col("completed_at"))
    )


def stg_model_inferences(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "model_inferences").select(
        "*",
        missing_flag("model_id", "is_model_id_missing"),
        in_order(F.col("request_at"), F.col("response_at")).alias("is_timestamp_order_valid"),
    )


def stg_feedback(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "feedback").select(
        "*", missing_flag("feedback_type", "is_feedback_type_missing")
    )


def stg_errors(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "errors")


def stg_subscriptions(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "subscriptions")


def stg_purchases(bronze: DataFrame) -> DataFrame:
    return _deduplicated(bronze, "purchases").select(
        "*", missing_flag("purchase_type", "is_purchase_type_missing")
    )


def stg_payments(bronze: DataFrame, purchases: DataFrame) -> DataFrame:
    flagged = _deduplicated(bronze, "payments").select(
        "*", missing_flag("payment_method", "is_payment_method_missing")
    )
    return against_parent(
        flagged, purchases, "purchase_id", "processed_at", "purchase_created_at"
    )
