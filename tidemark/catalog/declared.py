"""Generic tests declared on the tables: unique, not null, relationships, accepted values.

``declared_tests`` returns every violating row of every test, one scan of a table for all of its
row tests.
"""

from __future__ import annotations

from tidemark import schemas
from tidemark.catalog.registry import query
from tidemark.operators import assertions as A
from tidemark.operators.monitoring import MONITORED
from tidemark.plans.lake import FACT_TABLES, STAGING_TABLES, WIDE_STAGING, monitored_columns

# Per table its row key, the columns without repeats, and those without nulls.
KEYS = {
    "stg_models": ("model_id", ("model_id",), ("model_id",)),
    "stg_devices": ("device_id", ("device_id",), ("device_id",)),
    "stg_plans": ("plan_id", ("plan_id",), ("plan_id",)),
    "stg_users": ("user_id", ("user_id",), ("user_id",)),
    "stg_user_updates": ("update_id", ("update_id",), ("update_id", "user_id")),
    "stg_conversations": ("conversation_id", ("conversation_id",), ("conversation_id", "user_id")),
    "stg_messages": ("message_id", ("message_id",), ("message_id", "conversation_id", "user_id")),
    "stg_completions": ("completion_id", ("completion_id",),
                        ("completion_id", "message_id", "conversation_id", "user_id")),
    "stg_inferences": ("inference_id", ("inference_id",), ("inference_id", "completion_id", "user_id")),
    "stg_feedback": ("feedback_id", ("feedback_id",), ("feedback_id", "completion_id", "user_id")),
    "stg_errors": ("error_id", ("error_id",), ("error_id",)),
    "stg_subscriptions": ("subscription_id", ("subscription_id",), ("subscription_id", "user_id", "plan_id")),
    "stg_purchases": ("purchase_id", ("purchase_id",), ("purchase_id", "user_id", "subscription_id", "plan_id")),
    "stg_payments": ("payment_id", ("payment_id",), ("payment_id", "purchase_id", "user_id")),
    "current_user_state": ("user_id", ("user_id",), ("user_id",)),
    "user_state_history": ("user_id", (), ("user_id", "version_sequence", "effective_start_at")),
    "dim_date": ("date_key", ("date_key", "full_date"), ("date_key", "full_date")),
    "dim_model": ("model_key", ("model_key", "model_id"), ("model_key", "model_id")),
    "dim_device": ("device_key", ("device_key", "device_id"), ("device_key", "device_id")),
    "dim_plan": ("subscription_plan_key", ("subscription_plan_key", "plan_id"),
                 ("subscription_plan_key", "plan_id")),
    "dim_user": ("user_key", ("user_key",), ("user_key", "user_id")),
    "dim_user_sensitive": ("user_key", ("user_key",), ("user_key", "user_id")),
    "gold_product": ("date_key", ("date_key",), ("date_key",)),
    "gold_finance": ("date_key", ("date_key",), ("date_key",)),
    "gold_ml": ("date_key", (), ("date_key",)),
    "gold_user_activity": ("user_id", (), ("user_id", "date_key")),
    "dq_freshness": ("entity_name", ("entity_name",), ("entity_name",)),
    "dq_reconciliation": ("reconciliation_name", ("reconciliation_name",), ("reconciliation_name",)),
    "user_snapshot": ("dbt_scd_id", ("dbt_scd_id",), ("user_id", "dbt_scd_id", "dbt_valid_from")),
}
# Fixed values: (table, column, parent); the parent's column has the same name.
RELATIONSHIPS = (
    ("stg_user_updates", "user_id", "stg_users"),
    ("stg_conversations", "user_id", "stg_users"),
    ("stg_messages", "conversation_id", "stg_conversations"),
    ("stg_messages", "device_id", "stg_devices"),
    ("stg_completions", "message_id", "stg_messages"),
    ("stg_inferences", "completion_id", "stg_completions"),
    ("stg_inferences", "model_id", "stg_models"),
    ("stg_feedback", "completion_id", "stg_completions"),
    ("stg_subscriptions", "plan_id", "stg_plans"),
    ("stg_purchases", "subscription_id", "stg_subscriptions"),
    ("stg_payments", "purchase_id", "stg_purchases"),
    ("dim_user", "user_key", "dim_user_sensitive"),
    ("dim_user_sensitive", "user_key", "dim_user"),
    ("gold_product", "date_key", "dim_date"),
    ("gold_finance", "date_key", "dim_date"),
    ("gold_ml", "date_key", "dim_date"),
    ("gold_user_activity", "date_key", "dim_date"),
)
# Closed vocabularies by table and column.
ACCEPTED = {
    ("stg_devices", "device_type"): schemas.DEVICE_TYPES,
    ("stg_devices", "app_platform"): schemas.APP_PLATFORMS,
    ("stg_plans", "plan_name"): schemas.PLAN_NAMES,
    ("stg_plans", "currency"): schemas.CURRENCIES,
    ("stg_users", "account_status"): schemas.ACCOUNT_STATUSES,
    ("stg_users", "signup_source"): schemas.SIGNUP_SOURCES,
    ("stg_user_updates", "field_name"): schemas.UPDATE_FIELDS,
    ("stg_completions", "completion_status"): schemas.COMPLETION_STATUSES,
    ("stg_inferences", "inference_status"): schemas.INFERENCE_STATUSES,
    ("stg_feedback", "feedback_type"): schemas.FEEDBACK_TYPES,
    ("stg_errors", "error_source"): schemas.ERROR_SOURCES,
    ("stg_errors", "severity"): schemas.SEVERITIES,
    ("stg_subscriptions", "subscription_status"): schemas.SUBSCRIPTION_STATUSES,
    ("stg_purchases", "purchase_type"): schemas.PURCHASE_TYPES,
    ("stg_purchases", "purchase_status"): schemas.PURCHASE_STATUSES + ("PENDING",),
    ("stg_payments", "payment_status"): schemas.PAYMENT_STATUSES,
    ("stg_payments", "payment_method"): schemas.PAYMENT_METHODS,
}


def tested_columns() -> dict[str, list[str]]:
    """Columns of the wide tables that the tests read, and the tables built on them."""
    out = monitored_columns(rates=False)
    for entity in ("messages", "conversations", "completions", "feedback", "model_inferences"):
        out[FACT_TABLES[entity]].append("user_id")
    out["gold_user_activity"] = ["user_id", "date_key"]
    staged = {name: entity for entity, name in STAGING_TABLES.items()}
    for name, (key, unique, present) in KEYS.items():
        if name in WIDE_STAGING:
            columns = [key, *unique, *present, "user_id", MONITORED[staged[name]], "ingested_at", "physical_partition_date"]
            columns += [c for t, c, p in RELATIONSHIPS if name in (t, p)] + [c for t, c in ACCEPTED if t == name]
            columns += ["model_id"] if name == "stg_errors" else []  # looked up by its fact
            out[name] = list(dict.fromkeys(columns))
    return out


def violations(k):
    narrow = k.narrowed(tested_columns())
    narrow.stagings
    tables = {name: getattr(narrow, name) for name in KEYS}
    return A.declared(tables, KEYS, RELATIONSHIPS, ACCEPTED)


def _sql() -> str:
    parts = []
    for t, (key, unique, present) in KEYS.items():
        parts += [f"select 'unique.{t}.{c}' as check_name, cast({c} as varchar) as row_key from {t}"
                  f" group by {c} having count({c}) > 1" for c in unique]
        parts += [f"select 'not_null.{t}.{c}', cast({key} as varchar) from {t} where {c} is null" for c in present]
    for t, c, p in RELATIONSHIPS:
        parts.append(f"select 'relationships.{t}.{c}', cast({KEYS[t][0]} as varchar) from {t}"
                     f" where {c} is not null and not exists (select 1 from {p} q where q.{c} = {t}.{c})")
    for (t, c), values in ACCEPTED.items():
        listed = ", ".join(f"'{v}'" for v in values)
        parts.append(f"select 'accepted.{t}.{c}', cast({KEYS[t][0]} as varchar) from {t} where {c} not in ({listed})")
    return " union all ".join(parts)


SQL = _sql()
query("declared_tests", "check_name row_key", violations, SQL)
