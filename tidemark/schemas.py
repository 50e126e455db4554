"""Declared entity schemas, keys, event times and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = "decimal(18,2)"

# Source columns per entity. Every event row also carries
# ``ingested_at`` and the physical partition date ``dt``.
ENTITY_DDL = {
    "models": "model_id string, model_name string, model_version string, provider string,"
    " release_date date, active_flag boolean",
    "devices": "device_id string, device_type string, operating_system string, browser string,"
    " app_platform string",
    "subscription_plans": f"plan_id string, plan_name string, monthly_price {MONEY},"
    " currency string, active_flag boolean",
    "users": "user_id string, email string, name string, country_code string,"
    " account_status string, signup_source string, signup_at timestamp",
    "user_updates": "update_id string, user_id string, field_name string, old_value string,"
    " new_value string, updated_at timestamp",
    "conversations": "conversation_id string, user_id string, created_at timestamp",
    "messages": "message_id string, conversation_id string, user_id string, device_id string,"
    " sequence_number bigint, message_text string, created_at timestamp",
    "completions": "completion_id string, message_id string, conversation_id string,"
    " user_id string, completion_status string, requested_at timestamp,"
    " completed_at timestamp, response_text string",
    "model_inferences": "inference_id string, completion_id string, user_id string,"
    " model_id string, request_at timestamp, response_at timestamp, latency_ms bigint,"
    " input_tokens bigint, output_tokens bigint, inference_status string",
    "feedback": "feedback_id string, completion_id string, user_id string,"
    " feedback_type string, feedback_score int, created_at timestamp",
    "errors": "error_id string, user_id string, conversation_id string, message_id string,"
    " completion_id string, inference_id string, model_id string, error_source string,"
    " error_type string, error_code string, severity string, occurred_at timestamp",
    "subscriptions": "subscription_id string, user_id string, plan_id string,"
    " started_at timestamp, ended_at timestamp, subscription_status string,"
    f" actual_monthly_price {MONEY}, updated_at timestamp",
    "purchases": "purchase_id string, user_id string, subscription_id string, plan_id string,"
    f" purchase_type string, purchase_status string, subtotal_amount {MONEY},"
    f" discount_amount {MONEY}, tax_amount {MONEY}, total_amount {MONEY},"
    " purchase_created_at timestamp, updated_at timestamp",
    "payments": "payment_id string, purchase_id string, user_id string,"
    f" payment_status string, payment_method string, payment_amount {MONEY},"
    f" refund_amount {MONEY}, processed_at timestamp, refunded_at timestamp,"
    " updated_at timestamp",
}

# Entities that hold one state each, without an ingestion time.
REFERENCE_ENTITIES = ("models", "devices", "subscription_plans")

# Identifier column per entity.
ENTITY_ID = {
    "models": "model_id",
    "devices": "device_id",
    "subscription_plans": "plan_id",
    "users": "user_id",
    "user_updates": "update_id",
    "conversations": "conversation_id",
    "messages": "message_id",
    "completions": "completion_id",
    "model_inferences": "inference_id",
    "feedback": "feedback_id",
    "errors": "error_id",
    "subscriptions": "subscription_id",
    "purchases": "purchase_id",
    "payments": "payment_id",
}

# Event-time columns per event entity, first non-null wins.
EVENT_TIMES = {
    "users": ("signup_at",),
    "user_updates": ("updated_at",),
    "conversations": ("created_at",),
    "messages": ("created_at",),
    "completions": ("completed_at", "requested_at"),
    "model_inferences": ("response_at", "request_at"),
    "feedback": ("created_at",),
    "errors": ("occurred_at",),
    "subscriptions": ("updated_at", "started_at"),
    "purchases": ("updated_at", "purchase_created_at"),
    "payments": ("updated_at", "processed_at"),
}

# Closed vocabularies.
DEVICE_TYPES = ("DESKTOP", "MOBILE", "TABLET")
APP_PLATFORMS = ("WEB", "IOS", "ANDROID")
PLAN_NAMES = ("FREE", "PLUS", "PRO")
CURRENCIES = ("USD",)
ACCOUNT_STATUSES = ("ACTIVE", "SUSPENDED", "CLOSED")
UPDATE_FIELDS = ("email", "name", "country_code", "account_status")
COMPLETION_STATUSES = ("SUCCESS", "FAILED", "CANCELLED")
INFERENCE_STATUSES = ("SUCCESS", "FAILED")
FEEDBACK_TYPES = ("THUMBS_UP", "THUMBS_DOWN", "RATING")
ERROR_SOURCES = ("MODEL", "APPLICATION", "NETWORK", "DATABASE", "BILLING", "OTHER")
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
SUBSCRIPTION_STATUSES = ("ACTIVE", "CANCELLED", "EXPIRED")
PURCHASE_TYPES = ("NEW_SUBSCRIPTION", "RENEWAL", "UPGRADE")
PURCHASE_STATUSES = ("COMPLETED", "FAILED", "REFUNDED")
PAYMENT_STATUSES = ("SUCCESS", "FAILED", "REFUNDED")
PAYMENT_METHODS = ("CARD", "PAYPAL", "APPLE_PAY", "GOOGLE_PAY")
SIGNUP_SOURCES = ("ORGANIC", "PAID_SEARCH", "REFERRAL", "SOCIAL", "OTHER")

# Error code by (source, type).
ERROR_CODES = {
    ("MODEL", "MODEL_TIMEOUT"): "MDL-504",
    ("MODEL", "MODEL_RATE_LIMIT"): "MDL-429",
    ("MODEL", "MODEL_UNAVAILABLE"): "MDL-503",
    ("MODEL", "INVALID_MODEL_RESPONSE"): "MDL-502",
    ("APPLICATION", "REQUEST_PROCESSING_ERROR"): "APP-422",
    ("APPLICATION", "INTERNAL_APPLICATION_ERROR"): "APP-500",
    ("APPLICATION", "VALIDATION_ERROR"): "APP-400",
    ("NETWORK", "CONNECTION_TIMEOUT"): "NET-408",
    ("NETWORK", "CONNECTION_RESET"): "NET-104",
    ("NETWORK", "CLIENT_DISCONNECT"): "NET-499",
    ("DATABASE", "DB_CONNECTION_ERROR"): "DB-08001",
    ("DATABASE", "DB_TIMEOUT"): "DB-57014",
    ("DATABASE", "WRITE_FAILURE"): "DB-40001",
    ("BILLING", "PAYMENT_PROVIDER_ERROR"): "BILL-502",
    ("BILLING", "BILLING_SERVICE_UNAVAILABLE"): "BILL-503",
    ("OTHER", "UNKNOWN_ERROR"): "OTH-000",
}


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    MONEY: T.DecimalType(18, 2),
}


def entity_schema(entity: str, physical: bool = True) -> T.StructType:
    """Spark schema of an entity, with ``ingested_at`` and ``dt`` when physical."""
    ddl = ENTITY_DDL[entity]
    if physical:
        if entity not in REFERENCE_ENTITIES:
            ddl += ", ingested_at timestamp"
        ddl += ", dt date"
    return T.StructType([
        T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))
    ])


def entity_columns(entity: str) -> list[str]:
    """Source column names of an entity, without lineage columns."""
    return entity_schema(entity, physical=False).fieldNames()
