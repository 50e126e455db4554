"""Integrity, causality and distribution validators over full tables.

Row rules are SQL predicates by label; ``violations`` turns every broken rule of a row
into one labelled result row in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import differs, ratio
from tidemark.functions.ordered import HOT_ROWS, lagged, position, running
from tidemark.operators.monitoring import union_all


def violations(
    df: DataFrame, row_id: str, rules: Mapping[str, str | Column], keep: Sequence[str] = ()
) -> DataFrame:
    """(violation, row_id) for every rule that is true on a row; null counts as not broken."""
    labels = [
        F.when(F.expr(c) if isinstance(c, str) else c, F.lit(label)) for label, c in rules.items()
    ]
    return df.select(
        F.explode(F.array_compact(F.array(*labels))).alias("violation"),
        F.col(row_id).cast("string").alias("row_id"),
        *keep,
    )


def parent(df: DataFrame, key: str, prefix: str, *columns: str) -> DataFrame:
    """Parent columns under a prefix, with ``<prefix>_found``; the key keeps its name."""
    return df.select(
        key, *[F.col(c).alias(f"{prefix}_{c}") for c in columns], F.lit(True).alias(f"{prefix}_found")
    )


def repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def ingestion(rows: DataFrame, entity: str, horizon: str) -> DataFrame:
    """Event not after ingestion, ingestion within the horizon, partition right, unique id."""
    key = schemas.ENTITY_ID[entity]
    event = F.coalesce(*[F.col(c) for c in schemas.EVENT_TIMES[entity]])
    broken = violations(
        rows.withColumn("event_at", event), key,
        {
            "ingested_before_event": "ingested_at < event_at",
            "beyond_horizon": f"ingested_at > timestamp '{horizon}'",
            "partition_mismatch": "dt <> cast(ingested_at as date)",
            "missing_time": "ingested_at is null or event_at is null",
        },
    )
    copies = repeated(rows, [key]).select(F.lit("duplicate_id").alias("violation"),
                                          F.col(key).alias("row_id"))
    dates = rows.agg(F.count_distinct(F.to_date("ingested_at")).alias("n")).filter(
        F.col("n") < 2
    ).select(F.lit("single_date").alias("violation"), F.lit(entity).alias("row_id"))
    return union_all([broken, copies, dates])


# Message rules.
MESSAGE_RULES = {
    "unknown_conversation": "c_found is null",
    "user_mismatch": "user_id <> c_user_id",
    "unknown_device": "device_id is not null and d_found is null",
    "blank_text": "message_text is null or trim(message_text) = ''",
    "before_conversation": "created_at < c_created_at",
    "after_close": "created_at >= u_closed_at",
}


def message_integrity(
    messages: DataFrame, conversations: DataFrame, devices: DataFrame, closed: DataFrame
) -> DataFrame:
    joined = (
        messages.join(parent(conversations, "conversation_id", "c", "user_id", "created_at"),
                      "conversation_id", "left")
        .join(parent(devices, "device_id", "d"), "device_id", "left")
        .join(parent(closed, "user_id", "u", "closed_at"), "user_id", "left")
    )
    return violations(joined, "message_id", MESSAGE_RULES)


def message_sequence(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbering contiguous from one and strictly increasing times per conversation."""
    ordered = running(
        messages.select("conversation_id", "message_id",
                        F.coalesce("sequence_number", F.lit(0)).alias("seq"), "created_at"),
        ["conversation_id"], ["seq", "message_id"],
        [position("expected"), lagged("previous_at", F.col("created_at"))],
        hot_rows=hot_rows, segment_of=F.floor(F.col("seq") / 10_000),
    )
    return violations(ordered, "message_id", {
        "non_contiguous": "seq <> expected",
        "not_increasing": "created_at <= previous_at",
    })


def multi_day_conversations(messages: DataFrame) -> DataFrame:
    days = messages.groupBy("conversation_id").agg(
        F.count_distinct(F.to_date("created_at")).alias("days")
    )
    return days.agg(F.count(F.lit(1)).alias("conversations"),
                    F.count_if(F.col("days") > 1).alias("multi_day_conversations"))


def activity_skew(users: DataFrame, conversations: DataFrame) -> DataFrame:
    """Long-tail measures of conversations per user and whether they reach their bounds.

    The top five percent are found from the histogram of counts, so no global sort of
    users is needed: the window runs over distinct counts.
    """
    per_user = conversations.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    histogram = per_user.groupBy("n").agg(F.count(F.lit(1)).alias("users_with"))
    totals = histogram.agg(
        F.sum("users_with").alias("active_users"), F.max("n").alias("max_conversations"),
        F.sum(F.col("n") * F.col("users_with")).alias("conversations"),
    ).join(F.broadcast(users.agg(F.count(F.lit(1)).alias("users"))), F.lit(True)).withColumn(
        "top_users", F.greatest(F.lit(1), F.floor(F.col("users") * 0.05))
    )
    above = F.sum("users_with").over(
        Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = histogram.withColumn("above", F.coalesce(above, F.lit(0))).join(F.broadcast(totals), F.lit(True))
    taken = F.greatest(F.lit(0), F.least(F.col("users_with"), F.col("top_users") - F.col("above")))
    top = ranked.agg(F.sum(taken * F.col("n")).alias("top_conversations"))
    zero = F.col("users") - F.col("active_users")
    share = ratio(F.col("top_conversations"), F.col("conversations"))
    return totals.join(F.broadcast(top), F.lit(True)).select(
        "users", zero.alias("zero_users"), "max_conversations", share.alias("top_share"),
        (ratio(zero, F.col("users")) >= 0.15).alias("enough_inactive"),
        (F.col("max_conversations") >= 31).alias("enough_heavy"),
        (share >= 0.20).alias("enough_concentration"),
    )


def completion_links(completions: DataFrame, messages: DataFrame) -> DataFrame:
    joined = completions.join(
        parent(messages, "message_id", "m", "conversation_id", "user_id", "created_at"),
        "message_id", "left")
    return violations(joined, "completion_id", {
        "unknown_message": "m_found is null",
        "conversation_mismatch": "conversation_id <> m_conversation_id",
        "user_mismatch": "user_id <> m_user_id",
        "requested_before_message": "requested_at < m_created_at",
    })


def inference_links(inferences: DataFrame, completions: DataFrame) -> DataFrame:
    joined = inferences.join(
        parent(completions, "completion_id", "c", "user_id", "completion_status"),
        "completion_id", "left")
    return violations(joined, "inference_id", {
        "unknown_completion": "c_found is null",
        "user_mismatch": "user_id <> c_user_id",
        "status_mismatch": "(c_completion_status = 'SUCCESS' and inference_status <> 'SUCCESS')"
                           " or (c_completion_status <> 'SUCCESS' and inference_status <> 'FAILED')",
    })


def broken_chains(messages: DataFrame, completions: DataFrame, inferences: DataFrame) -> DataFrame:
    """Successful chains whose five times are out of order."""
    chain = (
        completions.filter(F.col("completion_status") == "SUCCESS")
        .select("message_id", "completion_id", "requested_at", "completed_at")
        .join(messages.select("message_id", "created_at"), "message_id")
        .join(inferences.select("completion_id", "inference_id", "request_at", "response_at"),
              "completion_id")
    )
    in_order = (
        (F.col("created_at") <= F.col("requested_at")) & (F.col("requested_at") <= F.col("request_at"))
        & (F.col("request_at") < F.col("response_at")) & (F.col("response_at") <= F.col("completed_at"))
    )
    return chain.filter(~in_order).select("completion_id", "inference_id")


def inference_rules(inferences: DataFrame, models: DataFrame) -> DataFrame:
    joined = inferences.join(
        parent(models, "model_id", "m", "release_date"), "model_id", "left")
    gap = (F.unix_micros("response_at") - F.unix_micros("request_at")) / 1000 - F.col("latency_ms")
    success, failed = (F.col("inference_status") == s for s in ("SUCCESS", "FAILED"))
    return violations(joined, "inference_id", {
        "unknown_model": "model_id is null or m_found is null",
        "before_release": "m_release_date > cast(request_at as date)",
        "input_tokens": "coalesce(input_tokens, 0) <= 0",
        "success_metrics": success & (
            F.col("response_at").isNull() | (F.col("response_at") <= F.col("request_at"))
            | (F.coalesce("latency_ms", F.lit(0)) <= 0) | (F.coalesce("output_tokens", F.lit(0)) <= 0)),
        "latency_mismatch": success & (F.abs(F.bround(gap)) > 1),
        "failure_metrics": failed & (
            F.col("response_at").isNotNull() | F.col("latency_ms").isNotNull()
            | F.col("output_tokens").isNotNull()),
    })


def ratio_bands(
    measured: DataFrame, bands: Sequence[tuple[str, str, float, float]]
) -> DataFrame:
    """Shares of each group value against declared bands.

    ``measured`` has metric, value, n and total (null: all of the metric); bands are (metric, value, low,
    high). A value that never occurs has share zero.
    """
    spark = measured.sparkSession
    limits = F.broadcast(spark.createDataFrame(bands, "metric string, value string, low double, high double"))
    totals = measured.groupBy("metric").agg(F.coalesce(F.max("total"), F.sum("n")).alias("total"))
    measured = measured.drop("total")
    share = F.coalesce(ratio(F.col("n"), F.col("total")), F.lit(0.0))
    return (
        totals.join(limits, "metric").join(measured, ["metric", "value"], "left")
        .select("metric", "value", F.coalesce("n", F.lit(0)).alias("n"), "total",
                share.alias("share"), "low", "high",
                share.between(F.col("low"), F.col("high")).alias("within"))
    )


def feedback_integrity(feedback: DataFrame, completions: DataFrame) -> DataFrame:
    joined = feedback.join(
        parent(completions, "completion_id", "c", "user_id", "completion_status", "completed_at"),
        "completion_id", "left")
    return violations(joined, "feedback_id", {
        "unknown_completion": "c_found is null",
        "completion_not_successful": "c_completion_status <> 'SUCCESS'",
        "user_mismatch": "user_id <> c_user_id",
        "before_completion": "created_at < c_completed_at",
        "illegal_score": "(feedback_type = 'THUMBS_UP' and feedback_score <> 1)"
                         " or (feedback_type = 'THUMBS_DOWN' and feedback_score <> -1)"
                         " or (feedback_type = 'RATING' and feedback_score not between 1 and 5)",
    })


# Nullable parents of an error.
ERROR_PARENTS = ("user", "conversation", "message", "completion", "inference")


def error_orphans(errors: DataFrame, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Errors whose given parent id does not exist, per parent."""
    joined = errors
    for name in ERROR_PARENTS:
        key = f"{name}_id"
        joined = joined.join(parents[name].select(key, F.lit(True).alias(f"{name}_found")), key, "left")
    return violations(joined, "error_id", {
        f"unknown_{n}": f"{n}_id is not null and {n}_found is null" for n in ERROR_PARENTS
    })


# Per parent of an error, its prefix, the columns in which both must agree, and
# whether the error has to state them.
LINEAGE = (
    ("message", "m", ("user_id", "conversation_id"), False),
    ("completion", "c", ("user_id", "message_id", "conversation_id"), False),
    ("inference", "i", ("completion_id", "user_id", "model_id"), True),
)


def error_lineage(
    errors: DataFrame, messages: DataFrame, completions: DataFrame, inferences: DataFrame
) -> DataFrame:
    """Errors whose parents disagree with each other."""
    tables, joined, rules = {"m": messages, "c": completions, "i": inferences}, errors, {}
    for name, prefix, columns, stated in LINEAGE:
        joined = joined.join(parent(tables[prefix], f"{name}_id", prefix, *columns), f"{name}_id", "left")
        apart = [F.col(c) != F.col(f"{prefix}_{c}") for c in columns]
        if stated:
            apart += [F.col(c).isNull() for c in columns]
        rules[f"{name}_lineage"] = F.col(f"{name}_id").isNotNull() & any_true(apart)
    return violations(joined, "error_id", rules)


# References that an error of these sources must not hold.
FOREIGN = {
    "application_context": (("APPLICATION", "DATABASE"), ("completion", "inference", "model")),
    "billing_context": (("BILLING",), ("conversation", "message", "completion", "inference", "model")),
}
# References of a model error that only make sense with an inference.
REQUEST_CHAIN = ("user", "conversation", "message", "completion")


def any_true(conditions: Sequence[Column]) -> Column:
    """True if one of the conditions is; null counts as false."""
    return F.exists(F.array(*conditions), lambda c: F.coalesce(c, F.lit(False)))


def holds(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(f"{n}_id") for n in names]).isNotNull()


def error_context(errors: DataFrame) -> DataFrame:
    """Context rules per source and the code table; the table has one row per known type."""
    spark = errors.sparkSession
    codes = F.broadcast(spark.createDataFrame(
        [(s, t, c) for (s, t), c in schemas.ERROR_CODES.items()],
        "error_source string, error_type string, expected_code string"))
    joined = errors.join(codes, ["error_source", "error_type"], "left")
    return violations(joined, "error_id", {
        **{label: F.col("error_source").isin(*sources) & holds(names)
           for label, (sources, names) in FOREIGN.items()},
        "model_context": (F.col("error_source") == "MODEL") & ~(
            holds(["model"]) & (holds(["inference"]) | ~holds(REQUEST_CHAIN))),
        "unknown_type": "expected_code is null",
        "wrong_code": "error_code <> expected_code",
    })


# Legal account status transitions.
STATUS_TRANSITIONS = (("ACTIVE", "SUSPENDED"), ("SUSPENDED", "ACTIVE"), ("ACTIVE", "CLOSED"),
                      ("SUSPENDED", "CLOSED"))


def update_chain(
    updates: DataFrame, users: DataFrame, hot_rows: int = HOT_ROWS, cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Each update continues the prior state, at a strictly later time, by a legal move.

    ``cut`` may write the rows between the two ordered passes, each of which reads its input several times.
    """
    base = users.select(
        "user_id", "signup_at",
        F.create_map(*[x for f in schemas.UPDATE_FIELDS for x in (F.lit(f), F.col(f))]).alias("base"),
        F.lit(True).alias("u_found"),
    )
    chained = cut(running(updates, ["user_id"], ["updated_at", "update_id"],
                          [lagged("previous_at", F.col("updated_at"))], hot_rows=hot_rows))
    chained = running(chained, ["user_id", "field_name"], ["updated_at", "update_id"],
                      [lagged("prior", F.struct("new_value"))], hot_rows=hot_rows)
    joined = chained.join(base, "user_id", "left")
    state = F.when(F.col("prior").isNotNull(), F.col("prior")["new_value"]).otherwise(
        F.try_element_at("base", F.col("field_name")))
    legal = F.lit(False)
    for old, new in STATUS_TRANSITIONS:
        legal = legal | (F.col("old_value").eqNullSafe(old) & F.col("new_value").eqNullSafe(new))
    return violations(joined, "update_id", {
        "unknown_user": "u_found is null",
        "unknown_field": ~F.col("field_name").isin(*schemas.UPDATE_FIELDS),
        "unchanged": F.col("old_value").eqNullSafe(F.col("new_value")),
        "not_after_previous": "updated_at <= coalesce(previous_at, signup_at)",
        "broken_chain": F.col("u_found") & differs(F.col("old_value"), state),
        "illegal_transition": (F.col("field_name") == "account_status") & ~legal,
    })


def user_rules(users: DataFrame, start: str, end: str) -> DataFrame:
    """Row rules of signups and emails held by several users."""
    rows = violations(users, "user_id", {
        "email_format": ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "email_missing": "email is null",
        "country_format": ~F.col("country_code").rlike("^[A-Z]{2}$"),
        "status": ~F.coalesce("account_status", F.lit("")).isin(*schemas.ACCOUNT_STATUSES),
        "window": f"signup_at < timestamp '{start}' or signup_at >= timestamp '{end}'",
        "source_missing": "signup_source is null",
    })
    shared = repeated(users.filter(F.col("email").isNotNull()), ["email"]).select("email")
    dup = users.join(shared, "email", "left_semi").select(
        F.lit("email_shared").alias("violation"), F.col("user_id").alias("row_id"))
    return rows.unionByName(dup)


def subscription_timeline(
    subscriptions: DataFrame, users: DataFrame, plans: DataFrame, closed: DataFrame, horizon: str, cutover: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Row rules, start on the free plan at signup, one active period, no overlap, no user without any.

    Paid plans have versions: ids end with v1 for what starts before ``cutover``, with v2 from then on.
    Nothing may be updated or end after ``horizon``.
    """
    ordered = running(
        subscriptions.withColumn("begins", F.coalesce("started_at", F.lit("0001-01-01").cast("timestamp"))),
        ["user_id"], ["begins", "subscription_id"],
        [position("n"), lagged("previous", F.struct("ended_at"))], hot_rows=hot_rows,
    )
    joined = (
        ordered.join(parent(users, "user_id", "u", "signup_at"), "user_id", "left")
        .join(parent(plans, "plan_id", "p", "plan_name", "monthly_price"), "plan_id", "left")
        .join(parent(closed, "user_id", "k", "closed_at"), "user_id", "left")
    )
    rows = violations(joined, "subscription_id", {
        "unknown_parent": "u_found is null or p_found is null",
        "timing": "started_at < u_signup_at or updated_at < started_at or ended_at < started_at",
        "status_end": "(subscription_status = 'ACTIVE') <> (ended_at is null)",
        "price": "actual_monthly_price < 0 or actual_monthly_price > p_monthly_price"
                 " or (p_plan_name = 'FREE') <> (actual_monthly_price = 0)",
        "first_not_free": "n = 1 and (p_plan_name <> 'FREE' or started_at <> u_signup_at)",
        "overlap": "n > 1 and (previous.ended_at is null or previous.ended_at > started_at)",
        "after_close": "started_at > k_closed_at or updated_at > k_closed_at or ended_at > k_closed_at",
        "plan_cutover": f"p_plan_name <> 'FREE' and not endswith(plan_id, if(started_at < timestamp '{cutover}', 'v1', 'v2'))",
        "beyond_horizon": f"updated_at > timestamp '{horizon}' or ended_at > timestamp '{horizon}'",
    })
    without = users.select("user_id").join(subscriptions.select("user_id"), "user_id", "left_anti").select(
        F.lit("no_lifecycle").alias("violation"), F.col("user_id").alias("row_id"))
    active = (
        subscriptions.groupBy("user_id")
        .agg(F.count_if(F.col("subscription_status") == "ACTIVE").alias("n_active"))
        .filter(F.col("n_active") > 1)
        .select(F.lit("several_active").alias("violation"), F.col("user_id").alias("row_id"))
    )
    return rows.unionByName(active).unionByName(without)


def purchase_rules(
    purchases: DataFrame, subscriptions: DataFrame, plans: DataFrame, horizon: str
) -> DataFrame:
    joined = purchases.join(
        parent(subscriptions, "subscription_id", "s", "user_id", "plan_id", "started_at", "ended_at"),
        "subscription_id", "left",
    ).join(
        plans.select(F.col("plan_id").alias("s_plan_id"), F.col("plan_name").alias("p_plan_name")),
        "s_plan_id", "left")
    return violations(joined, "purchase_id", {
        "unknown_subscription": "s_found is null",
        "lineage": "user_id <> s_user_id or plan_id <> s_plan_id",
        "free_plan": "p_plan_name = 'FREE'",
        "type": ~F.coalesce("purchase_type", F.lit("")).isin(*schemas.PURCHASE_TYPES),
        "outside_period": "purchase_created_at < s_started_at"
                          f" or purchase_created_at >= coalesce(s_ended_at, timestamp '{horizon}')",
        "update_order": "updated_at < purchase_created_at",
        "money_sign": "subtotal_amount < 0 or discount_amount < 0 or tax_amount < 0"
                      " or total_amount < 0 or discount_amount > subtotal_amount",
        "money_identity": "total_amount <> subtotal_amount - discount_amount + tax_amount",
    })


def payment_rules(payments: DataFrame, purchases: DataFrame) -> DataFrame:
    joined = payments.join(
        parent(purchases, "purchase_id", "b", "user_id", "total_amount", "purchase_created_at"),
        "purchase_id", "left")
    return violations(joined, "payment_id", {
        "unknown_purchase": "b_found is null",
        "user_mismatch": "user_id <> b_user_id",
        "method": "payment_method is null",
        "amount": "payment_amount <> b_total_amount",
        "before_purchase": "processed_at < b_purchase_created_at",
        "update_order": "updated_at < processed_at",
        "refund": "payment_status = 'REFUNDED' and (refunded_at is null or refunded_at <= processed_at"
                  " or updated_at < refunded_at or refund_amount <= 0 or refund_amount > payment_amount)",
        "unexpected_refund": "payment_status <> 'REFUNDED' and (refunded_at is not null"
                             " or refund_amount <> 0)",
    })


def purchase_status_gaps(
    purchases: DataFrame, payments: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Purchases whose stored state is not the one their attempts imply, or without attempts."""
    status = F.col("payment_status")
    per = payments.groupBy("purchase_id").agg(
        F.bool_or(status == "REFUNDED").alias("refunded"),
        F.bool_or(status.isin("SUCCESS", "REFUNDED")).alias("paid"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_distinct("processed_at").alias("times"),
    )
    implied = F.when(F.col("attempts").isNull(), "NO_ATTEMPT").when(
        F.col("refunded"), "REFUNDED").when(F.col("paid"), "COMPLETED").otherwise("FAILED")
    # Sorted attempts are strictly ordered exactly when their times are all different.
    tied = F.coalesce(F.col("times") < F.col("attempts"), F.lit(False))
    return (
        purchases.select("purchase_id", "purchase_status").join(per, "purchase_id", "full")
        .select("purchase_id", "purchase_status", implied.alias("implied_status"),
                tied.alias("unordered_attempts"))
        .filter(differs(F.col("purchase_status"), F.col("implied_status")) | F.col("unordered_attempts"))
    )


def catalogue_rules(models: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Repeated catalogue entries and release dates that run against version order."""
    parts = F.transform(F.split("model_version", r"\."), lambda p: p.try_cast("int"))
    ordered = running(
        models.withColumn("parts", parts).withColumn(
            "version", F.transform("parts", lambda p: F.coalesce(p, F.lit(-1)))),
        ["model_name", "provider"], ["version", "model_id"], [lagged("previous_release", F.col("release_date"))],
        hot_rows=hot_rows, segment_of=F.try_element_at("version", F.lit(1)),
    )
    rows = violations(ordered, "model_id", {
        "release_order": "release_date < previous_release",
        "version_not_numeric": F.exists("parts", lambda v: v.isNull()),
        "release_missing": "release_date is null",
        "flag_missing": "active_flag is null",
    })
    entry = ["model_name", "model_version", "provider"]
    dup = models.join(repeated(models, entry).drop("n_rows"), entry, "left_semi").select(
        F.lit("repeated_entry").alias("violation"), F.col("model_id").alias("row_id"))
    same_id = repeated(models, ["model_id"]).select(
        F.lit("repeated_id").alias("violation"), F.col("model_id").alias("row_id"))
    return rows.unionByName(dup).unionByName(same_id)


def model_adoption(
    inferences: DataFrame, models: DataFrame, horizon: str, recent_days: int = 90,
    edge_days: int = 60,
) -> DataFrame:
    """Share of active models in recent traffic; newest model's early against latest share."""
    end = F.lit(horizon).cast("timestamp")
    newest = models.agg(
        F.max_by("model_id", F.struct("release_date", "model_id")).alias("newest_model"),
        F.max("release_date").alias("released"),
    )
    flagged = inferences.select("model_id", "request_at").join(
        models.select("model_id", F.col("active_flag").alias("active")), "model_id", "left"
    ).join(F.broadcast(newest), F.lit(True))
    at, released = F.col("request_at"), F.col("released").cast("timestamp")
    recent = at >= end - F.make_interval(days=F.lit(recent_days))
    early = (at >= released) & (at < released + F.make_interval(days=F.lit(edge_days)))
    latest = at >= end - F.make_interval(days=F.lit(edge_days))
    is_new = F.col("model_id") == F.col("newest_model")
    sums = flagged.agg(
        F.max("newest_model").alias("newest_model"),
        F.count_if(recent).alias("recent_total"),
        F.count_if(recent & F.coalesce("active", F.lit(False))).alias("recent_active"),
        F.count_if(early).alias("early_total"), F.count_if(early & is_new).alias("early_newest"),
        F.count_if(latest).alias("latest_total"), F.count_if(latest & is_new).alias("latest_newest"),
    )
    early_share = F.coalesce(ratio(F.col("early_newest"), F.col("early_total")), F.lit(0.0))
    latest_share = F.coalesce(ratio(F.col("latest_newest"), F.col("latest_total")), F.lit(0.0))
    return sums.select(
        "*", (ratio(F.col("recent_active"), F.col("recent_total")) >= 0.75).alias("active_dominate"),
        (latest_share > early_share * 1.5).alias("adoption_grows"),
    )


def day_violations(tables: Mapping[str, DataFrame], day: str) -> DataFrame:
    """Cross-entity rules for the rows that landed on one day; counts per label."""
    landed = {
        n: t.filter(F.col("dt") == F.lit(day).cast("date")) for n, t in tables.items() if "dt" in t.columns
    }
    label = lambda df, key, rules: violations(df, key, rules)
    users = parent(tables["users"], "user_id", "u")
    parts = [
        label(landed["user_updates"].join(users, "user_id", "left"), "update_id", {
            "user_updates.user_id": "u_found is null",
            "user_updates.updated_at": f"cast(updated_at as date) <> date '{day}'"}),
        label(landed["user_updates"].filter("field_name = 'account_status' and new_value = 'CLOSED'").join(
            landed["messages"].groupBy("user_id").agg(F.max("created_at").alias("last_message_at")), "user_id"), "update_id", {
            "user_updates.closed_before_activity_end": "last_message_at >= updated_at"}),
        label(landed["feedback"].join(users, "user_id", "left").join(
            parent(landed["completions"], "completion_id", "c").dropDuplicates(["completion_id"]), "completion_id", "left"), "feedback_id", {
            "feedback.reference": "u_found is null or c_found is null"}),
        label(landed["subscriptions"].join(users, "user_id", "left").join(
            parent(tables["plans"], "plan_id", "p"), "plan_id", "left"), "subscription_id", {
            "subscriptions.reference": "u_found is null or p_found is null"}),
        label(landed["purchases"].join(
            parent(tables["known_subscriptions"], "subscription_id", "s", "user_id"), "subscription_id", "left"), "purchase_id", {
            "purchases.reference": "s_found is null or not (user_id <=> s_user_id)"}),
        label(landed["messages"].join(users, "user_id", "left")
              .join(parent(tables["conversations"], "conversation_id", "c", "user_id", "created_at")
                    .dropDuplicates(["conversation_id"]), "conversation_id", "left"), "message_id", {
            "messages.reference": "u_found is null or c_found is null or c_user_id <> user_id",
            "messages.causality": "u_found and c_user_id = user_id and created_at < c_created_at"}),
        label(landed["completions"].join(
            parent(landed["messages"], "message_id", "m", "user_id", "created_at")
            .dropDuplicates(["message_id"]), "message_id", "left"), "completion_id", {
            "completions.reference": "m_found is null or not (user_id <=> m_user_id)",
            "completions.causality": "user_id <=> m_user_id and not (m_created_at <= requested_at"
                                     " and requested_at <= completed_at)"}),
        label(landed["model_inferences"].join(
            parent(landed["completions"], "completion_id", "c").dropDuplicates(["completion_id"]),
            "completion_id", "left").join(
            parent(tables["models"], "model_id", "m", "release_date"), "model_id", "left"),
            "inference_id", {
            "model_inferences.reference": "c_found is null or m_found is null"
                                          " or m_release_date > cast(request_at as date)",
            "model_inferences.causality": "response_at < request_at"}),
        label(landed["payments"].join(
            parent(landed["purchases"], "purchase_id", "b", "user_id", "purchase_created_at")
            .dropDuplicates(["purchase_id"]), "purchase_id", "left"), "payment_id", {
            "payments.reference": "b_found is null or b_user_id <> user_id",
            "payments.causality": "b_user_id = user_id and processed_at < b_purchase_created_at"}),
    ]
    for n, t in landed.items():
        parts.append(repeated(t, [schemas.ENTITY_ID[n]]).select(
            F.lit(f"{n}.duplicate_new_id").alias("violation"),
            F.col(schemas.ENTITY_ID[n]).alias("row_id")))
        parts.append(violations(t, schemas.ENTITY_ID[n], {
            f"{n}.partition": f"not coalesce(cast(ingested_at as date) = date '{day}', false)"}))
    return union_all(parts).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


# Injected null columns per entity.
DEFECT_COLUMNS = {
    "users": "email", "messages": "message_text", "completions": "user_id",
    "model_inferences": "model_id", "feedback": "feedback_type", "purchases": "purchase_type",
    "payments": "payment_method",
}


def defect_counts(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """Nulls, repeated ids and time faults in the physical tables."""
    parts = []
    for entity, column in DEFECT_COLUMNS.items():
        key = schemas.ENTITY_ID[entity]
        row = bronze[entity].agg(
            F.count_if(F.col(column).isNull()).alias("missing"),
            (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate"),
        )
        parts.append(row.unpivot([], ["missing", "duplicate"], "kind", "n").select(
            F.lit(entity).alias("entity_name"), "kind", "n"))
    def late(entity: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count_distinct(schemas.ENTITY_ID[entity]).alias("n")).select(
            F.lit(entity).alias("entity_name"), F.lit("temporal").alias("kind"), "n")

    starts = bronze["conversations"].groupBy("conversation_id").agg(F.max("created_at").alias("p"))
    bought = bronze["purchases"].groupBy("purchase_id").agg(F.max("purchase_created_at").alias("p"))
    parts += [
        late("messages", bronze["messages"].join(starts, "conversation_id")
             .filter(F.col("created_at") < F.col("p"))),
        late("completions", bronze["completions"].filter(F.col("completed_at") < F.col("requested_at"))),
        late("model_inferences", bronze["model_inferences"].filter(F.col("response_at") < F.col("request_at"))),
        late("payments", bronze["payments"].join(bought, "purchase_id")
             .filter(F.col("processed_at") < F.col("p"))),
    ]
    return union_all(parts)
