"""Data assertions: every function returns the violating rows, none when the rule holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import differs, may_be_in, repeated_only
from tidemark.functions.ordered import HOT_ROWS, lagged, running
from tidemark.operators.history import latest_updates
from tidemark.operators.monitoring import union_all

def any_of(*conditions: Column) -> Column:
    """True when at least one condition is true; null conditions do not count."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def not_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(columns[0]).isNotNull())
        .groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def few_not_unique(df: DataFrame, column: str) -> DataFrame:
    """``not_unique`` where few values repeat: by hash first, so only those that may repeat are grouped."""
    present = df.filter(F.col(column).isNotNull())
    return not_unique(repeated_only(present, column), [column])


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_column).alias("__parent"))
    return child.filter(F.col(column).isNotNull()).join(
        keys, F.col(column) == F.col("__parent"), "left_anti"
    )


def few_orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """``orphans`` by distinct keys: rows only meet the keys that are missing, found by a bitmap."""
    rows = child.filter(F.col(column).isNotNull())
    absent = orphans(rows.select(column).distinct(), column, parent, parent_column)
    return may_be_in(rows, absent, column).join(absent, column, "left_semi")


def not_accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows outside a closed vocabulary; nulls pass."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def declared(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, tuple[str, Sequence[str], Sequence[str]]],
    relationships: Sequence[tuple[str, str, str]],
    accepted: Mapping[tuple[str, str], Sequence[str]],
) -> DataFrame:
    """(check_name, row_key) of every row that breaks a declared test.

    ``keys``: row key, unique columns and not-null columns of each table. A repeated value is one
    row. All not-null and vocabulary tests of a table share one scan.
    """
    parts = []
    for name, (key, unique, present) in keys.items():
        rows = tables[name]
        labels = [F.when(F.col(c).isNull(), f"not_null.{name}.{c}") for c in present]
        labels += [F.when(~F.col(c).isin(*values), f"accepted.{name}.{c}")
                   for (table, c), values in accepted.items() if table == name]
        parts.append(rows.select(
            F.explode(F.array_compact(F.array(*labels))).alias("check_name"),
            F.col(key).cast("string").alias("row_key")))
        parts += [few_not_unique(rows, c).select(
            F.lit(f"unique.{name}.{c}").alias("check_name"), F.col(c).cast("string").alias("row_key"))
            for c in unique]
    for name, column, parent in relationships:
        parts.append(few_orphans(tables[name], column, tables[parent], column).select(
            F.lit(f"relationships.{name}.{column}").alias("check_name"),
            F.col(keys[name][0]).cast("string").alias("row_key")))
    return union_all(parts)


def calendar_gaps(dates: DataFrame) -> DataFrame:
    return dates.agg(
        F.min("full_date").alias("minimum_date"), F.max("full_date").alias("maximum_date"),
        F.count(F.lit(1)).alias("actual_date_count"),
    ).filter(
        F.col("actual_date_count") != F.datediff("maximum_date", "minimum_date") + 1
    )


def attribute_drift(
    rows: DataFrame, current: DataFrame, columns: Sequence[str], out: Sequence[str],
    key: str = "user_id",
) -> DataFrame:
    """Rows whose attributes differ from the current state."""
    now = current.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(now, key).filter(
        any_of(*[differs(F.col(c), F.col(f"__{c}")) for c in columns])
    ).select(*out)


def bootstrap_mismatch(history: DataFrame, snapshot: DataFrame, users: DataFrame) -> DataFrame:
    """Differences between the expected clipped history and the dimension's bootstrap rows."""
    cut, end = F.col("cut"), F.col("effective_end_at")
    boundary = snapshot.groupBy("user_id").agg(F.min("dbt_valid_from").alias("cut"))
    expected = (
        history.join(boundary, "user_id").filter(F.col("effective_start_at") < cut)
        .select("user_id", "effective_start_at",
                F.struct(F.when(end.isNull() | (end > cut), cut).otherwise(end).alias("e"),
                         "country_code", "account_status").alias("want"))
    )
    actual = users.filter(F.col("version_source") == "historical_bootstrap").select(
        "user_id", "effective_start_at",
        F.struct(end.alias("e"), "country_code", "account_status").alias("have"),
    )
    return expected.join(actual, ["user_id", "effective_start_at"], "full").filter(
        differs(F.col("want"), F.col("have"))
    ).select("user_id", "effective_start_at")


def coverage(
    source: DataFrame, rows: DataFrame, counts: Mapping[str, Column], key: str = "user_id",
    exactly_one: Sequence[str] = (),
) -> DataFrame:
    """Keys missing on either side, or whose counted rows are not exactly one."""
    summary = rows.groupBy(key).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()], F.lit(True).alias("__seen")
    )
    known = source.select(key, F.lit(True).alias("__known"))
    return known.join(summary, key, "full").filter(
        any_of(F.col("__known").isNull(), F.col("__seen").isNull(),
               *[F.col(n) != 1 for n in exactly_one])
    ).drop("__known", "__seen")


def bad_intervals(
    rows: DataFrame, key: str, start: str, end: str, tie: str, out: Sequence[str],
    current: str | None = None, order: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Empty, inverted or overlapping intervals per key, and wrong current flags.

    Intervals follow each other by start, or by the column ``order``, such as a sequence number,
    which also shows sequences that run against time.
    """
    ordered = rows.withColumns({
        "__start": F.coalesce(F.col(start), F.lit("0001-01-01 00:00:00").cast("timestamp")),
        "__tie": F.col(tie) if order is None else F.col(order),
    })
    by = ["__start", "__tie"] if order is None else ["__tie", "__start"]
    lag = running(ordered, [key], by, [lagged("__prev", F.col(end))], hot_rows=hot_rows)
    conditions = [
        F.col(start).isNull(), F.col(end) <= F.col(start), F.col(start) < F.col("__prev"),
    ]
    if current:
        conditions += [F.col(current) & F.col(end).isNotNull(), ~F.col(current) & F.col(end).isNull()]
    return lag.filter(any_of(*conditions)).select(*out)


def negative_durations(completions: DataFrame) -> DataFrame:
    return completions.filter(F.col("completion_duration_seconds") < 0).select(
        "completion_id", "completion_duration_seconds"
    )


FACT_IDS = {
    "conversation": "conversation_id", "message": "message_id", "completion": "completion_id",
    "model_inference": "inference_id", "feedback": "feedback_id", "error": "error_id",
    "subscription": "subscription_id", "purchase": "purchase_id", "payment": "payment_id",
}

# Foreign keys beyond user and date (fact, key, dimension).
FACT_KEYS = (
    ("message", "device_key", "device"), ("model_inference", "model_key", "model"),
    ("error", "model_key", "model"), ("subscription", "subscription_plan_key", "plan"),
    ("purchase", "subscription_plan_key", "plan"),
)


def unresolved_keys(facts: Mapping[str, DataFrame], dims: Mapping[str, DataFrame]) -> DataFrame:
    """Non-null fact keys without a dimension row, for every relationship."""

    def missing(key: str, dim: str, names: Sequence[str]) -> DataFrame:
        rows = union_all([
            facts[n].select(F.lit(f"{n}.{key}").alias("relationship_name"),
                            F.col(FACT_IDS[n]).alias("fact_id"), F.col(key).alias("k"))
            for n in names
        ])
        return few_orphans(rows, "k", dims[dim], key)

    parts = [missing("user_key", "user", tuple(FACT_IDS)), missing("date_key", "date", tuple(FACT_IDS))]
    for key, dim in dict.fromkeys((key, dim) for _, key, dim in FACT_KEYS):
        parts.append(missing(key, dim, [f for f, k, d in FACT_KEYS if (k, d) == (key, dim)]))
    return union_all([p.select("relationship_name", "fact_id") for p in parts])


def labelled(rows: DataFrame, label: str, row_id: str, condition: Column,
             names: tuple[str, str] = ("validation_name", "fact_id")) -> DataFrame:
    return rows.filter(F.coalesce(condition, F.lit(False))).select(
        F.lit(label).alias(names[0]), F.col(row_id).cast("string").alias(names[1])
    )


# Name of the check, flag of the defect, and the columns that must stay empty.
KEPT_DEFECTS = (
    ("inference_missing_model", "inference_id", "is_model_id_missing", ("model_id", "model_key")),
    ("completion_invalid_duration", "completion_id", "is_timestamp_order_valid", ("completion_duration_seconds",)),
    ("message_missing_text_length", "message_id", "is_message_text_missing", ("message_length_chars",)),
)


def repaired_defects(inferences: DataFrame, completions: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows where a known defect was silently filled in."""
    parts = []
    for df, (name, row_id, flag, empty) in zip((inferences, completions, messages), KEPT_DEFECTS):
        # A flag of validity marks the defect when it is false, one of a gap when it is true.
        defect = F.col(flag) == F.lit(not flag.endswith("_valid"))
        filled = F.coalesce(*[F.col(c).cast("string") for c in empty]).isNotNull()
        parts.append(labelled(df, name, row_id, defect & filled))
    return union_all(parts)


def row_count_gaps(sources: Mapping[str, DataFrame], facts: Mapping[str, DataFrame]) -> DataFrame:
    """Facts whose row count differs from their source."""
    counts = union_all([
        t[n].agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(n).alias("fact_name"), F.lit(side).alias("side"), "n")
        for side, t in (("source", sources), ("fact", facts)) for n in facts
    ])
    return counts.groupBy("fact_name").agg(
        F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_rows"),
        F.max(F.when(F.col("side") == "fact", F.col("n"))).alias("fact_rows"),
    ).filter(differs(F.col("source_rows"), F.col("fact_rows")))


def ambiguous_versions(facts: Mapping[str, DataFrame]) -> DataFrame:
    """Facts matched by more than one user version."""
    return union_all([
        labelled(facts[n], n, i, F.col("user_key_match_count") > 1, ("fact_name", "fact_id"))
        for n, i in FACT_IDS.items()
    ])


def active_user_gaps(product: DataFrame, activity: DataFrame) -> DataFrame:
    daily = activity.groupBy("date_key").agg(F.count_if("active_flag").alias("n"))
    counted = F.coalesce(F.col("n"), F.lit(0))
    return product.join(daily, "date_key", "left").filter(F.col("active_users") != counted).select(
        "date_key", F.col("active_users").alias("product_active_users"),
        counted.alias("user_daily_active_users"),
    )


def model_grain() -> Column:
    """Text key of a model-day; unresolved models share a sentinel."""
    return F.concat_ws("|", F.col("date_key").cast("string"),
                       F.coalesce("model_key", "model_id", F.lit("__UNRESOLVED__")))


def user_grain() -> Column:
    return F.concat_ws("|", F.col("date_key").cast("string"), F.col("user_id"))


def repeated_grains(ml: DataFrame, activity: DataFrame) -> DataFrame:
    parts = [
        df.groupBy(grain.alias("grain_key")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") != 1).select(F.lit(name).alias("mart_name"), "grain_key")
        for name, df, grain in (("ml", ml, model_grain()), ("user_activity", activity, user_grain()))
    ]
    return union_all(parts)


def _negative(columns: Sequence[str]) -> list[Column]:
    return [F.col(c) < 0 for c in columns]


def _not_a_rate(columns: Sequence[str]) -> list[Column]:
    return [~F.col(c).between(0, 1) for c in columns]


# Non-negative measures and rates per mart.
MART_COUNTS = {
    "product": ("active_users", "conversation_count", "message_count", "completion_count",
                "successful_completion_count", "failed_completion_count",
                "cancelled_completion_count", "feedback_count", "positive_feedback_count",
                "negative_feedback_count"),
    "finance": ("subscription_start_count", "subscription_end_count", "purchase_count",
                "payment_attempt_count", "purchases_with_payment_attempts",
                "purchases_with_multiple_payment_attempts", "retry_attempt_count"),
    "ml": ("inference_count", "successful_inference_count", "failed_inference_count",
           "average_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms",
           "total_input_tokens", "total_output_tokens", "total_tokens"),
    "user_activity": ("message_count", "conversation_count", "completion_count",
                      "successful_completion_count", "feedback_count", "positive_feedback_count",
                      "inference_count", "input_tokens", "output_tokens", "total_tokens"),
}
MART_RATES = {
    "product": ("completion_success_rate", "feedback_rate", "positive_feedback_rate"),
    "finance": ("payment_success_rate", "retry_purchase_rate"),
    "ml": ("inference_success_rate",),
    "user_activity": (),
}


def mart_range_violations(marts: Mapping[str, DataFrame]) -> DataFrame:
    special = {
        "product": [],
        "finance": [
            F.col("purchases_with_multiple_payment_attempts") > F.col("purchases_with_payment_attempts"),
            differs(F.col("net_revenue"), F.col("gross_collected_amount") - F.col("refund_amount")),
        ],
        "ml": [F.col("p50_latency_ms") > F.col("p95_latency_ms"),
               F.col("p95_latency_ms") > F.col("p99_latency_ms")],
        "user_activity": [differs(F.col("active_flag"), F.col("message_count") > 0)],
    }
    grains = {"product": F.col("date_key").cast("string"), "finance": F.col("date_key").cast("string"),
              "ml": model_grain(), "user_activity": user_grain()}
    return union_all([
        marts[m].filter(any_of(*_negative(MART_COUNTS[m]), *_not_a_rate(MART_RATES[m]), *special[m]))
        .select(F.lit(m).alias("mart_name"), grains[m].alias("grain_key"))
        for m in grains
    ])


# Mart sums that must equal fact row counts (mart, measure, fact, keyed rows only).
MART_SUMS = {
    "product_messages": ("product", "message_count", "message", False),
    "product_conversations": ("product", "conversation_count", "conversation", False),
    "product_completions": ("product", "completion_count", "completion", False),
    "product_feedback": ("product", "feedback_count", "feedback", False),
    "ml_inferences": ("ml", "inference_count", "model_inference", False),
    "finance_purchases": ("finance", "purchase_count", "purchase", False),
    "finance_payments": ("finance", "payment_attempt_count", "payment", False),
    "user_messages": ("user_activity", "message_count", "message", True),
    "user_conversations": ("user_activity", "conversation_count", "conversation", True),
    "user_completions": ("user_activity", "completion_count", "completion", True),
    "user_feedback": ("user_activity", "feedback_count", "feedback", True),
    "user_inferences": ("user_activity", "inference_count", "model_inference", True),
}


def mart_sum_gaps(marts: Mapping[str, DataFrame], facts: Mapping[str, DataFrame]) -> DataFrame:
    """Mart sums that differ from fact counts; every mart and fact is scanned once."""
    sides = []
    for mart in sorted({m for m, *_ in MART_SUMS.values()}):
        names = {n: c for n, (m, c, _, _) in MART_SUMS.items() if m == mart}
        sums = marts[mart].agg(*[F.sum(c).cast("bigint").alias(n) for n, c in names.items()])
        sides.append(sums.unpivot([], list(names), "metric_name", "v").withColumn("side", F.lit("gold")))
    for fact in sorted({f for _, _, f, _ in MART_SUMS.values()}):
        names = {n: keyed for n, (_, _, f, keyed) in MART_SUMS.items() if f == fact}
        counts = facts[fact].agg(*[
            (F.count("user_id") if keyed else F.count(F.lit(1))).alias(n) for n, keyed in names.items()
        ])
        sides.append(counts.unpivot([], list(names), "metric_name", "v").withColumn("side", F.lit("silver")))
    return union_all(sides).groupBy("metric_name").agg(
        F.max(F.when(F.col("side") == "gold", F.col("v"))).alias("gold_value"),
        F.max(F.when(F.col("side") == "silver", F.col("v"))).alias("silver_value"),
    ).filter(differs(F.col("gold_value"), F.col("silver_value")))


def check_range_violations(volume: DataFrame, quality: DataFrame, freshness: DataFrame) -> DataFrame:
    """Monitoring rows with repeated grains, impossible values or unknown states."""
    plans = (
        ("row_count", volume, F.concat_ws("|", "entity_name", F.col("activity_date").cast("string")),
         any_of(F.col("row_count") < 0, F.col("rolling_7_day_average") < 0,
                ~F.col("volume_status").isin("PASS", "WARN"))),
        ("quality_metrics", quality,
         F.concat_ws("|", "entity_name", "metric_name", F.col("metric_date").cast("string")),
         any_of(F.col("numerator") < 0, F.col("denominator") < 0,
                F.col("numerator") > F.col("denominator"), *_not_a_rate(["metric_rate"]),
                ~F.col("quality_status").isin("PASS", "WARN"))),
        ("freshness", freshness, F.col("entity_name"),
         any_of(F.col("freshness_delay_hours") < 0,
                ~F.col("freshness_status").isin("PASS", "WARN", "FAIL"))),
    )
    parts = []
    for name, df, grain, bad in plans:
        # One row per violating input row, as repeated grains report every copy.
        per_grain = df.select(grain.alias("grain_key"), bad.alias("bad")).groupBy("grain_key").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
        rows = F.when(F.col("n") != 1, F.col("n")).otherwise(F.col("n_bad"))
        parts.append(
            per_grain.withColumn("copies", rows).filter(F.col("copies") > 0)
            .select(F.lit(name).alias("model_name"), "grain_key",
                    F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .drop("copy")
        )
    return union_all(parts)


def failed_reconciliations(recon: DataFrame) -> DataFrame:
    return recon.filter(any_of(F.col("difference") != 0, F.col("status") != "PASS"))


def overwritten_attributes(history: DataFrame, users: DataFrame, updates: DataFrame) -> DataFrame:
    """History rows whose Type-1 attributes are not the newest values."""
    last = latest_updates(updates, ("email", "name"))

    def newest(f: str) -> Column:
        s = F.col(f"last_{f}")
        return F.when(s.isNotNull(), s["value"]).otherwise(F.col(f)).alias(f"expected_{f}")

    expected = users.join(last, "user_id", "left").select("user_id", newest("email"), newest("name"))
    return history.join(expected, "user_id").filter(
        any_of(differs(F.col("email"), F.col("expected_email")),
               differs(F.col("name"), F.col("expected_name")))
    ).select("user_id", "version_sequence", "email", "expected_email", "name", "expected_name")


def version_count_gaps(history: DataFrame, users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users whose version count is not one plus their effective changes."""
    effective = F.col("field_name").isin("country_code", "account_status") & differs(
        F.col("old_value"), F.col("new_value"))
    changes = updates.groupBy("user_id").agg(F.count_if(effective).alias("changes"))
    actual = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("actual_version_count"))
    return (
        users.select("user_id").join(changes, "user_id", "left").join(actual, "user_id", "left")
        .select("user_id", (F.coalesce("changes", F.lit(0)) + 1).alias("expected_version_count"),
                "actual_version_count")
        .filter(differs(F.col("expected_version_count"), F.col("actual_version_count")))
    )
