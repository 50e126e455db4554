"""Distribution summaries, field profiles and profile consistency checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import ratio
from tidemark.functions.ordered import HOT_ROWS, lagged, running, running_sum
from tidemark.operators.marts import POSITIVE_FEEDBACK
from tidemark.operators.monitoring import union_all
from tidemark.sources.partitions import file_accounting

# Domains.
DOMAINS = {
    "REFERENCE": ("models", "devices", "subscription_plans"),
    "USER": ("users", "user_updates"),
    "PRODUCT": ("conversations", "messages"),
    "AI_ML": ("completions", "model_inferences", "feedback", "errors"),
    "FINANCE": ("subscriptions", "purchases", "payments"),
}


def ranked_values(
    df: DataFrame, value: Column, ranks: Mapping[str, Column], width: int = 1_000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Values at given ranks of the ascending order; ``n`` may be used in the rank.

    Rows are reduced to counts per distinct value first; the cumulative count then runs
    over value segments of ``width``.
    """
    counts = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"),
                       F.max("v").alias("maximum"))
    summed = running(
        counts.withColumn("all", F.lit("")), ["all"], ["v"], [running_sum("upto", F.col("c"))],
        hot_rows=hot_rows, segment_of=F.floor(F.col("v") / width))
    placed = summed.join(F.broadcast(total), F.lit(True))
    return placed.agg(
        F.max("n").alias("n"), F.max("total").alias("total"), F.max("maximum").alias("maximum"),
        *[F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(name) for name, rank in ranks.items()],
    )


def nearest_rank(p: float) -> Column:
    """Rank ceil(n * p), at least one."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p)))


def floor_rank(p: float) -> Column:
    """Rank floor(n * p), at least one."""
    return F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p)))


def metric_summary(df: DataFrame, value: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, median, p95, p99 and maximum of values rounded half to even, nearest rank."""
    rounded = F.bround(value.cast("double")).cast("bigint")
    s = ranked_values(df, rounded, {"median": nearest_rank(0.5), "p95": nearest_rank(0.95),
                                    "p99": nearest_rank(0.99)}, hot_rows=hot_rows)
    return s.select(
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(ratio(F.col("total"), F.col("n")), F.lit(0.0)).alias("average"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("median", "p95", "p99", "maximum")],
    )


def delay_percentiles(df: DataFrame, seconds: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Percentiles by the floor rule."""
    return ranked_values(df, seconds, {"median": floor_rank(0.5), "p95": floor_rank(0.95),
                                       "p99": floor_rank(0.99)}, hot_rows=hot_rows).drop("total")


def correlation(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Pearson correlation per named pair, zero when undefined."""
    def pearson(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        # Merging partial means leaves a constant a spread of rounding errors.
        varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
        spread = F.stddev_pop(xs) * F.stddev_pop(ys)
        return F.coalesce(F.when(varies, F.try_divide(F.covar_pop(x, y), spread)), F.lit(0.0))

    row = df.agg(*[pearson(x, y).alias(n) for n, (x, y) in pairs.items()])
    return row.unpivot([], list(pairs), "pair", "correlation")


def late_arrivals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Arrival-delay categories and partition span per entity."""
    parts = []
    for entity, rows in tables.items():
        event = F.coalesce(*[F.col(c) for c in schemas.EVENT_TIMES[entity]])
        delay = F.unix_micros("ingested_at") - F.unix_micros("event_at")
        days = F.datediff("ingested_at", "event_at")
        parts.append(rows.withColumn("event_at", event).agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(delay < 60_000_000).alias("same_minute"),
            F.count_if(days == 0).alias("same_day"),
            F.count_if(days == 1).alias("next_day"),
            F.count_if(delay > 86_400_000_000).alias("over_one_day"),
            F.count_distinct(F.to_date("ingested_at")).alias("partitions"),
            F.min(F.to_date("ingested_at")).alias("earliest"),
            F.max(F.to_date("ingested_at")).alias("latest"),
        ).select(F.lit(entity).alias("entity_name"), "*"))
    return union_all(parts)


def user_buckets(users: DataFrame, conversations: DataFrame) -> DataFrame:
    """Users by number of conversations, silent users included."""
    per = conversations.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    bucket = (
        F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 10, "3-10").when(n <= 30, "11-30")
        .when(n <= 100, "31-100").otherwise("100+")
    )
    return users.select("user_id").join(per, "user_id", "left").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("users"))


def conversation_stats(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Messages per conversation: mean, percentiles by the floor rule, multi-day count."""
    per = messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_distinct(F.to_date("created_at")).alias("days"))
    s = ranked_values(per, F.col("n_messages"), {"p95": floor_rank(0.95), "p99": floor_rank(0.99)},
                      hot_rows=hot_rows)
    multi = per.agg(F.count_if(F.col("days") > 1).alias("multi_day_conversations"),
                    F.percentile("n_messages", 0.5).alias("median"))
    return s.join(F.broadcast(multi), F.lit(True)).select(
        F.col("n").alias("conversations"), F.col("total").alias("messages"),
        ratio(F.col("total"), F.col("n")).alias("average"), "median", "p95", "p99", "maximum",
        "multi_day_conversations")


def platform_split(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Messages per platform; messages without a device form their own bucket."""
    counted = messages.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    platform = F.when(F.col("device_id").isNull(), "NULL").otherwise(F.col("app_platform"))
    return counted.join(devices.select("device_id", "app_platform"), "device_id", "left").groupBy(
        platform.alias("platform")).agg(F.sum("n").alias("messages"))


def latency_by_model(inferences: DataFrame) -> DataFrame:
    """Nearest-rank latency percentiles per model.

    The percentile buffers hold counts per distinct millisecond value, bounded by the
    latency range.
    """
    latency = F.col("latency_ms")
    def disc(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) within group (order by latency_ms)")

    return inferences.filter(latency.isNotNull() & F.col("model_id").isNotNull()).groupBy(
        "model_id").agg(F.count(F.lit(1)).alias("n"), disc(0.5).alias("median"),
                        disc(0.95).alias("p95"))


def feedback_by_model(
    feedback: DataFrame, completions: DataFrame, inferences: DataFrame
) -> DataFrame:
    """Feedback and positive rates per model against its successful completions."""
    model = inferences.select("completion_id", "model_id").filter(F.col("model_id").isNotNull())
    success = (
        completions.filter(F.col("completion_status") == "SUCCESS").select("completion_id")
        .join(model, "completion_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("successes")))
    given = feedback.join(model, "completion_id").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.count_if(F.expr(POSITIVE_FEEDBACK)).alias("positive_count"))
    return success.join(given, "model_id", "left").select(
        "model_id", "successes", F.coalesce("feedback_count", F.lit(0)).alias("feedback_count"),
        (F.coalesce(ratio(F.col("feedback_count"), F.col("successes")), F.lit(0.0)) * 100)
        .alias("feedback_rate"),
        (F.coalesce(ratio(F.col("positive_count"), F.col("feedback_count")), F.lit(0.0)) * 100)
        .alias("positive_rate"))


def feedback_per_user(feedback: DataFrame) -> DataFrame:
    per = feedback.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("max_per_user"), F.avg("n").alias("mean_per_user"),
                   F.count(F.lit(1)).alias("users"))


CONTEXT_COLUMNS = ("user_id", "conversation_id", "message_id", "completion_id", "inference_id",
                   "model_id")


def error_summary(errors: DataFrame, inferences: DataFrame) -> DataFrame:
    """Error counts per dimension value, context completeness and linked failures."""
    dims = errors.groupingSets(
        [["error_source"], ["error_type"], ["severity"], ["model_id"]],
        "error_source", "error_type", "severity", "model_id",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    names = {7: "error_source", 11: "error_type", 13: "severity", 14: "model_id"}
    pick = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for g, n in names.items()])
    by_dim = dims.select(
        pick.alias("dimension"),
        F.coalesce("error_source", "error_type", "severity", "model_id", F.lit("NULL")).alias("value"),
        "n")
    context = errors.agg(*[F.count(c).alias(c) for c in CONTEXT_COLUMNS]).unpivot(
        [], list(CONTEXT_COLUMNS), "value", "n").select(F.lit("context").alias("dimension"), "value", "n")
    linked = (
        errors.filter(F.col("error_source") == "MODEL").select("inference_id").distinct()
        .join(inferences.filter(F.col("inference_status") == "FAILED").select("inference_id"), "inference_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("linked_failures").alias("dimension"), F.lit("MODEL").alias("value"), "n"))
    return union_all([by_dim, context, linked])


def plan_transitions(
    subscriptions: DataFrame, plans: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Moves between consecutive plans; same-plan moves dropped, paid to free merged."""
    named = subscriptions.join(plans.select("plan_id", "plan_name"), "plan_id").select(
        "user_id", "subscription_id", "started_at", "plan_name")
    moved = running(named, ["user_id"], ["started_at", "subscription_id"],
                    [lagged("previous", F.col("plan_name"))], hot_rows=hot_rows)
    name = F.when(
        F.col("previous").isin("PLUS", "PRO") & (F.col("plan_name") == "FREE"), "paid -> FREE"
    ).otherwise(F.concat_ws(" -> ", "previous", "plan_name"))
    return moved.filter(
        F.col("previous").isNotNull() & (F.col("previous") != F.col("plan_name"))
    ).groupBy(name.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def plan_adoption(
    subscriptions: DataFrame, plans: DataFrame, users: DataFrame, horizon: str
) -> DataFrame:
    """Lifetime adoption, current plans and paid duration in days, one row."""
    named = subscriptions.join(plans.select("plan_id", "plan_name"), "plan_id")
    plan, active = F.col("plan_name"), F.col("subscription_status") == "ACTIVE"
    end = F.coalesce("ended_at", F.lit(horizon).cast("timestamp"))
    days = F.when(plan != "FREE",
                  (F.unix_micros(end) - F.unix_micros("started_at")) / F.lit(86_400_000_000.0))
    row = named.agg(
        F.count_distinct(F.when(plan == "PLUS", F.col("user_id"))).alias("ever_plus"),
        F.count_distinct(F.when(plan == "PRO", F.col("user_id"))).alias("ever_pro"),
        F.count_distinct(F.when(plan != "FREE", F.col("user_id"))).alias("ever_paid"),
        F.count_if(active & (plan == "FREE")).alias("current_free"),
        F.count_if(active & (plan == "PLUS")).alias("current_plus"),
        F.count_if(active & (plan == "PRO")).alias("current_pro"),
        F.avg(days).alias("mean_paid_days"),
    )
    total = users.agg(F.count(F.lit(1)).alias("users"))
    return row.join(F.broadcast(total), F.lit(True)).withColumn(
        "never_paid", F.col("users") - F.col("ever_paid"))


def attempt_outcomes(payments: DataFrame) -> DataFrame:
    """Purchases by attempt bucket and outcome."""
    paid = F.col("payment_status").isin("SUCCESS", "REFUNDED")
    per = payments.groupBy("purchase_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(paid).alias("any_paid"),
        F.min_by(paid, F.struct("processed_at", "payment_id")).alias("first_paid"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").otherwise("3+")
    outcome = F.when(F.col("first_paid"), "first_success").when(
        F.col("any_paid"), "success_after_retry").otherwise("all_failed")
    return per.groupBy(bucket.alias("attempts"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("purchases"))


def money_rollup(purchases: DataFrame, payments: DataFrame) -> DataFrame:
    """Gross, discounts, tax, completed, refunds and net, one row."""
    kept = F.col("purchase_status").isin("COMPLETED", "REFUNDED")
    sums = purchases.agg(
        F.sum("subtotal_amount").alias("gross"), F.sum("discount_amount").alias("discounts"),
        F.sum("tax_amount").alias("tax"),
        F.sum(F.when(kept, F.col("total_amount")).otherwise(0)).alias("completed"))
    back = payments.agg(F.sum("refund_amount").alias("refunds"))
    return sums.join(F.broadcast(back), F.lit(True)).withColumn(
        "net_collected", F.col("completed") - F.col("refunds"))


def update_buckets(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users with zero, one or several updates."""
    per = updates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    bucket = F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")
    return users.select("user_id").join(per, "user_id", "left").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("users"))


def parsed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines with their parsed value (null when malformed) and whether it is an object."""
    doc = F.try_parse_json(F.col(column))
    return lines.select(column, doc.alias("doc")).withColumn(
        "is_object", F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False)))


def malformed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Line counts: all, malformed, parsed but not an object."""
    return parsed_lines(lines, column).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("doc").isNull()).alias("malformed"),
        F.count_if(F.col("doc").isNotNull() & ~F.col("is_object")).alias("non_object"))


def field_profile(lines: DataFrame, column: str = "line") -> DataFrame:
    """Per field: present, absent and null rows and one row per observed JSON type."""
    objects = parsed_lines(lines, column).filter("is_object").select("doc")
    # Reduce each document to (key, type) pairs; counts then combine map-side.
    pairs = objects.lateralJoin(
        objects.sparkSession.tvf.variant_explode(F.col("doc").outer())
    ).select("key", F.schema_of_variant("value").alias("raw"))
    raw = F.col("raw")
    kind = (
        F.when(raw == "VOID", "null").when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean")
        .when(raw == "BIGINT", "integer").when(F.startswith(raw, F.lit("OBJECT")), "object")
        .when(F.startswith(raw, F.lit("ARRAY")), "array").otherwise("number"))
    typed = pairs.groupBy(F.col("key").alias("field"), kind.alias("json_type")).agg(
        F.count(F.lit(1)).alias("type_count"))
    per_field = typed.groupBy("field").agg(
        F.sum("type_count").alias("present"),
        F.sum(F.when(F.col("json_type") == "null", F.col("type_count")).otherwise(0)).alias("nulls"))
    total = objects.agg(F.count(F.lit(1)).alias("objects"))
    return typed.join(per_field, "field").join(F.broadcast(total), F.lit(True)).select(
        "field", "json_type", "type_count", "present", (F.col("objects") - F.col("present")).alias("absent"),
        "nulls")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null rows per column in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot(["rows"], list(columns), "field", "nulls")


def null_profile(tables: Mapping[str, DataFrame], log: DataFrame) -> DataFrame:
    """Null percentage per entity and field beside the injected missing values."""
    injected = log.filter(F.col("issue_type") == "MISSING_FIELD").groupBy(
        "entity_name", F.col("field_name").alias("field")).agg(F.count(F.lit(1)).alias("injected"))
    profile = union_all([
        null_counts(df, schemas.entity_columns(e)).select(F.lit(e).alias("entity_name"), "*")
        for e, df in tables.items()])
    return profile.join(F.broadcast(injected), ["entity_name", "field"], "left").select(
        "entity_name", "field", "rows", "nulls",
        (F.coalesce(ratio(F.col("nulls"), F.col("rows")), F.lit(0.0)) * 100).alias("null_pct"),
        F.coalesce("injected", F.lit(0)).alias("injected"))


def entity_summary(tables: Mapping[str, DataFrame], files: bool = False) -> DataFrame:
    """Rows, partitions and date range per entity; with ``files`` also files and bytes.

    File facts need tables that are scans of files.
    """
    parts = []
    for e, df in tables.items():
        if files:
            per_file = df.select("dt", F.col("_metadata.file_path").alias("p"),
                                 F.col("_metadata.file_size").alias("b")).groupBy("p").agg(
                F.max("b").alias("b"))
            extra = per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dt").alias("partitions"),
                     F.min("dt").alias("first_date"), F.max("dt").alias("last_date"))
        if files:
            row = row.join(F.broadcast(extra), F.lit(True))
        parts.append(row.select(F.lit(e).alias("entity_name"), "*"))
    return union_all(parts)


def domain_rollup(summary: DataFrame) -> DataFrame:
    """Rows and partitions rolled up from entity to domain to total."""
    spark = summary.sparkSession
    names = F.broadcast(spark.createDataFrame(
        [(e, d) for d, es in DOMAINS.items() for e in es], "entity_name string, domain string"))
    return summary.join(names, "entity_name").rollup("domain", "entity_name").agg(
        F.sum("rows").alias("rows"), F.max("partitions").alias("partitions"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def stored_files(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """Rows and bytes of each table's files as scanned, beside the bytes that the store lists. Listing and
    scan are independent of one another."""
    listed = union_all([
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("listed")).select(F.lit(name).alias("table_name"), "listed")
        for name, path in paths.items()])
    scanned = file_accounting({n: spark.read.parquet(p) for n, p in paths.items()}).groupBy("table_name").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("scanned"))
    return listed.join(scanned, "table_name", "left").select(
        "table_name", F.coalesce("rows", F.lit(0)).alias("rows"), "listed", F.coalesce("scanned", F.lit(0)).alias("scanned"))


def storage_bytes(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """How many tables there are, and of how many the bytes of the files scanned equal those listed."""
    return stored_files(paths, spark).agg(
        F.count(F.lit(1)).alias("stored_tables"), F.count_if(F.col("listed") == F.col("scanned")).alias("bytes_met"))


def profile_checks(
    log: DataFrame, clean: Mapping[str, DataFrame], dirty: Mapping[str, DataFrame], lines: DataFrame, storage: DataFrame,
) -> DataFrame:
    """Consistency checks of the profile as (check_name, status, expected, actual); ``storage`` is one
    row (stored_tables, bytes_met), see ``storage_bytes``."""
    total = log.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("issue_type").alias("issues"),
        F.count("entity_name").alias("entities"),
        F.count_if(F.col("issue_type") == "MISSING_FIELD").alias("missing"),
        F.count_if((F.col("issue_type") == "MISSING_FIELD") & F.col("field_name").isNotNull())
        .alias("missing_fields"),
        F.count_if(F.col("issue_type") == "OUT_OF_ORDER_TIMESTAMP").alias("temporal"),
        F.count_if((F.col("issue_type") == "OUT_OF_ORDER_TIMESTAMP") & F.col("violation_type").isNotNull())
        .alias("temporal_classified"),
        F.count_if(F.col("issue_type") == "DUPLICATE_RECORD").alias("duplicates"),
        F.count_distinct("entity_name", "source_record_id").alias("unique_records"),
    )
    marked = log.filter(F.col("issue_type") == "DUPLICATE_RECORD").select("entity_name", F.lit(1).alias("duplicate"), F.lit(0).alias("surplus"))
    sides = [t.select(F.lit(e).alias("entity_name"), F.lit(0).alias("duplicate"), F.lit(n).alias("surplus"))
             for tables, n in ((dirty, 1), (clean, -1)) for e, t in tables.items()]
    # Every entity by itself, so that two errors can't cancel.
    by_entity = union_all([marked, *sides]).groupBy("entity_name").agg(F.sum("duplicate").alias("d"), F.sum("surplus").alias("s")).agg(
        F.count(F.lit(1)).alias("deltas"), F.count_if(F.col("d") == F.col("s")).alias("deltas_met"),
        F.coalesce(F.sum(F.when(F.col("d") == F.col("s"), F.col("d"))), F.lit(0)).alias("duplicates_met"))

    def rows_of(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
        return union_all([t.agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("lo"), F.max("dt").alias("hi"))
                          for t in tables.values()]).agg(
            F.sum("n").alias(f"{name}_rows"),
            F.count_if(F.col("lo") > F.col("hi")).alias(f"{name}_bad_ranges"))
    bad = malformed_lines(lines).select((F.col("malformed") + F.col("non_object")).alias("bad_lines"))
    one = total
    for other in (rows_of(clean, "clean"), rows_of(dirty, "dirty"), by_entity, storage, bad):
        one = one.join(F.broadcast(other), F.lit(True))
    checks = {
        "manifest_rows_equal_issue_sum": ("rows", "issues"),
        "entity_issue_totals": ("rows", "entities"),
        "bronze_clean_duplicate_delta": ("deltas", "deltas_met"),
        "manifest_duplicate_counts_reconciled": ("duplicates", "duplicates_met"),
        "manifest_missing_counts_reconciled": ("missing", "missing_fields"),
        "manifest_timestamp_counts_reconciled": ("temporal", "temporal_classified"),
        "manifest_unique_affected_records": ("rows", "unique_records"),
        "storage_byte_reconciliation": ("stored_tables", "bytes_met"),
        "partition_date_ranges": ("0", "clean_bad_ranges + dirty_bad_ranges"),
        "stream_parse_errors": ("0", "bad_lines"),
    }
    rows = F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.expr(f"cast({e} as bigint)").alias("expected"),
                 F.expr(f"cast({a} as bigint)").alias("actual"))
        for n, (e, a) in checks.items()])
    out = one.select(F.explode(rows).alias("r")).select(
        "r.*", F.when(F.col("r.expected") == F.col("r.actual"), "PASS").otherwise("FAIL").alias("status"))
    overall = out.agg(
        F.lit("overall").alias("check_name"), F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("status") == "PASS").alias("actual")
    ).withColumn("status", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))
    return out.unionByName(overall)
