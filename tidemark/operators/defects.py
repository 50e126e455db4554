"""Deterministic defects: selection, dirty tables, manifest and its reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import may_be_in
from tidemark.operators.monitoring import union_all

MISSING = "MISSING_FIELD"
DUPLICATE = "DUPLICATE_RECORD"
TEMPORAL = "OUT_OF_ORDER_TIMESTAMP"


@dataclass(frozen=True)
class DefectPlan:
    """Rates and target columns of one entity."""

    missing_field: str
    missing_rate: float
    duplicate_rate: float = 0.0
    timestamp_rate: float = 0.0
    timestamp_field: str | None = None
    timestamp_base: str | None = None
    violation: str | None = None


# Defect rates and fields per entity. ``parent_at`` stands for the time of
# the parent row, joined beforehand.
PLANS = {
    "users": DefectPlan("email", 0.0048),
    "messages": DefectPlan("message_text", 0.0042, 0.0018, 0.0005, "created_at", "parent_at",
                           "MESSAGE_BEFORE_CONVERSATION"),
    "completions": DefectPlan("user_id", 0.0045, 0.0017, 0.0005, "completed_at", "requested_at",
                              "COMPLETION_BEFORE_REQUEST"),
    "model_inferences": DefectPlan("model_id", 0.0038, 0.0015, 0.0004, "response_at", "request_at",
                                   "INFERENCE_RESPONSE_BEFORE_REQUEST"),
    "feedback": DefectPlan("feedback_type", 0.0052, 0.0012),
    "purchases": DefectPlan("purchase_type", 0.0046),
    "payments": DefectPlan("payment_method", 0.0040, 0.0020, 0.0007, "processed_at", "parent_at",
                           "PAYMENT_BEFORE_PURCHASE"),
}

# Parent table, key and time of the entities whose shift starts from ``parent_at``.
PARENTS = {
    "messages": ("conversations", "conversation_id", "created_at"),
    "payments": ("purchases", "purchase_id", "purchase_created_at"),
}

# Replay delay and time shift, seconds.
REPLAY_BASE, REPLAY_SPAN, SHIFT_SPAN = 300, 129_300, 3_600


def stable_fraction(seed: int, entity: str, key: Column, word: int = 0) -> Column:
    """Eight bytes of sha256(seed:entity:id) as a fraction of one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{entity}:"), key.cast("string")), 256)
    part = F.conv(F.substring(digest, 1 + 16 * word, 16), 16, 10)
    return part.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def selected_issue(fraction: Column, plan: DefectPlan) -> Column:
    """At most one issue per row by cumulative rate bands."""
    first = plan.missing_rate
    second = first + plan.duplicate_rate
    third = second + plan.timestamp_rate
    return (
        F.when(fraction < first, MISSING).when(fraction < second, DUPLICATE)
        .when(fraction < third, TEMPORAL)
    )


def iso(at: Column) -> Column:
    """UTC ISO text; microseconds appear only when they are not zero."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(at) % 1_000_000
    return F.when(micros == 0, F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("Z"))
    )


def _text(df: DataFrame, column: str) -> Column:
    simple = df.schema[column].dataType.simpleString()
    return iso(F.col(column)) if simple == "timestamp" else F.col(column).cast("string")


def drawn(rows: DataFrame, entity: str, seed: int) -> DataFrame:
    """Add ``__fraction``, which selects the issue; a generated column, so that filters on the issue
    read it and do not hash the id again for every comparison."""
    fraction = stable_fraction(seed, entity, F.col(schemas.ENTITY_ID[entity]))
    return rows.withColumn("__fraction", F.explode(F.array(fraction)))


def shifted(entity: str, plans: Mapping[str, DefectPlan] = PLANS) -> Column:
    """Whether a drawn row is selected for a shift in time, which alone needs the parent."""
    return F.coalesce(selected_issue(F.col("__fraction"), plans[entity]) == TEMPORAL, F.lit(False))


def with_parent_time(
    rows: DataFrame, parent: DataFrame, key: str, parent_at: str, due: Column | None = None,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Add ``parent_at``; where ``due`` is given, only those rows meet their parents, unique then on ``key``.
    ``cut`` may write the rows that were joined."""
    times = parent.select(key, F.col(parent_at).alias("parent_at"))
    if due is None:
        return cut(rows.join(times, key, "left"))
    none = F.lit(None).cast("timestamp").alias("parent_at")
    return rows.filter(~due).select("*", none).unionByName(
        cut(rows.filter(due).join(times, key, "left")))


def label(
    rows: DataFrame, entity: str, seed: int, horizon: str,
    plans: Mapping[str, DefectPlan] = PLANS,
) -> DataFrame:
    """Rows with ``issue`` and the values it would inject; inapplicable issues are dropped."""
    plan = plans[entity]
    key = F.col(schemas.ENTITY_ID[entity])
    if "__fraction" not in rows.columns:
        rows = drawn(rows, entity, seed)
    end = F.lit(horizon).cast("timestamp")
    seconds = F.lit(REPLAY_BASE) + F.floor(stable_fraction(seed, entity, key, 1) * REPLAY_SPAN)
    shift = F.lit(1) + F.floor(stable_fraction(seed, entity, key, 2) * SHIFT_SPAN)
    issue = selected_issue(F.col("__fraction"), plan)
    possible = F.when(issue == MISSING, F.col(plan.missing_field).isNotNull()).when(
        issue == DUPLICATE, F.col("ingested_at") < end)
    out = rows.withColumn("replay_at", F.when(
        issue == DUPLICATE, F.least(end, F.col("ingested_at") + F.make_dt_interval(secs=seconds))))
    if plan.timestamp_field:
        base = F.col(plan.timestamp_base)
        ok = base.isNotNull() & (
            F.col(plan.timestamp_field).isNotNull() if plan.timestamp_base != "parent_at" else F.lit(True))
        possible = possible.when(issue == TEMPORAL, ok)
        out = out.withColumn("shifted_at", F.when(issue == TEMPORAL, base - F.make_dt_interval(secs=shift)))
    else:
        out = out.withColumn("shifted_at", F.lit(None).cast("timestamp"))
    return out.withColumn("issue", F.when(possible, issue)).drop("__fraction")


def dirty_rows(labelled: DataFrame, entity: str, plans: Mapping[str, DefectPlan] = PLANS) -> DataFrame:
    """The table with its defects: one pass, replays by exploding two ingestion times."""
    plan = plans[entity]
    columns = [*schemas.entity_columns(entity), "ingested_at"]
    times = F.when(F.col("issue") == DUPLICATE, F.array("ingested_at", "replay_at")).otherwise(
        F.array("ingested_at"))
    changed = {plan.missing_field: F.when(F.col("issue") == MISSING, F.lit(None)).otherwise(
        F.col(plan.missing_field))}
    if plan.timestamp_field:
        changed[plan.timestamp_field] = F.when(
            F.col("issue") == TEMPORAL, F.col("shifted_at")).otherwise(F.col(plan.timestamp_field))
    rows = labelled.withColumn("__at", F.explode(times)).withColumns(changed)
    return rows.withColumn("ingested_at", F.col("__at")).select(*columns).withColumn(
        "dt", F.to_date("ingested_at"))


def manifest(
    labelled: DataFrame, entity: str, seed: int, plans: Mapping[str, DefectPlan] = PLANS
) -> DataFrame:
    """One row per injected defect."""
    plan = plans[entity]
    key, issue = schemas.ENTITY_ID[entity], F.col("issue")
    prefix = F.concat(F.lit(f"{seed}:{entity}:"), F.col(key), F.lit(":"), issue)
    field = F.when(issue == MISSING, plan.missing_field).when(issue == DUPLICATE, "ingested_at")
    original = F.when(issue == MISSING, _text(labelled, plan.missing_field)).when(
        issue == DUPLICATE, iso(F.col("ingested_at")))
    injected = F.when(issue == DUPLICATE, iso(F.col("replay_at")))
    violation = F.when(issue == MISSING, "NULL_REQUIRED_FIELD").when(
        issue == DUPLICATE,
        F.when(F.to_date("replay_at") == F.to_date("ingested_at"), "REPLAY_SAME_DAY")
        .otherwise("REPLAY_CROSS_DAY"))
    if plan.timestamp_field:
        field = field.when(issue == TEMPORAL, plan.timestamp_field)
        original = original.when(issue == TEMPORAL, iso(F.col(plan.timestamp_field)))
        injected = injected.when(issue == TEMPORAL, iso(F.col("shifted_at")))
        violation = violation.when(issue == TEMPORAL, plan.violation)
    return labelled.filter(issue.isNotNull()).select(
        F.concat(F.lit("inj_"), F.substring(F.sha2(prefix, 256), 1, 24)).alias("injection_id"),
        F.lit(entity).alias("entity_name"),
        F.col(key).alias("source_record_id"),
        issue.alias("issue_type"),
        field.alias("field_name"),
        original.alias("original_value"),
        injected.alias("injected_value"),
        iso(F.col("ingested_at")).alias("original_ingested_at"),
        iso(F.when(issue == DUPLICATE, F.col("replay_at")).otherwise(F.col("ingested_at")))
        .alias("dirty_ingested_at"),
        violation.alias("violation_type"),
    )


def reconcile_settled(
    clean: DataFrame, dirty: DataFrame, log: DataFrame, entity: str,
    plans: Mapping[str, DefectPlan] = PLANS, cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The failures of ``reconcile``, for tables of which most records have no manifest entry.

    One narrow grouping over all rows, of which only id and digest go on, settles every record without
    a manifest entry; the few others go to ``reconcile``. ``cut`` may write the records left open.
    """
    key = schemas.ENTITY_ID[entity]
    columns = [*[c for c in schemas.entity_columns(entity) if c != key], "ingested_at"]
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    no = F.lit(None).cast("bigint")

    def lane(df: DataFrame, name: str) -> DataFrame:
        marks = (F.xxhash64(text), F.xxhash64(F.lit(entity), text))
        return df.select(
            F.col(key).cast("string").alias("id"), *[
                (m if here == name else no).alias(f"{here}{i}")
                for here in ("clean", "dirty") for i, m in enumerate(marks)], F.lit(False).alias("noted"))

    notes = log.select(F.col("source_record_id").cast("string").alias("id"), F.lit(True).alias("noted"))
    lanes = lane(clean, "clean").unionByName(lane(dirty, "dirty")).unionByName(notes, allowMissingColumns=True)
    marks = [f"{here}{i}" for here in ("clean", "dirty") for i in (0, 1)]
    per = lanes.groupBy("id").agg(
        F.count("dirty0").alias("copies"), F.max("noted").alias("noted"),
        *[f(m).alias(f"{n}_{m}") for m in marks for n, f in (("lo", F.min), ("hi", F.max))])

    def one(here: str) -> Column:
        return (F.col(f"lo_{here}0") == F.col(f"hi_{here}0")) & (F.col(f"lo_{here}1") == F.col(f"hi_{here}1"))

    in_clean = F.col("lo_clean0").isNotNull()
    agree = (F.col("copies") == 0) | (
        one("dirty") & (F.col("lo_dirty0") == F.col("lo_clean0")) & (F.col("lo_dirty1") == F.col("lo_clean1")))
    failures = F.array_compact(F.array(
        F.when(~in_clean, "DIRTY_WITHOUT_CLEAN"), F.when(in_clean & (F.col("copies") != 1), "COPY_COUNT"),
        F.when(in_clean & ~agree, "CONTENT")))
    # Without a manifest entry and with at most one text of the clean record nothing else can fail.
    per = per.select("id", "copies", (F.col("noted") | (in_clean & ~one("clean")) | F.col("id").isNull()).alias("unsettled"),
                     failures.alias("failures"))
    left = cut(per.filter(F.col("unsettled") | (F.size("failures") > 0)))
    settled = left.filter(~F.col("unsettled")).select(
        F.col("id").alias("record_id"), F.lit(None).cast("string").alias("issue_type"), "copies",
        F.explode("failures").alias("failure"))
    ids = left.filter("unsettled").select("id")

    def among(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("__id", F.col(name).cast("string"))
        near, wanted = may_be_in(df, ids.withColumnRenamed("id", "__id"), "__id"), ids.withColumnRenamed("id", "__wanted")
        return near.join(wanted, F.col("__id").eqNullSafe(F.col("__wanted")), "left_semi").drop("__id")

    return settled.unionByName(reconcile(
        among(clean, key), among(dirty, key), among(log, "source_record_id"), entity, plans))


def reconcile(
    clean: DataFrame, dirty: DataFrame, log: DataFrame, entity: str,
    plans: Mapping[str, DefectPlan] = PLANS,
) -> DataFrame:
    """Failures of the manifest against clean and dirty data, labelled per record.

    Clean, manifest and dirty rows run as narrow lanes of one table: of a row only digests of its columns go
    on, whole and without the column a defect may touch. Equal lanes are counted before anything is
    grouped by record, so a record with very many copies is a few rows; nothing is joined.
    """
    plan, key = plans[entity], schemas.ENTITY_ID[entity]
    columns = [c for c in schemas.entity_columns(entity) if c != key]
    empty = F.lit(None).cast("string")

    def digest(*without: str) -> Column:
        return F.md5(F.concat_ws("\x1f", *[
            F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns if c not in without]))

    def lane(df: DataFrame, name: str) -> DataFrame:
        stamp = iso(F.col(plan.timestamp_field)) if plan.timestamp_field else empty
        rest = digest(plan.timestamp_field) if plan.timestamp_field else empty
        return df.select(
            F.col(key).cast("string").alias("id"), F.lit(name).alias("lane"), digest().alias("whole"),
            digest(plan.missing_field).alias("but_missing"), rest.alias("but_time"),
            F.col(plan.missing_field).isNull().alias("gap"), stamp.alias("stamp"),
            F.col("ingested_at").cast("string").alias("landed"), iso(F.col("ingested_at")).alias("landed_iso"),
            empty.alias("issue_type"), empty.alias("injected_value"), empty.alias("dirty_ingested_at"))

    notes = log.select(
        F.col("source_record_id").cast("string").alias("id"), F.lit("log").alias("lane"), "issue_type", "injected_value", "dirty_ingested_at")
    lanes = lane(clean, "clean").unionByName(lane(dirty, "dirty")).unionByName(notes, allowMissingColumns=True)
    lanes = lanes.groupBy(*lanes.columns).agg(F.count(F.lit(1)).alias("n"))
    record = Window.partitionBy("id")

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("lane") == name, F.col(column))).over(record)

    beside = lanes.withColumns({
        **{f"clean_{c}": of("clean", c) for c in ("whole", "but_missing", "but_time", "gap", "landed")},
        **{f"log_{c}": of("log", c) for c in ("issue_type", "injected_value", "dirty_ingested_at")}})
    issue = F.col("log_issue_type")

    def same(c: str) -> Column:
        return F.col(c).eqNullSafe(F.col(f"clean_{c}"))

    good = (
        F.when(issue == MISSING, F.col("gap") & ~F.col("clean_gap") & same("but_missing") & same("landed"))
        .when(issue == DUPLICATE, same("whole") & (same("landed") | F.col("landed_iso").eqNullSafe(F.col("log_dirty_ingested_at"))))
        .when(issue == TEMPORAL, F.col("stamp").eqNullSafe(F.col("log_injected_value")) & same("but_time") & same("landed"))
        .otherwise(same("whole") & same("landed")))
    is_dirty = F.col("lane") == "dirty"
    per = beside.groupBy("id").agg(
        F.max("log_issue_type").alias("issue_type"),
        F.max(F.col("lane") == "clean").alias("in_clean"),
        F.max(F.col("lane") == "log").alias("in_log"),
        F.coalesce(F.sum(F.when(is_dirty, F.col("n"))), F.lit(0)).alias("copies"),
        F.count_if(is_dirty & ~F.coalesce(good, F.lit(False))).alias("wrong"),
        F.count_distinct(F.when(is_dirty, F.col("landed"))).alias("times"),
    )
    expected = F.when(F.col("issue_type") == DUPLICATE, 2).otherwise(1)
    failures = F.array_compact(F.array(
        F.when(~F.col("in_clean") & F.col("in_log"), "MANIFEST_WITHOUT_CLEAN"),
        F.when(~F.col("in_clean") & ~F.col("in_log"), "DIRTY_WITHOUT_CLEAN"),
        F.when(F.col("in_clean") & (F.col("copies") != expected), "COPY_COUNT"),
        F.when(F.col("in_clean") & (F.col("wrong") > 0), "CONTENT"),
        F.when(F.col("in_clean") & (F.col("issue_type") == DUPLICATE) & (F.col("times") != 2),
               "REPLAY_TIME"),
    ))
    return per.select(F.col("id").alias("record_id"), "issue_type", "copies",
                      F.explode(failures).alias("failure"))


def manifest_summary(log: DataFrame, clean_rows: DataFrame) -> DataFrame:
    """Counts at every manifest level in one grouping-sets pass.

    ``clean_rows`` has entity_name and rows; the percentage is of the clean rows.
    """
    levels = [
        ["entity_name"], ["entity_name", "issue_type"], ["entity_name", "issue_type", "field_name"],
        ["entity_name", "issue_type", "violation_type"],
    ]
    counted = log.groupingSets(
        levels, "entity_name", "issue_type", "field_name", "violation_type"
    ).agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_distinct("source_record_id").alias("affected_records"),
        F.grouping_id().alias("level"),
    )
    return counted.join(F.broadcast(clean_rows), "entity_name", "left").select(
        "level", "entity_name", "issue_type", "field_name", "violation_type", "issue_count",
        "affected_records",
        (F.col("affected_records") * 100.0 / F.col("rows")).alias("affected_pct"),
    )


def issue_counts(logs: list[DataFrame]) -> DataFrame:
    return union_all(logs).groupBy("issue_type", "violation_type").agg(
        F.count(F.lit(1)).alias("issue_count"))
