"""Incident lifecycle over check observations, as windows; the streaming twin keeps state."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import repeated_and_single
from tidemark.functions.ordered import (
    HOT_ROWS,
    running,
    running_last,
    running_last_before,
    running_sum,
)
from tidemark.operators.monitoring import normalise_status
from tidemark.operators.upserts import insert_new

ACTIVE = ("WARN", "FAIL")
NOTIFIED = ("NEW", "RECURRING", "RESOLVED")
#: Characters that a JSON text escapes. Those it keeps are listed one by one: Java looks them up in a
#: table, where it tests ranges in turn, ten times slower over millions of texts.
NOT_PLAIN = "[^" + "".join(c if c.isalnum() else f"\\{c}" for c in map(chr, range(0x20, 0x7F)) if c not in '"\\') + "]"


def fingerprint(source: Column, category: Column, parts: Sequence[Column]) -> Column:
    """Stable identity hash: sha-256 of the JSON text of the trimmed, lower-cased parts."""
    # concat_ws leaves nulls out; an array of the parts would be filtered without generated code.
    cleaned = [F.when(p.cast("string") != "", F.lower(F.trim(p.cast("string")))) for p in parts]
    text = F.concat_ws(":", source, category, *cleaned)
    return F.sha2(json_string(text), 256)


def json_string(text: Column) -> Column:
    """Text as a JSON string in ASCII: quotes, backslashes and control characters escaped, all else
    beyond ASCII as UTF-16 units. Only texts that hold such characters are taken apart."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        out = F.when((code >= 0x20) & (code < 0x7F), c).when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))
        for sign, short in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = F.when(c == sign, short).otherwise(out)
        return out

    taken_apart = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), "")
    plain = ~text.rlike(NOT_PLAIN)
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(taken_apart), F.lit('"'))


def json_object(fields: Mapping[str, Column]) -> Column:
    """A JSON object with sorted keys; values are JSON texts, null for none."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def observation_id(digest: Column, token: Column) -> Column:
    """Hash of fingerprint and token, a JSON text, in canonical JSON form. ``digest`` is hexadecimal,
    so quotes make it a JSON text; it should be a column that is there already, not computed again."""
    quoted = F.concat(F.lit('"'), digest, F.lit('"'))
    return F.sha2(json_object({"fingerprint": quoted, "observation_token": token}), 256)


def check_token(category: Column, reference_date: Column) -> Column:
    """What tells sightings of a check apart: the day it is about, by its category, or else its time."""
    day = json_string(F.coalesce(reference_date.cast("string"), F.lit("none")))
    none = F.lit("null")
    return (
        F.when(category == "volume", json_object({"activity_date": day, "execution_run_id": none}))
        .when(category == "quality", json_object({"execution_run_id": none, "metric_date": day}))
        .otherwise(day))


def check_observations(checks: DataFrame, observed_at: Column) -> DataFrame:
    """Monitoring rows as observations (category, check_name, reference_date, status)."""
    digest = fingerprint(F.lit("observability"), F.col("category"), [F.col("check_name")])
    return checks.withColumn("fingerprint", digest).select(
        F.lit("observability").alias("source"), "category", F.col("check_name").alias("identity"),
        "fingerprint", normalise_status(F.col("status")).alias("status"),
        observed_at.alias("observed_at"),
        observation_id(F.col("fingerprint"), check_token(F.col("category"), F.col("reference_date"))).alias("observation_id"))


def run_observations(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task observations, plus one per run when no task explains its failure."""
    times = runs.select("run_id", "job_id", F.col("end_time").alias("run_end"))
    status = normalise_status(F.col("result_state"))
    task_digest = fingerprint(F.lit("jobs"), F.lit("execution"),
                              [F.col("job_id"), F.lit("task"), F.col("task_key")])
    per_task = tasks.join(times, "run_id").withColumn("fingerprint", task_digest).select(
        "run_id", F.concat_ws(":", "job_id", F.lit("task"), "task_key").alias("identity"),
        "fingerprint", status.alias("status"),
        F.coalesce("end_time", "run_end").alias("observed_at"),
        observation_id(F.col("fingerprint"), json_object({"run_id": F.col("run_id").cast("string"), "task_key": json_string(F.col("task_key"))}))
        .alias("observation_id"))
    verdict = tasks.groupBy("run_id").agg(F.bool_or(status == "FAIL").alias("task_failed"))
    run_digest = fingerprint(F.lit("jobs"), F.lit("execution"), [F.col("job_id"), F.lit("pipeline")])
    per_run = (
        runs.join(verdict, "run_id", "left")
        .filter(F.col("task_failed").isNull() | ((status == "FAIL") & ~F.col("task_failed")))
        .withColumn("fingerprint", run_digest)
        .select("run_id", F.concat_ws(":", "job_id", F.lit("pipeline")).alias("identity"),
                "fingerprint", status.alias("status"),
                F.coalesce("end_time", "start_time").alias("observed_at"),
                observation_id(F.col("fingerprint"), json_object({"run_id": F.col("run_id").cast("string"), "scope": json_string(F.lit("pipeline"))}))
                .alias("observation_id")))
    return per_task.unionByName(per_run)


def evidence_association(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reason why a monitoring snapshot may or may not belong to a run; never certain.

    ``snapshots`` has run_id, first_at and last_at of the monitoring times tied to a run.
    """
    joined = runs.join(snapshots, "run_id", "left")
    reason = (
        F.when(F.col("first_at").isNull(), "observability_snapshot_has_no_monitoring_execution_timestamp")
        .when(F.col("start_time").isNull() | F.col("end_time").isNull(),
              "pipeline_execution_window_is_incomplete")
        .when((F.col("first_at") >= F.col("start_time")) & (F.col("last_at") <= F.col("end_time")),
              "timestamp_window_match_does_not_prove_execution_identity")
        .otherwise("monitoring_execution_timestamp_is_outside_pipeline_run_window"))
    return joined.select("run_id", F.lit("UNCERTAIN").alias("status"), reason.alias("reason"))


def held(df: DataFrame) -> DataFrame:
    """An intermediate table held by the executors, where no shared folder is named; keeps plans short."""
    return df.localCheckpoint()


def first_sightings(
    observations: DataFrame, cut: Callable[[DataFrame], DataFrame] = held,
) -> tuple[DataFrame, DataFrame]:
    """Observations by their first sighting, and all repeats of an observation id.

    The first is the earliest by delivery (``arrival``, where there is one), then time. Ids that do not
    repeat stay where they are. Of the others equal rows are counted, and the first is found by an
    aggregate, so a heavily repeated id is never sorted in one task. ``cut`` may write these.
    """
    columns = observations.columns
    order = [c for c in ("arrival", "observed_at") if c in columns]
    whole = F.struct(*order, *[c for c in columns if c not in order])
    several, single = repeated_and_single(observations, "observation_id")
    counted = several.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy(F.col("observation_id").alias("seen_id")).agg(F.min(whole).alias("first"))
    marked = cut(
        counted.join(first, F.col("observation_id").eqNullSafe(F.col("seen_id")))
        .withColumn("is_first", whole.eqNullSafe(F.col("first"))).drop("first", "seen_id"))
    repeats = F.col("copies") - F.col("is_first").cast("bigint")
    return (
        single.unionByName(marked.filter("is_first").select(*columns)),
        marked.filter(repeats > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), repeats))).select(*columns))


def outage_days(observations: DataFrame, outages: DataFrame) -> DataFrame:
    """For each source and day: ``n_outages`` at different times, ``last_at``, the last of them, and
    ``earlier_at``, the last of all days before. Days without any outage up to them are left out."""
    none = F.lit(None).cast("timestamp")
    days = observations.select("source", F.to_date("observed_at").alias("day")).distinct().withColumn("at", none)
    times = outages.select("source", F.to_date("at").alias("day"), "at").filter(F.col("at").isNotNull()).distinct()
    counted = days.unionByName(times).groupBy("source", "day").agg(
        F.count("at").alias("n_outages"), F.max("at").alias("last_at"))
    # One row a day: the days of one source are few enough for a plain window.
    before = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("earlier_at", F.last("last_at", ignorenulls=True).over(before)).filter(
        F.coalesce("last_at", "earlier_at").isNotNull())


def with_outage(
    observations: DataFrame, outages: DataFrame, hot_rows: int = HOT_ROWS,
    cut: Callable[[DataFrame], DataFrame] = held,
) -> DataFrame:
    """Add ``outage_at``, the latest outage of the source up to each observation.

    A small table of sources and days tells it wherever a day has one outage at most, so a source is
    never gathered in one task. Observations of other days run with their outages through an ordered pass
    by source and day. ``cut`` may write the small table, so that its size decides on a broadcast.
    """
    days = cut(outage_days(observations, outages))
    dated = observations.withColumn("day", F.to_date("observed_at")).join(days, ["source", "day"], "left")
    at = F.when(F.col("observed_at") >= F.col("last_at"), F.col("last_at")).otherwise(F.col("earlier_at"))
    crowded = F.coalesce(F.col("n_outages") > 1, F.lit(False))
    columns = [*observations.columns, "outage_at"]
    plain = dated.filter(~crowded).withColumn("outage_at", at).select(*columns)
    if days.filter(crowded).isEmpty():
        return plain
    down = outages.select(
        "source", F.to_date("at").alias("day"), F.col("at").alias("observed_at"),
        F.lit("").alias("observation_id"), F.lit(True).alias("is_outage"),
    ).join(days.filter(crowded).select("source", "day"), ["source", "day"])
    rows = dated.filter(crowded).withColumn("is_outage", F.lit(False)).unionByName(down, allowMissingColumns=True)
    # An outage comes before an observation of the same time: its id is empty.
    swept = running(
        rows, ["source", "day"], ["observed_at", "observation_id"],
        [running_last("that_day", F.when(F.col("is_outage"), F.col("observed_at")))], hot_rows=hot_rows)
    return plain.unionByName(
        swept.filter(~F.col("is_outage")).withColumn("outage_at", F.coalesce("that_day", "earlier_at")).select(*columns))


def is_critical() -> Column:
    """A failed execution, which is reported even in the first batch."""
    return (F.col("source") == "jobs") & (F.col("category") == "execution") & (F.col("status") == "FAIL")


def decide(
    observations: DataFrame, hot_rows: int = HOT_ROWS,
    cut: Callable[[DataFrame], DataFrame] = held, outages: DataFrame | None = None,
) -> DataFrame:
    """Lifecycle decision of every observation, and whether it ``opens`` an episode.

    Needs fingerprint, source, observed_at, observation_id and status. An id that was seen before is a
    DUPLICATE and changes nothing; ``arrival``, where there is one, orders deliveries. ``outages`` (source, at)
    tells when a whole source was unavailable: for all incidents of that source the count of
    consecutive passes starts again. An UNAVAILABLE or UNKNOWN observation changes nothing.
    Two passes since the last active row or outage resolve an open incident. Where a boolean ``baseline``
    is true (``category`` is needed then), rows other than failed executions are BASELINED: active ones open
    an incident without notification, passes do not count. ``cut`` may write an intermediate table.
    """
    columns = observations.columns
    rows, repeats = first_sightings(observations, cut)
    # Written before the ordered pass, which reads its input several times.
    rows = cut(rows.withColumn("outage_at", F.lit(None).cast("timestamp")) if outages is None else with_outage(rows, outages, hot_rows, cut))
    key, order = ["fingerprint"], ["observed_at", "observation_id"]
    status = F.col("status")
    quiet = F.col("baseline") & ~is_critical() if "baseline" in columns else F.lit(False)
    active = status.isin(*ACTIVE)
    passed = (status == "PASS") & ~quiet
    counted = cut(running(
        rows, key, order,
        [running_sum("n_active", active.cast("bigint")),
         running_last_before("effective", F.when(active | passed, F.struct(passed.alias("passed"), "outage_at")))],
        hot_rows=hot_rows))
    # The second pass in a row, with no outage between the two.
    again = passed & F.coalesce(F.col("effective.passed") & F.col("effective.outage_at").eqNullSafe(F.col("outage_at")), F.lit(False))
    # An episode stays resolved from its second consecutive pass to the next active row.
    crossed = F.when(active, F.lit(False)).when(again & (F.col("n_active") > 0), F.lit(True))
    before = running(counted, key, order, [running_last_before("was_resolved", crossed)], hot_rows=hot_rows)
    was = F.coalesce("was_resolved", F.lit(False))
    decision = (
        F.when(quiet, "BASELINED")
        .when(status.isin("UNKNOWN", "UNAVAILABLE"), "INSUFFICIENT_EVIDENCE")
        .when(active & (F.col("n_active") == 1), "NEW")
        .when(active & was, "RECURRING")
        .when(active, "ONGOING")
        .when((F.col("n_active") == 0) | was, "HEALTHY_NO_INCIDENT")
        .when(again, "RESOLVED")
        .otherwise("PENDING_RESOLUTION"))
    decided = before.select(*columns, decision.alias("decision"), (active & ((F.col("n_active") == 1) | (was & ~quiet))).alias("opens"))
    return decided.unionByName(repeats.withColumns({"decision": F.lit("DUPLICATE"), "opens": F.lit(False)}))


def source_outages(observations: DataFrame) -> DataFrame:
    """Times at which a whole source was down: the last observation of its day was UNAVAILABLE."""
    newest = F.max_by("status", F.struct("observed_at", "observation_id"))
    return observations.groupBy("source", F.to_date("observed_at").alias("day")).agg(
        F.max("observed_at").alias("at"), newest.alias("status")
    ).filter(F.col("status") == "UNAVAILABLE").select("source", "at")


def numbered_episodes(decisions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return running(
        decisions.filter(F.col("decision") != "DUPLICATE"), ["fingerprint"], ["observed_at", "observation_id"],
        [running_sum("episode_number", F.col("opens").cast("bigint"))], hot_rows=hot_rows)


def episodes(decisions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per incident episode with counts and times."""
    numbered = numbered_episodes(decisions, hot_rows)
    counts = F.col("opens") | F.col("decision").isin("ONGOING", "PENDING_RESOLUTION", "RESOLVED")
    newest = F.struct("observed_at", "observation_id")
    return (
        numbered.filter((F.col("episode_number") > 0) & counts)
        .groupBy("fingerprint", "episode_number")
        .agg(F.min("observed_at").alias("episode_started_at"),
             F.max("observed_at").alias("last_seen_at"),
             F.max(F.when(F.col("decision") == "RESOLVED", F.col("observed_at"))).alias("resolved_at"),
             F.max_by("status", newest).alias("last_status"),
             F.count(F.lit(1)).alias("observation_count"))
        .withColumn("episode_id", episode_id(F.col("fingerprint"), F.col("episode_number")))
        .withColumn("lifecycle_status",
                    F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise("OPEN"))
    )


def episode_id(digest: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws(":", digest, number.cast("string")), 256)


def notifications(decisions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Outbox rows for new, recurring and resolved episodes; one per episode and event."""
    # Rows that neither open an episode nor are notified change no number.
    told = decisions.filter(F.col("opens") | F.col("decision").isin(*NOTIFIED))
    numbered = numbered_episodes(told.select("fingerprint", "observed_at", "observation_id", "decision", "opens"), hot_rows)
    eid = episode_id(F.col("fingerprint"), F.col("episode_number"))
    return numbered.filter(F.col("decision").isin(*NOTIFIED)).select(
        F.sha2(F.concat_ws(":", eid, "decision"), 256).alias("notification_id"),
        eid.alias("episode_id"), F.col("decision").alias("event_type"), "fingerprint",
        F.col("observed_at").alias("available_at"))


def insert_once(outbox: DataFrame, decided: DataFrame) -> DataFrame:
    """The outbox with the notifications it does not hold yet, as PENDING; those it holds keep their state.

    A batch that is decided again brings the same notification ids and so changes nothing.
    """
    fresh = decided.dropDuplicates(["notification_id"]).withColumns({"status": F.lit("PENDING"), "attempt_count": F.lit(0)})
    return insert_new(outbox, fresh.select(*outbox.columns), ["notification_id"])


def eligible_outbox(outbox: DataFrame, checkpoints: DataFrame, now: Column, limit: int) -> DataFrame:
    """Oldest sendable outbox rows whose checkpoint is committed; ``limit`` is the feature."""
    ready = outbox.filter(
        (F.col("attempt_count") < F.col("max_attempts")) & F.col("committed")
        & (F.col("available_at") <= now)
        & (F.col("status").isin("PENDING", "RETRYABLE")
           | ((F.col("status") == "CLAIMED") & (F.col("lease_expires_at") <= now))))
    # One row a name, small beside the outbox, which so meets it without a shuffle by a few names.
    done = checkpoints.groupBy("checkpoint_name").agg(F.max("snapshot_version").alias("snapshot_version"))
    committed = (F.col("o.checkpoint_name") == F.col("c.checkpoint_name")) & (
        F.col("c.snapshot_version") >= F.col("o.checkpoint_version"))
    return ready.alias("o").join(done.alias("c"), committed, "left_semi").orderBy(
        "available_at", "created_at", "notification_id").limit(limit)


def cursor_scan(runs: DataFrame, completed_at: Column, run_id: int) -> DataFrame:
    """Completed runs strictly after the cursor, oldest first."""
    after = (F.col("end_time") > completed_at) | (
        (F.col("end_time") == completed_at) & (F.col("run_id") > run_id))
    return runs.filter(F.col("end_time").isNotNull() & after).orderBy("end_time", "run_id")


# Ranks of issue states and supported categories.
STATUS_RANK = {"FAIL": 0, "WARN": 1}
CATEGORY_RANK = {"quality": 0, "volume": 1, "freshness": 2}


def issue_topk(issues: DataFrame, k: int = 2) -> DataFrame:
    """Issues ranked by state, category and name; the first ``k`` supported are selected."""
    def rank(column: str, ranks: dict[str, int]) -> Column:
        out = F.lit(99)
        for value, r in ranks.items():
            out = F.when(F.col(column) == value, r).otherwise(out)
        return out

    supported = F.col("category").isin(*CATEGORY_RANK)
    keys = ["status_rank", "category_rank", "check_name", "reference_date"]
    ranked = issues.withColumns({
        "status_rank": rank("status", STATUS_RANK),
        "category_rank": rank("category", CATEGORY_RANK),
    })
    # The k best rows come from a distributed top-k; the mark is joined back.
    best = ranked.filter(supported).orderBy(*[F.col(c).asc_nulls_first() for c in keys]).limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*[F.col(c).asc_nulls_first() for c in keys]))
    marked = best.withColumn("place", place).select(
        "category", "check_name", F.col("reference_date").alias("d"), "place")
    same = (
        (F.col("i.category") == F.col("b.category")) & (F.col("i.check_name") == F.col("b.check_name"))
        & F.col("i.reference_date").eqNullSafe(F.col("b.d")))
    return ranked.alias("i").join(F.broadcast(marked).alias("b"), same, "left").select(
        "i.category", "i.check_name", "i.reference_date", "i.status",
        F.col("b.place").isNotNull().alias("selected"),
        F.when(~F.col("i.category").isin(*CATEGORY_RANK), "unsupported_category")
        .when(F.col("b.place").isNull(), "investigation_limit_reached").otherwise("selected").alias("reason"))


# Actions proposed for every issue (category, priority, approval).
ACTIONS = (("diagnostic", "P1", False), ("proposed_remediation", "P2", True), ("verification", "P3", False))


def issue_actions(issues: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Three action rows per issue; repeated issue names are numbered by date, then status."""
    urgent = (F.col("category") == "execution") | (F.col("status") == "FAIL")
    occurrence = running(
        issues.withColumn("at", F.coalesce(F.col("reference_date").cast("timestamp"),
                                           F.lit("0001-01-01").cast("timestamp"))),
        ["category", "check_name"], ["at", "status"], [running_sum("occurrence", F.lit(1).cast("bigint"))], hot_rows=hot_rows)
    rows = F.array(*[
        F.struct(F.lit(c).alias("action"),
                 (F.when(urgent, "P0").otherwise(p) if c == "diagnostic" else F.lit(p)).alias("priority"),
                 F.lit(a).alias("requires_approval"))
        for c, p, a in ACTIONS])
    return occurrence.select(
        "category", "check_name", "reference_date", "status", "occurrence", F.explode(rows).alias("r")
    ).select("category", "check_name", "reference_date", "status", "occurrence", "r.*")

