"""User history: current state, change replay, snapshots and the hybrid dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import differs, surrogate_key
from tidemark.functions.ordered import HOT_ROWS, leading, position, running, running_last

VERSIONED_FIELDS = ("country_code", "account_status")


def latest_updates(updates: DataFrame, fields: Sequence[str] = schemas.UPDATE_FIELDS) -> DataFrame:
    """One row per user with the newest value struct of each field and update times.

    A single aggregate with map-side combine; ``last_<field>`` is null when the user
    never changed the field, and a struct holding a null when the newest value is null.
    """
    newest = F.struct("updated_at", "update_id")
    return updates.groupBy("user_id").agg(
        *[
            F.max_by(
                F.struct(F.col("new_value").alias("value")),
                F.when(F.col("field_name") == f, newest),
            ).alias(f"last_{f}")
            for f in fields
        ],
        F.max("updated_at").alias("latest_user_update_at"),
        F.max("ingested_at").alias("latest_update_ingested_at"),
    )


def _overlaid(field: str) -> Column:
    last = F.col(f"last_{field}")
    return F.when(last.isNotNull(), last["value"]).otherwise(F.col(field)).alias(field)


def current_user_state(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Signup attributes overlaid with each field's newest update, null values included."""
    return users.join(latest_updates(updates), "user_id", "left").select(
        "user_id",
        *[_overlaid(f) for f in schemas.UPDATE_FIELDS],
        "signup_at",
        "signup_source",
        F.col("ingested_at").alias("source_user_ingested_at"),
        F.col("physical_partition_date").alias("source_user_partition_date"),
        "latest_user_update_at",
        "latest_update_ingested_at",
    )


def effective_changes(updates: DataFrame) -> DataFrame:
    """Updates of versioned fields that really change the value."""
    return updates.filter(
        F.col("field_name").isin(*VERSIONED_FIELDS) & differs(F.col("old_value"), F.col("new_value"))
    )


def state_events(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Signup rows and change rows, one sparse column per versioned attribute."""
    signups = users.select(
        "user_id",
        F.col("signup_at").alias("effective_start_at"),
        F.lit(None).cast("string").alias("version_update_id"),
        F.lit(None).cast("string").alias("type2_change_field"),
        *[F.col(f).alias(f"{f}_value") for f in VERSIONED_FIELDS],
    )
    changes = effective_changes(updates).select(
        "user_id",
        F.col("updated_at").alias("effective_start_at"),
        F.col("update_id").alias("version_update_id"),
        F.col("field_name").alias("type2_change_field"),
        *[
            F.when(F.col("field_name") == f, F.col("new_value")).alias(f"{f}_value")
            for f in VERSIONED_FIELDS
        ],
    )
    return signups.unionByName(changes)


def versions(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Carry attributes forward, number the versions and close each at the next start."""
    ordered = events.withColumn("__tie", F.coalesce("version_update_id", F.lit("")))
    return running(
        ordered,
        ["user_id"],
        ["effective_start_at", "__tie"],
        [
            *[running_last(f, F.col(f"{f}_value")) for f in VERSIONED_FIELDS],
            position("version_sequence"),
            leading("effective_end_at", F.col("effective_start_at")),
        ],
        hot_rows=hot_rows,
    ).drop("__tie", *[f"{f}_value" for f in VERSIONED_FIELDS])


def user_state_history(users: DataFrame, updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versioned history with overwritten (Type 1) and fixed (Type 0) attributes attached."""
    overlay = users.join(
        latest_updates(updates, ("email", "name")), "user_id", "left"
    ).select(
        "user_id",
        _overlaid("email"),
        _overlaid("name"),
        "signup_source",
        "signup_at",
        F.col("ingested_at").alias("source_user_ingested_at"),
        F.col("physical_partition_date").alias("source_user_partition_date"),
    )
    return (
        versions(state_events(users, updates), hot_rows)
        .join(overlay, "user_id", "inner")
        .select(
            "user_id",
            "version_sequence",
            "email",
            "name",
            "country_code",
            "account_status",
            "signup_source",
            "signup_at",
            "source_user_ingested_at",
            "source_user_partition_date",
            "version_update_id",
            "type2_change_field",
            "effective_start_at",
            "effective_end_at",
            F.col("effective_end_at").isNull().alias("is_current"),
        )
    )


def scd2_snapshot(
    previous: DataFrame | None,
    current: DataFrame,
    run_at: Column,
    key: str = "user_id",
    check: Sequence[str] = VERSIONED_FIELDS,
) -> DataFrame:
    """Next state of a check-strategy snapshot.

    Open rows whose checked columns changed are closed at ``run_at`` and reopened with
    the new values; unseen keys are opened; keys missing from ``current`` stay open.
    """
    meta = ("dbt_scd_id", "dbt_updated_at", "dbt_valid_from", "dbt_valid_to")
    cols = current.columns

    def opened(df: DataFrame) -> DataFrame:
        return df.select(
            *cols,
            surrogate_key(F.col(key), run_at).alias("dbt_scd_id"),
            run_at.alias("dbt_updated_at"),
            run_at.alias("dbt_valid_from"),
            F.lit(None).cast("timestamp").alias("dbt_valid_to"),
        )

    if previous is None:
        return opened(current)

    closed = previous.filter(F.col("dbt_valid_to").isNotNull())
    live = previous.filter(F.col("dbt_valid_to").isNull())
    now = current.select(F.struct(*cols).alias("now"), F.col(key).alias("__key"))
    paired = live.select(F.struct(*cols, *meta).alias("was")).join(
        now, F.col(f"was.{key}") == F.col("__key"), "full"
    )
    changed = F.lit(False)
    for c in check:
        changed = changed | differs(F.col(f"was.{c}"), F.col(f"now.{c}"))
    is_new = F.col("was").isNull()
    is_changed = ~is_new & F.col("now").isNotNull() & changed
    stamped = paired.select("was", "now", is_new.alias("n"), is_changed.alias("c"))

    def row(source: str, *tail: Column) -> Column:
        return F.struct(*[F.col(f"{source}.{c}").alias(c) for c in cols], *tail)

    fresh = row(
        "now",
        surrogate_key(F.col(f"now.{key}"), run_at).alias("dbt_scd_id"),
        run_at.alias("dbt_updated_at"),
        run_at.alias("dbt_valid_from"),
        F.lit(None).cast("timestamp").alias("dbt_valid_to"),
    )
    kept = row(
        "was",
        F.col("was.dbt_scd_id").alias("dbt_scd_id"),
        F.col("was.dbt_updated_at").alias("dbt_updated_at"),
        F.col("was.dbt_valid_from").alias("dbt_valid_from"),
        F.when(F.col("c"), run_at).alias("dbt_valid_to"),
    )
    emitted = F.array_compact(
        F.array(F.when(~F.col("n"), kept), F.when(F.col("n") | F.col("c"), fresh))
    )
    moved = stamped.select(F.explode(emitted).alias("r")).select("r.*")
    return closed.select(*cols, *meta).unionByName(moved)


def dim_user(history: DataFrame, snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Reconstructed history before each user's first snapshot, snapshot rows after it."""
    boundary = snapshot.groupBy("user_id").agg(F.min("dbt_valid_from").alias("snapshot_start_at"))
    fixed = current.select("user_id", "signup_at", "signup_source")
    start, end, cut = (
        F.col("effective_start_at"), F.col("effective_end_at"), F.col("snapshot_start_at"),
    )
    bootstrap = (
        history.select(
            "user_id", "country_code", "account_status", "effective_start_at", "effective_end_at"
        )
        .join(boundary, "user_id")
        .filter(start < cut)
        .withColumn("effective_end_at", F.when(end.isNull() | (end > cut), cut).otherwise(end))
        .drop("snapshot_start_at")
        .withColumn("version_source", F.lit("historical_bootstrap"))
    )
    observed = snapshot.select(
        "user_id",
        "country_code",
        "account_status",
        F.col("dbt_valid_from").alias("effective_start_at"),
        F.col("dbt_valid_to").alias("effective_end_at"),
        F.lit("dbt_snapshot").alias("version_source"),
    )
    return bootstrap.unionByName(observed).join(fixed, "user_id").select(
        surrogate_key("user_id", "effective_start_at").alias("user_key"),
        "user_id",
        "country_code",
        "account_status",
        "signup_at",
        "signup_source",
        "effective_start_at",
        "effective_end_at",
        F.col("effective_end_at").isNull().alias("is_current"),
        "version_source",
    )


def dim_user_sensitive(users: DataFrame, current: DataFrame) -> DataFrame:
    """Personal attributes apart from the safe dimension, one row per version key."""
    return users.select("user_key", "user_id").join(
        current.select("user_id", "email", "name"), "user_id"
    ).select("user_key", "user_id", "email", "name")


def closed_times(users: DataFrame, updates: DataFrame) -> DataFrame:
    """When each account closed for good: at signup if born closed, else first CLOSED update."""
    first = (
        updates.filter((F.col("field_name") == "account_status") & (F.col("new_value") == "CLOSED"))
        .groupBy("user_id")
        .agg(F.min("updated_at").alias("first_closed_at"))
    )
    born = F.when(F.col("account_status") == "CLOSED", F.col("signup_at"))
    return (
        users.join(first, "user_id", "left")
        .select("user_id", F.coalesce(born, "first_closed_at").alias("closed_at"))
        .filter(F.col("closed_at").isNotNull())
    )


def update_patch(updates: DataFrame) -> DataFrame:
    """One patch per user: newest value of each changed field and which fields changed."""
    latest = latest_updates(updates)
    changed = F.array_compact(
        F.array(
            *[F.when(F.col(f"last_{f}").isNotNull(), F.lit(f)) for f in schemas.UPDATE_FIELDS]
        )
    )
    return latest.select(
        "user_id",
        *[F.col(f"last_{f}")["value"].alias(f) for f in schemas.UPDATE_FIELDS],
        changed.alias("changed_fields"),
    )


def apply_patch(state: DataFrame, patch: DataFrame) -> DataFrame:
    """New state rows of the patched users; a null patch value overwrites."""
    new = patch.select(
        "user_id", "changed_fields", *[F.col(f).alias(f"__{f}") for f in schemas.UPDATE_FIELDS]
    )
    return state.join(new, "user_id").select(
        "user_id",
        *[
            F.when(F.array_contains("changed_fields", f), F.col(f"__{f}"))
            .otherwise(F.col(f))
            .alias(f)
            for f in schemas.UPDATE_FIELDS
        ],
    )


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that are absent from ``known``; a null key is."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def unsupported_fields(updates: DataFrame) -> DataFrame:
    """Updates of fields that are no part of a user's state."""
    field = F.col("field_name")
    return updates.filter(field.isNull() | ~field.isin(*schemas.UPDATE_FIELDS))


def state_by_pivot(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Current state where a null newest value falls back to the signup value."""
    latest = latest_updates(updates)
    return users.join(latest, "user_id", "left").select(
        "user_id",
        *[
            F.coalesce(F.col(f"last_{f}")["value"], F.col(f)).alias(f)
            for f in schemas.UPDATE_FIELDS
        ],
    )
