"""One day's load, checked before and after; ``incremental`` brings the facts up to date from it.

Everything is checked before anything is written, data goes before its marker, and a
repeated day changes nothing: the daily counts are the marker and are written last.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import history, upserts
from tidemark.operators.monitoring import union_all
from tidemark.sources import partitions


class UpdateError(ValueError):
    """A user update names an unsupported field or an unknown user."""


class MarkerError(RuntimeError):
    """The day's marker does not hold what was loaded."""


class DateSequenceError(ValueError):
    """The run date does not follow the completed days."""


def _counts_path(root: str) -> str:
    return f"{root}/state/daily_counts"


def resolve_mode(spark: SparkSession, root: str, day: date, entities: list[str]) -> str:
    """first, new_day or retry; other sequences are errors."""
    path = _counts_path(root)
    if not partitions.table_exists(spark, path):
        return "first"
    done = spark.read.parquet(path).filter(F.col("entity").isin(*entities))
    latest = done.groupBy("entity").agg(F.max("activity_date").alias("latest")).select(
        F.lit("landed").alias("stream"), "entity", "latest")
    runs = spark.range(1).select(F.lit(day).alias("run_date"))
    mode = upserts.date_sequence(latest, runs).first()["mode"]
    if mode in ("stale", "gap", "inconsistent"):
        raise DateSequenceError(f"{day}: {mode}")
    return mode


def validate_batch(entity: str, batch: DataFrame, day: date) -> DataFrame:
    """The conformed batch; raises when rows belong to another day or ids are missing."""
    fitted = partitions.conform(batch, schemas.entity_schema(entity), F.lit(day))
    key = schemas.ENTITY_ID[entity]
    wrong = F.col(key).isNull()
    if "ingested_at" in fitted.columns:
        wrong = wrong | ~F.to_date("ingested_at").eqNullSafe(F.lit(day))
    bad = fitted.agg(F.count_if(wrong).alias("n")).first()["n"]
    if bad:
        raise partitions.SchemaMismatch(f"{entity}: {bad} rows without id or outside {day}")
    return fitted


def guard_updates(spark: SparkSession, root: str, fitted: dict[str, DataFrame]) -> None:
    """Fail before any write if an update can't be applied: users may come with the same batch."""
    updates = fitted.get("user_updates")
    if updates is None:
        return
    odd = history.unsupported_fields(updates).select("field_name").limit(1).collect()
    if odd:
        raise UpdateError(f"unsupported field_name: {odd[0]['field_name']!r}")
    known = [fitted["users"].select("user_id")] if "users" in fitted else []
    if partitions.table_exists(spark, f"{root}/bronze/users"):
        known.append(spark.read.parquet(f"{root}/bronze/users").select("user_id"))
    users = union_all(known) if known else updates.select("user_id").limit(0)
    unknown = history.unknown_references(updates, users, "user_id").limit(1).collect()
    if unknown:
        raise UpdateError(f"unknown user_id: {unknown[0]['user_id']!r}")


def check_marker(spark: SparkSession, root: str, day: date, loaded: dict[str, int]) -> None:
    """Read the marker again: one row of the day for each entity, with the rows that were loaded."""
    rows = spark.read.parquet(_counts_path(root)).filter(F.col("activity_date") == F.lit(day)).collect()
    if sorted((r["entity"], r["row_count"]) for r in rows) != sorted(loaded.items()):
        raise MarkerError(f"{day}: marker differs from what was loaded")


def run_day(
    spark: SparkSession, root: str, day: date, batches: dict[str, DataFrame]
) -> dict[str, object]:
    """Load one day of physical rows; a completed day is a no-op."""
    entities = [e for e in schemas.ENTITY_ID if e in batches]
    mode = resolve_mode(spark, root, day, entities)
    if mode == "retry":
        return {"status": "ALREADY_COMPLETED", "day": day}
    fitted = {e: validate_batch(e, batches[e], day) for e in entities}
    guard_updates(spark, root, fitted)
    loaded = partitions.append_entities(fitted, f"{root}/bronze")
    marker = union_all([
        spark.range(1).select(F.lit(e).alias("entity"), F.lit(day).alias("activity_date"),
                              F.lit(loaded.get(e, 0)).cast("bigint").alias("row_count"))
        for e in entities])
    marker.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "activity_date").parquet(_counts_path(root))
    check_marker(spark, root, day, {e: loaded.get(e, 0) for e in entities})
    return {"status": "COMPLETED", "day": day, "mode": mode, "rows": loaded}
