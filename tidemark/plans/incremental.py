"""Incremental facts over daily bronze partitions.

A fact is brought up to date from the rows that arrived, or happened, within a lookback of what it
holds. The bounds are read first and go into the scans as literals; duplicates and parents are
looked up for the rows concerned only; and only the partitions of the fact that change are written.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.lake import Lake
from tidemark.sources import partitions


class FactSource(NamedTuple):
    entity: str
    key: str
    at: str


#: What each fact is made of: entity, key, event time.
FACTS = {
    "fact_conversation": FactSource("conversations", "conversation_id", "created_at"),
    "fact_message": FactSource("messages", "message_id", "created_at"),
    "fact_completion": FactSource("completions", "completion_id", "requested_at"),
    "fact_inference": FactSource("model_inferences", "inference_id", "request_at"),
    "fact_feedback": FactSource("feedback", "feedback_id", "created_at"),
    "fact_error": FactSource("errors", "error_id", "occurred_at"),
    "fact_subscription": FactSource("subscriptions", "subscription_id", "started_at"),
    "fact_purchase": FactSource("purchases", "purchase_id", "purchase_created_at"),
    "fact_payment": FactSource("payments", "payment_id", "processed_at"),
}
#: Parent of an entity that its staging looks up: foreign key and parent entity.
PARENTS = {
    "messages": ("conversation_id", "conversations"), "completions": ("message_id", "messages"),
    "payments": ("purchase_id", "purchases"),
}
#: What facts look up; built once for all of them.
LOOKUPS = ("dim_user", "dim_device", "dim_model", "dim_plan", "dim_date", "disjoint_versions")
PARTITION = "source_partition_date"
LOOKBACK_DAYS = 2


class BronzeLake(Lake):
    """All layers over the partitions that daily loads wrote under ``root``/bronze."""

    def __init__(self, spark: SparkSession, loaded: str, **options: int):
        super().__init__(spark, loaded, **options)
        self.loaded = loaded

    def physical(self, entity: str) -> DataFrame:
        """Rows of an entity, none where nothing was loaded yet."""
        schema, path = schemas.entity_schema(entity), f"{self.loaded}/bronze/{entity}"
        if not partitions.table_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def bronze(self, entity: str) -> DataFrame:
        return self._once(f"bronze.{entity}", lambda: self.physical(entity))


class UpdateLake(BronzeLake):
    """The layers of one fact, held to the ids in ``ids`` by entity; lookups come from ``base``."""

    def __init__(self, base: BronzeLake, ids: dict[str, DataFrame]):
        super().__init__(base.spark, base.loaded, hot_rows=base.hot_rows)
        self.ids = ids
        self._memo |= {f"once.{name}": getattr(base, name) for name in LOOKUPS}

    def bronze(self, entity: str) -> DataFrame:
        rows = self.physical(entity)
        return rows.join(self.ids[entity], schemas.ENTITY_ID[entity], "left_semi") if entity in self.ids else rows


class Bounds(NamedTuple):
    """Newest event and partition of a fact, less the lookback; None where it has none."""

    event: dt.datetime | None
    partition: dt.date | None


def bounds(target: DataFrame, at: str, lookback_days: int = LOOKBACK_DAYS) -> Bounds:
    newest = target.agg(F.max(at).alias("event"), F.max(PARTITION).alias("partition")).first()
    back = dt.timedelta(days=lookback_days)
    return Bounds(*[v - back if v is not None else None for v in newest])


def recent_rows(rows: DataFrame, at: str, low: Bounds, partition: str) -> DataFrame:
    """Rows of recent partitions, and of older ones those of recent events. Two scans, so that the first
    reads recent partitions only and the second skips what its files say is older."""
    if low.partition is None:
        return rows
    event = F.col(at).isNotNull() if low.event is None else F.col(at) >= F.lit(low.event)
    late = F.col(partition) >= F.lit(low.partition)
    return rows.filter(late).unionByName(rows.filter((F.col(partition) < F.lit(low.partition)) & event))


def touched_ids(lake: BronzeLake, fact: str, low: Bounds) -> dict[str, DataFrame]:
    """Ids of the entity that recent rows carry, and of the parents that these rows name, by entity."""
    entity, key, at = FACTS[fact]
    ids = recent_rows(lake.physical(entity), at, low, "dt").select(key).distinct()
    found = {entity: lake.store(f"ids_{fact}_{entity}", ids)}
    while entity in PARENTS:
        foreign, parent = PARENTS[entity]
        rows = lake.physical(entity).join(found[entity], schemas.ENTITY_ID[entity], "left_semi")
        ids = rows.select(F.col(foreign).alias(schemas.ENTITY_ID[parent])).filter(F.col(schemas.ENTITY_ID[parent]).isNotNull()).distinct()
        found[parent] = lake.store(f"ids_{fact}_{parent}", ids)
        entity = parent
    return found


def days_in(column: str, days: list[dt.date | None]) -> Column:
    """Whether a partition is one of ``days``, by literals, so that the scan is pruned."""
    known = [d for d in days if d is not None]
    test = F.col(column).isin(known) if known else F.lit(False)
    return F.coalesce(test, F.lit(False)) | (F.col(column).isNull() if None in days else F.lit(False))


def merge_partitions(spark: SparkSession, path: str, fresh: DataFrame, key: str, scratch: str, partition: str = PARTITION) -> list[dt.date | None]:
    """Upsert ``fresh`` by key into a table partitioned by day; returns the days that were written.

    Only partitions of fresh rows, or of rows they replace, are read and written. The next rows are
    stored under ``scratch`` first, since a table can't be overwritten while it is read. ``fresh`` must be stored.
    """
    if not partitions.table_exists(spark, path):
        fresh.write.partitionBy(partition).parquet(path)
        return sorted((r[0] for r in fresh.select(partition).distinct().collect()), key=repr)
    target = spark.read.parquet(path).select(*fresh.columns)
    keys = fresh.select(key).distinct()
    held = target.select(key, partition).join(keys, key, "left_semi").select(partition)
    days = sorted((r[0] for r in fresh.select(partition).unionByName(held).distinct().collect()), key=repr)
    kept = target.filter(days_in(partition, days)).join(keys, key, "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(scratch)
    rows = spark.read.schema(fresh.schema).parquet(scratch)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[0] for r in rows.select(partition).distinct().collect()}
    partitions.drop_partitions(spark, path, partition, [d for d in days if d not in left])
    return days


def update_fact(base: BronzeLake, fact: str, root: str, lookback_days: int = LOOKBACK_DAYS) -> list[dt.date | None]:
    """Bring one fact under ``root``/facts up to date; returns the partitions that were written."""
    spark, source, path = base.spark, FACTS[fact], f"{root}/facts/{fact}"
    low = Bounds(None, None)
    if partitions.table_exists(spark, path):
        low = bounds(spark.read.parquet(path), source.at, lookback_days)
    lake = UpdateLake(base, {} if low.partition is None else touched_ids(base, fact, low))
    fresh = recent_rows(getattr(lake, fact), source.at, low, PARTITION)
    return merge_partitions(spark, path, lake.store(f"fresh_{fact}", fresh), source.key, f"{lake.root}/next_{fact}")


def update_facts(spark: SparkSession, root: str, facts: tuple[str, ...] = tuple(FACTS), **options: int) -> dict[str, list[dt.date | None]]:
    """All facts after a day's load. Lookups are built once, from all users and their changes."""
    base = BronzeLake(spark, root, **options)
    base.lookups()
    return {fact: update_fact(base, fact, root) for fact in facts}
