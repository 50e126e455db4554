"""Streaming twins of batch operators; each gives the batch result on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import staging, upserts
from tidemark.streaming.tables import KeyedTable, batch_writer, drain


def dedup(
    rows: DataFrame, key: str, path: str, checkpoint: str, partition: str = "physical_partition_date", buckets: int = 256
) -> None:
    """Keep the earliest copy of each row, however late it or its replays come.

    A batch is merged into the buckets of a keyed table its keys fall into. There is no watermark, so no
    row is dropped, and a batch reads a part of the table only.
    """
    table = KeyedTable(rows.sparkSession, path, [key], buckets)
    drain(rows, checkpoint, "append", sink=lambda batch, batch_id: table.merge(
        batch, batch_id, lambda both: staging.dedup_replay(both, key, partition=partition)))


def daily_counts(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Rows per ingestion day. Each batch writes the counts of its own rows, of whatever day;
    ``summed_days`` adds them on read."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        days = batch.groupBy(F.to_date("ingested_at").alias("activity_date"))
        batch_writer(path)(days.agg(F.count(F.lit(1)).alias("row_count")), batch_id)

    drain(rows, checkpoint, "append", sink=apply)


def summed_days(rows: DataFrame) -> DataFrame:
    """Counts per day over all batch folders of ``daily_counts``."""
    return rows.groupBy("activity_date").agg(F.sum("row_count").alias("row_count"))


def late_arrivals(rows: DataFrame, event_at: str, path: str, checkpoint: str) -> None:
    """Running arrival-delay categories, one row."""
    delay = F.unix_micros("ingested_at") - F.unix_micros(event_at)
    days = F.datediff("ingested_at", event_at)
    totals = rows.groupBy(F.lit("all").alias("scope")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(delay < 60_000_000).alias("same_minute"),
        F.count_if(days == 0).alias("same_day"),
        F.count_if(days == 1).alias("next_day"),
        F.count_if(delay > 86_400_000_000).alias("over_one_day"),
    )
    drain(totals, checkpoint, "update", sink=batch_writer(path))


def upsert(
    rows: DataFrame, key: str, path: str, checkpoint: str, version: str = "updated_at",
    landed: str = "ingested_at", buckets: int = 256,
) -> None:
    """Keep the newest version per key of a change stream, in a keyed table.

    The version decides whichever batch brings it; of equal ones the one that landed last.
    """
    table = KeyedTable(rows.sparkSession, path, [key], buckets)
    drain(rows, checkpoint, "append", sink=lambda batch, batch_id: table.merge(
        batch, batch_id, lambda both: upserts.latest_per_key(both, key, (version, landed))))
