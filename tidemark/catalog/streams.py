"""Streaming twins over the given tables: two arrivals, a restart between them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import staging
from tidemark.streaming import incident_state, twins
from tidemark.streaming.tables import KeyedTable, newest_per_key, read_batches, read_files

_MIDDLE = "2024-01-16 00:00:00"


def _two_arrivals(k, rows, at: str, run) -> str:
    """Let the first half arrive, drain, let the second half arrive, drain from the checkpoint."""
    root = f"{k.root}/stream_{uuid.uuid4().hex}"
    middle = F.lit(_MIDDLE).cast("timestamp")
    for half in (F.col(at) < middle, F.col(at) >= middle):
        rows.filter(half).write.mode("append").parquet(f"{root}/in")
        run(read_files(k.spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/checkpoint")
    return f"{root}/out"


def _dedup(k):
    rows = staging.typed(k.bronze("messages"), "messages")
    out = _two_arrivals(k, rows, "ingested_at", lambda s, o, c: twins.dedup(s, "message_id", o, c, buckets=16))
    return KeyedTable(k.spark, out, ["message_id"], 16).read()


query("stream_dedup", "message_id conversation_id user_id device_id sequence_number:i message_text"
      " created_at:t", _dedup, "select * from d_messages")


def _daily(k):
    out = _two_arrivals(k, k.bronze("messages").select("message_id", "ingested_at"), "ingested_at",
                        lambda s, o, c: twins.daily_counts(s, o, c))
    return twins.summed_days(read_batches(k.spark, out))


query("stream_daily_counts", "activity_date:t row_count:i", _daily,
      "select dt as activity_date, count(*) as row_count from b_messages group by 1")


def _late(k):
    out = _two_arrivals(k, k.bronze("messages").select("created_at", "ingested_at"), "ingested_at",
                        lambda s, o, c: twins.late_arrivals(s, "created_at", o, c))
    return newest_per_key(read_batches(k.spark, out), ["scope"])


query("stream_late_arrivals", "total:i same_minute:i same_day:i next_day:i over_one_day:i", _late, """
      select count(*) as total,
             count(*) filter (where epoch_us(ingested_at) - epoch_us(created_at) < 60000000)
                 as same_minute,
             count(*) filter (where cast(ingested_at as date) = cast(created_at as date)) as same_day,
             count(*) filter (where cast(ingested_at as date) = cast(created_at as date) + 1)
                 as next_day,
             count(*) filter (where epoch_us(ingested_at) - epoch_us(created_at) > 86400000000)
                 as over_one_day from b_messages""")


def _upsert(k):
    rows = k.bronze("subscriptions").drop("dt", "actual_monthly_price")
    out = _two_arrivals(k, rows, "ingested_at",
                        lambda s, o, c: twins.upsert(s, "subscription_id", o, c, buckets=16))
    return KeyedTable(k.spark, out, ["subscription_id"], 16).read()


query("stream_upsert",
      "subscription_id user_id plan_id started_at:t ended_at:t subscription_status updated_at:t",
      _upsert, """
      select * from (select *, row_number() over (partition by subscription_id
                 order by updated_at desc, ingested_at desc) as rn from b_subscriptions) s
      where rn = 1""")


def _incidents(k):
    """Observations, repeats ten days after their first delivery, and outages, as one stream."""
    columns = [*incident_state.EVENT, "delivered_at"]
    delivered = F.col("observed_at") + F.make_dt_interval(days=10 * F.col("arrival"))
    down = incident_state.outage_events(k.outages).withColumn("delivered_at", F.col("observed_at"))
    events = k.baseline_observations.withColumn("delivered_at", delivered).select(*columns).unionByName(down)
    out = _two_arrivals(k, events, "delivered_at", lambda s, o, c: incident_state.incident_decisions(s, o, c, lanes=8))
    return k.spark.read.parquet(out)


query("stream_incidents", "observation_id fingerprint observed_at:t status decision opens:b", _incidents,
      "select * from folded_decisions")
