"""Time the headline queries, in pipeline order, on one fresh lake; prints one JSON line.

Each time includes the tables a query is the first to need, so the sum is the time from
the given tables to every headline result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dedup_replay", "stg_payments", "user_state_history", "dim_user", "fact_message",
    "fact_payment", "gold_product", "gold_user_activity", "gold_ml", "gold_finance",
    "dq_volume", "dq_quality", "dq_reconciliation", "chk_fact_keys", "val_payments",
    "purchase_status_check", "late_arrivals", "manifest_reconcile", "field_profile",
    "redact_secrets", "incident_decisions", "incident_episodes", "stream_incidents",
)


def main() -> None:
    from tidemark import session
    from tidemark.catalog import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    catalog, times = load(), {}
    for key in HEADLINE:
        start = time.perf_counter()
        catalog[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
