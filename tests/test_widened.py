"""Whole-row diff, digest tree, file accounts, dense windows, canonical JSON, insert-once outbox."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import defects, incidents, profiling, upserts, validators
from tidemark.sources import partitions

ROW = "payment_id string, amount double, method string, at timestamp"


def test_diff_finds_a_changed_amount_and_a_lost_copy(make):
    left = make([("a", 1.0, "CARD", "2024-01-01 00:00:00"), ("b", 2.0, None, None), ("b", 2.0, None, None), ("c", 3.0, "X", None)], ROW)
    right = make([("a", 1.01, "CARD", "2024-01-01 00:00:00.000001"), ("b", 2.0, None, None), ("d", 3.0, "X", None), ("c", 3.0, None, None)], ROW)
    assert rows(partitions.fidelity_diff(left, right, "payment_id")) == [
        ("a", 1, 1, "amount,at"), ("b", 1, 0, ""), ("c", 1, 1, "method"), ("d", 0, 1, "")]
    assert partitions.fidelity_diff(left, left.repartition(3), "payment_id").count() == 0


def test_digests_add_up_and_show_where_tables_differ(make):
    ddl = "id string, v double, dt date"
    first = make([("a", 1.5, "2024-01-01"), ("b", 2.5, "2024-01-02"), ("b", 2.5, "2024-01-02"), ("c", None, None)], ddl)
    other = make([("a", 1.5, "2024-01-01"), ("b", 2.5, "2024-01-02"), ("b", 2.6, "2024-01-02"), ("c", None, None)], ddl)
    trees = [{(r.level, r.table_name, r.part): (r.rows, r.digest) for r in partitions.digest_tree({"t": d, "u": first.drop("dt")}).collect()} for d in (first, other)]
    assert {k for k in trees[0] if trees[0][k] != trees[1][k]} == {(0, "t", "2024-01-02"), (1, "t", "*"), (3, "*", "*")}
    leaves = [v for (level, table, _), v in trees[0].items() if level == 0 and table == "t"]
    assert trees[0][1, "t", "*"] == (sum(n for n, _ in leaves), str(sum(int(d) for _, d in leaves)))


def test_files_are_accounted_for(spark, make, tmp_path):
    for n, ids in enumerate((["a", "b"], ["c"])):
        make([(i,) for i in ids], "id string").coalesce(1).write.parquet(f"{tmp_path}/t/part={n}")
    found = partitions.file_accounting({"t": spark.read.parquet(f"{tmp_path}/t")})
    assert sorted(r["rows"] for r in found.collect()) == [1, 2] and found.agg(F.min("bytes")).first()[0] > 0
    short = found.withColumn("rows", F.when(F.col("rows") == 2, 1).otherwise(F.col("rows")).cast("bigint"))
    assert [(r.source_rows, r.loaded_rows) for r in partitions.file_reconciliation(found, short).collect()] == [(2, 1)]
    assert rows(profiling.storage_bytes({"t": f"{tmp_path}/t"}, spark)) == [(1, 1)]


def test_entities_without_rows_are_incomplete(make):
    run = F.lit("2024-01-30").cast("date")
    counts = make([("a", str(dt.date(2024, 1, 1) + dt.timedelta(days=i)), 30) for i in range(30)] + [("b", "2024-01-30", 7)],
                  "entity string, activity_date date, row_count bigint")
    got = upserts.window_completeness(counts, run, ("a", "b", "c"))
    assert rows(got, "entity", "days", "rows", "missing_days", "complete") == [("a", 30, 30, 0, True), ("b", 1, 1, 29, False), ("c", 0, 0, 30, False)]
    assert rows(upserts.volume_report(counts, run, ("a", "b", "c"))) == [("a", 30.0, 30.0), ("b", 1.0, 7 / 30), ("c", 0.0, 0.0)]


@pytest.mark.parametrize("text", ['a"b\\c', "é日\U0001f600", "\n\r\t\b\f\x01\x7f", "", "plain:text"])
def test_identity_text_is_canonical_json(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(incidents.json_string(F.col("t"))).first()[0] == json.dumps(text)
    got = df.select(incidents.json_object({"run_id": F.lit("7"), "a": incidents.json_string(F.col("t")), "n": F.lit(None).cast("string")})).first()[0]
    assert got == json.dumps({"run_id": 7, "a": text, "n": None}, sort_keys=True, separators=(",", ":"))


def test_two_attempts_of_a_task_are_one_observation(make):
    runs = make([(1, 9, "FAILED", "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "run_id bigint, job_id bigint, result_state string, start_time timestamp, end_time timestamp")
    tasks = make([(1, "load", n, "FAILED", "2024-01-01 00:30:00") for n in (0, 1)], "run_id bigint, task_key string, attempt int, result_state string, end_time timestamp")
    ids = [r.observation_id for r in incidents.run_observations(runs, tasks).collect()]
    assert len(ids) == 2 and len(set(ids)) == 1


def test_the_outbox_takes_a_notification_once(make):
    held = make([("n1", "SENT", 2)], "notification_id string, status string, attempt_count int")
    decided = make([("n1",), ("n2",), ("n2",)], "notification_id string")
    once = incidents.insert_once(held, decided)
    assert rows(once) == [("n1", "SENT", 2), ("n2", "PENDING", 0)]
    assert rows(incidents.insert_once(once, decided)) == rows(once)


def test_ten_thousand_outages_of_one_source(make, spark):
    seen = spark.range(200).selectExpr(
        "'f' as fingerprint", "'s' as source", "timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id * 500 + 0.5) as observed_at",
        "lpad(string(id), 5, '0') as observation_id", "if(id = 0, 'WARN', 'PASS') as status")
    down = spark.range(10_000).selectExpr("'s' as source", "timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id * 10) as at")
    got = incidents.decide(seen, outages=down)
    assert {r.decision for r in got.collect()} == {"NEW", "PENDING_RESOLUTION"}
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_reconciliation_joins_nothing(lake):
    df = defects.reconcile(lake.before_defects("payments"), lake.damaged_dirty("payments"), lake.log("payments"), "payments")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text.replace("AdaptiveSparkPlan", "") and text.count("Exchange hashpartitioning(id") <= 2


def test_cancelling_errors_of_two_entities_show(lake, spark):
    clean = {e: lake.clean(e) for e in ("users", "payments")}
    dirty = {"users": clean["users"].unionByName(clean["users"].limit(3)), "payments": clean["payments"].limit(clean["payments"].count() - 3)}
    log = lake.defect_log.limit(0)
    storage = spark.createDataFrame([(1, 1)], "stored_tables bigint, bytes_met bigint")
    got = {r.check_name: r.status for r in profiling.profile_checks(log, clean, dirty, lake.json_lines.limit(0), storage).collect()}
    assert got["bronze_clean_duplicate_delta"] == "FAIL" and got["storage_byte_reconciliation"] == "PASS"


def test_bands_of_counts_with_their_own_total(make):
    measured = make([("a", "x", 98, 100), ("b", "y", 1, None), ("b", "z", 3, None)], "metric string, value string, n bigint, total bigint")
    got = validators.ratio_bands(measured, [("a", "x", 0.98, 0.99), ("b", "y", 0.5, 1.0), ("b", "w", 0.0, 0.1)])
    assert rows(got, "metric", "value", "n", "total", "within") == [("a", "x", 98, 100, True), ("b", "w", 0, 4, True), ("b", "y", 1, 4, False)]
