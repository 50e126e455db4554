"""Work that must grow no faster than the input."""

import json

from conftest import SF_DIR
from conftest import rows as rows_of
from pyspark.sql import functions as F

from tidemark.functions.columns import may_be_in
from tidemark.operators import defects, incidents
from tidemark.plans.lake import DEFECT_HORIZON, SEED, Lake


def test_observations_use_all_cores_on_one_split(spark):
    lake = Lake(spark, SF_DIR)
    assert lake.table("events").rdd.getNumPartitions() == 1
    assert lake.raw("check_events").rdd.getNumPartitions() > 1


def test_plain_texts_are_not_taken_apart(make):
    texts = ["plain", "end\n", 'a"b', "back\\", "é", "\x7f", "", None]
    got = make([(t,) for t in texts], "t string").select(incidents.json_string(F.col("t")))
    assert [r[0] for r in got.collect()] == [
        '"plain"', '"end\\n"', '"a\\"b"', '"back\\\\"', '"\\u00e9"', '"\\u007f"', '""', None]
    assert "RLIKE" in got._jdf.queryExecution().analyzed().toString()


def test_labels_shuffle_only_rows_to_shift(spark):
    lake = Lake(spark, SF_DIR)
    rows, parent = lake.clean("payments"), lake.clean("purchases")
    every = defects.label(defects.with_parent_time(rows, parent, "purchase_id", "purchase_created_at"),
                          "payments", SEED, DEFECT_HORIZON)
    keep = ["payment_id", "issue", F.when(F.col("issue") == defects.TEMPORAL, F.col("shifted_at")).alias("s")]
    assert rows_of(lake.labelled("payments").select(*keep)) == rows_of(every.select(*keep))
    plan = lake.labelled("payments")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1


def test_repeated_parents_still_multiply(spark):
    lake = Lake(spark, SF_DIR)
    lake._memo["clean.purchases"] = Lake(spark, SF_DIR).clean("purchases").withColumn(
        "x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")
    assert lake.labelled("payments").count() == 2 * lake.clean("payments").count()


def test_records_without_entry_are_settled_by_digest(lake, make):
    ddl = ("payment_id string, purchase_id string, payment_method string, processed_at timestamp,"
           " ingested_at timestamp")
    blank = lake.before_defects("payments").limit(0)

    def table(ids):
        rows = make([(i, "b", m, "2024-01-01", at) for i, m, at in ids], ddl)
        return blank.unionByName(rows, allowMissingColumns=True)

    day, later = "2024-01-01", "2024-01-02"
    clean = table([("same", "A", day), ("lost", "A", day), ("other", "A", day), ("twice", "A", day),
                   ("late", "A", day), ("two", "A", day), ("two", "B", day)])
    dirty = table([("same", "A", day), ("other", "B", day), ("twice", "A", day), ("twice", "A", day),
                   ("late", "A", later), ("two", "A", day), ("new", "A", day), (None, "A", day)])
    log = lake.log("payments").limit(0)
    got = defects.reconcile_settled(clean, dirty, log, "payments")
    want = defects.reconcile(clean, dirty, log, "payments")
    assert rows_of(got) == rows_of(want)
    assert {r.record_id for r in got.collect()} >= {"lost", "other", "twice", "late", "new", None}


def test_bitmap_loses_no_id(spark):
    df = spark.range(20_000).selectExpr("concat('x', id) as id")
    ids = df.filter("id like '%7'")
    got = may_be_in(df, ids)
    assert got.join(ids, "id", "left_semi").count() == 2_000 and got.count() < 2_100


def test_digests_are_computed_once_and_without_lambdas(make):
    runs = make([(1, 9, "FAILED", "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "run_id bigint, job_id bigint, result_state string, start_time timestamp, end_time timestamp")
    tasks = make([(1, "load", "FAILED", "2024-01-01 00:30:00")], "run_id bigint, task_key string, result_state string, end_time timestamp")
    got = incidents.run_observations(runs, tasks)
    # One digest and one id for tasks, and for runs.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 4
    plain = make([("a", "b", " C ", "", None)], "s string, c string, x string, y string, z string")
    digest = incidents.fingerprint(F.col("s"), F.col("c"), [F.col("x"), F.col("y"), F.col("z")])
    got = plain.select(digest.alias("d"), F.sha2(F.lit('"a:b:c"'), 256).alias("want"))
    assert got.first().d == got.first().want
    # The one filter is that of texts which are taken apart.
    assert "isnotnull(lambda" not in got._jdf.queryExecution().analyzed().toString()


def test_every_character_is_kept_or_escaped(make):
    texts = [chr(c) for c in range(1, 0x180)]
    got = make([(t,) for t in texts], "t string").select("t", incidents.json_string(F.col("t")).alias("j"))
    assert all(json.loads(r.j) == r.t and json.dumps(r.t) == r.j for r in got.collect())
    escaped = {r.t for r in got.filter(F.col("t").rlike(incidents.NOT_PLAIN)).collect()}
    assert escaped == {t for t in texts if json.dumps(t) != f'"{t}"'} | {"\x7f"}


def test_a_source_is_never_gathered_for_its_outages(make):
    seen = make([(s, at) for s in ("a", "b", None) for at in (
        "2024-01-01 05:00:00", "2024-01-02 04:59:00", "2024-01-02 05:00:00", "2024-01-02 06:30:00", "2024-01-03 00:00:00",
        "2024-01-05 09:00:00", "2024-01-05 23:00:00", None)], "source string, observed_at timestamp").withColumn(
        "observation_id", F.concat_ws("-", "source", "observed_at"))
    single = [("a", "2024-01-02 05:00:00"), ("a", "2024-01-05 10:00:00"), ("b", "2023-12-30 10:00:00"), (None, "2024-01-01 00:00:00")]
    crowded = [("a", "2024-01-02 06:00:00"), ("a", "2024-01-02 04:00:00"), ("a", "2024-01-02 04:00:00"), ("b", "2024-01-05 08:00:00"), ("b", "2024-01-05 09:00:00")]
    for times in (single, single + crowded, []):
        down = make(times, "source string, at timestamp")
        got = incidents.with_outage(seen, down)
        want = seen.alias("s").join(down.alias("d"), F.expr("d.source = s.source and d.at <= s.observed_at"), "left").groupBy(
            *[F.col(f"s.{c}") for c in seen.columns]).agg(F.max("at").alias("outage_at"))
        assert rows_of(got, *want.columns) == rows_of(want)
        windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert times == single + crowded or not any("observed_at" in x for x in windows)


def test_ids_that_do_not_repeat_are_not_shuffled(make):
    columns = ["observation_id", "observed_at", "arrival"]
    seen = make([("x", "2024-01-01", 1), ("x", "2024-01-02", 0), ("x", "2024-01-02", 0), ("y", "2024-01-01", 0), (None, "2024-01-01", 0), (None, "2024-01-03", 0)],
                "observation_id string, observed_at timestamp, arrival int")
    first, repeats = incidents.first_sightings(seen)
    assert rows_of(first.selectExpr("observation_id", "string(date(observed_at))", "arrival")) == sorted(
        [("x", "2024-01-02", 0), ("y", "2024-01-01", 0), (None, "2024-01-01", 0)], key=repr)
    assert rows_of(repeats.selectExpr("observation_id", "string(date(observed_at))", "arrival")) == sorted(
        [("x", "2024-01-01", 1), ("x", "2024-01-02", 0), (None, "2024-01-03", 0)], key=repr)
    assert first.columns == repeats.columns == columns
    assert "Union" in first._jdf.queryExecution().optimizedPlan().toString()


def test_outbox_meets_checkpoints_without_a_shuffle_by_name(lake):
    got = incidents.eligible_outbox(lake.outbox, lake.outbox_checkpoints, F.lit("2024-01-28").cast("timestamp"), 50)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
