"""Edge cases of cleaning, history, monitoring, upserts and incidents."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import defects, history, incidents, marts, monitoring, profiling, staging, upserts
from tidemark.plans.lake import at

UPD = ("update_id string, user_id string, field_name string, old_value string, new_value string,"
       " updated_at timestamp, ingested_at timestamp")
USR = ("user_id string, email string, name string, country_code string, account_status string,"
       " signup_source string, signup_at timestamp, ingested_at timestamp,"
       " physical_partition_date date")
USER = ("u", "e", "n", "US", "ACTIVE", "WEB", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01")


def test_replay_keeps_earliest_and_nulls_last(make):
    df = make([("a", "x", "2024-01-02 00:00:00", "2024-01-03"), ("a", "y", "2024-01-02 00:00:00", "2024-01-02"),
               ("a", "z", None, "2024-01-01"), ("b", "only", None, None)],
              "id string, v string, ingested_at timestamp, physical_partition_date date")
    assert rows(staging.dedup_replay(df, "id"), "id", "v") == [("a", "y"), ("b", "only")]


def test_latest_snapshot(make):
    df = make([("a", 1, "2024-01-01"), ("a", 2, "2024-01-05"), ("a", 3, None)],
              "id string, v int, physical_partition_date date")
    assert rows(staging.dedup_latest(df, "id"), "v") == [(2,)]


def test_equal_time_updates_and_null_values(make):
    users = make([USER], USR)
    updates = make([
        ("1", "u", "name", "n", "first", "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
        ("2", "u", "name", "n", "second", "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
        ("3", "u", "email", "e", None, "2024-01-03 00:00:00", "2024-01-03 00:00:00"),
    ], UPD)
    # A null update wins in the current state and falls back in the pivoted state.
    assert rows(history.current_user_state(users, updates), "name", "email") == [("second", None)]
    assert rows(history.state_by_pivot(users, updates), "name", "email") == [("second", "e")]
    patched = history.apply_patch(users, history.update_patch(updates))
    assert rows(patched, "name", "email", "country_code") == [("second", None, "US")]


def test_history_ignores_no_op_and_carries_forward(make):
    users = make([USER], USR)
    updates = make([
        ("1", "u", "country_code", "US", "US", "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
        ("2", "u", "country_code", "US", "BR", "2024-01-03 00:00:00", "2024-01-03 00:00:00"),
        ("3", "u", "account_status", "ACTIVE", "CLOSED", "2024-01-04 00:00:00", "2024-01-04 00:00:00"),
    ], UPD)
    got = history.user_state_history(users, updates)
    assert rows(got, "version_sequence", "country_code", "account_status", "is_current") == [
        (1, "US", "ACTIVE", False), (2, "BR", "ACTIVE", False), (3, "BR", "CLOSED", True)]
    assert rows(history.closed_times(users, updates).select(F.col("closed_at").cast("string"))) == [
        ("2024-01-04 00:00:00",)]


def test_snapshot_reruns(make):
    def state(country, *ids):
        return make([(i, country) for i in ids], "user_id string, country_code string")

    snap = None
    for country, run, ids in (("US", "2024-01-01 00:00:00", "ab"), ("US", "2024-01-02 00:00:00", "ab"),
                              ("BR", "2024-01-03 00:00:00", "ab"), ("US", "2024-01-04 00:00:00", "a")):
        snap = history.scd2_snapshot(snap, state(country, *ids), at(run), check=("country_code",))
    got = rows(snap.select("user_id", "country_code", F.col("dbt_valid_from").cast("string").alias("f"),
                           F.col("dbt_valid_to").cast("string").alias("t")))
    day = "2024-01-0{} 00:00:00".format
    assert got == sorted([("a", "US", day(1), day(3)), ("a", "BR", day(3), day(4)), ("a", "US", day(4), None),
                          ("b", "US", day(1), day(3)), ("b", "BR", day(3), None)], key=repr)


def test_volume_baselines(make, spark):
    from tidemark.operators.monitoring import MONITORED, volume

    days = [f"2024-01-{d:02d}" for d in range(1, 12)]
    dates = make([(int(d.replace("-", "")), d) for d in days], "date_key int, full_date date")
    # One row on the first day, none for a week, then one row: baseline null, zero, above zero.
    keys = [20240101, 20240109, 20240110]
    one = make([(k,) for k in keys], "date_key int")
    none = make([], "date_key int")
    facts = {e: (one if e == "messages" else none) for e in MONITORED}
    got = volume(facts, dates).filter(F.col("entity_name") == "messages")
    by_day = {r["date_key"]: (r["rolling_7_day_average"], r["volume_status"]) for r in got.collect()}
    assert by_day[20240101] == (None, "PASS")
    assert by_day[20240108] == (1 / 7, "WARN")
    assert by_day[20240109] == (0.0, "WARN")
    assert by_day[20240107][1] == "WARN"


@pytest.mark.parametrize("last,run,mode", [
    (("2024-01-05", "2024-01-05"), "2024-01-05", "retry"),
    (("2024-01-05", "2024-01-05"), "2024-01-06", "new_day"),
    (("2024-01-05", "2024-01-05"), "2024-01-08", "gap"),
    (("2024-01-05", "2024-01-05"), "2024-01-01", "stale"),
    (("2024-01-05", "2024-01-04"), "2024-01-06", "inconsistent"),
    (("2024-01-05", None), "2024-01-06", "inconsistent"),
])
def test_date_sequence(make, last, run, mode):
    latest = make([("s", "a", last[0]), ("s", "b", last[1])], "stream string, entity string, latest date")
    assert rows(upserts.date_sequence(latest, make([(run,)], "run_date date")), "mode") == [(mode,)]


def test_merges(make):
    ddl = "id string, v string, updated_at timestamp"
    target = make([("a", "old", "2024-01-02 00:00:00"), ("b", "old", "2024-01-02 00:00:00"),
                   ("c", "old", "2024-01-02 00:00:00")], ddl)
    source = make([("a", "new", "2024-01-02 00:00:00"), ("b", "new", "2024-01-03 00:00:00"),
                   ("d", "new", "2024-01-01 00:00:00")], ddl)
    assert rows(upserts.merge_newer(target, source, ["id"]), "id", "v") == [
        ("a", "old"), ("b", "new"), ("c", "old"), ("d", "new")]
    assert rows(upserts.merge_upsert(target, source, ["id"]), "id", "v") == [
        ("a", "new"), ("b", "new"), ("c", "old"), ("d", "new")]
    assert rows(upserts.merge_update_only(target, source, ["id"]), "id", "v") == [
        ("a", "new"), ("b", "new"), ("c", "old")]
    assert rows(upserts.insert_new(target, source, ["id"]), "id", "v") == [
        ("a", "old"), ("b", "old"), ("c", "old"), ("d", "new")]


def _observed(make, statuses):
    """Observations of one fingerprint, and the outages of its source and of another one."""
    rows = [("f", "s", f"2024-01-01 00:{i:02d}:00", f"o{i:02d}", s) for i, s in enumerate(statuses)]
    seen = make([r for r in rows if "DOWN" not in r[4]],
                "fingerprint string, source string, observed_at timestamp, observation_id string, status string")
    down = make([("s" if r[4] == "DOWN" else "other", r[2]) for r in rows if "DOWN" in r[4]] or [("none", rows[0][2])],
                "source string, at timestamp")
    return seen, down


@pytest.mark.parametrize("hot_rows", [2, 1000])
@pytest.mark.parametrize("statuses,want", [
    ("WARN PASS PASS WARN", "NEW PENDING_RESOLUTION RESOLVED RECURRING"),
    ("WARN PASS DOWN PASS PASS", "NEW PENDING_RESOLUTION PENDING_RESOLUTION RESOLVED"),
    ("WARN PASS OTHER_DOWN PASS", "NEW PENDING_RESOLUTION RESOLVED"),
    ("WARN PASS UNAVAILABLE PASS", "NEW PENDING_RESOLUTION INSUFFICIENT_EVIDENCE RESOLVED"),
    ("DOWN WARN PASS DOWN UNKNOWN PASS DOWN DOWN WARN PASS PASS",
     "NEW PENDING_RESOLUTION INSUFFICIENT_EVIDENCE PENDING_RESOLUTION ONGOING PENDING_RESOLUTION RESOLVED"),
    ("PASS FAIL UNKNOWN PASS FAIL PASS PASS PASS DOWN PASS PASS WARN",
     "HEALTHY_NO_INCIDENT NEW INSUFFICIENT_EVIDENCE PENDING_RESOLUTION ONGOING PENDING_RESOLUTION RESOLVED"
     " HEALTHY_NO_INCIDENT HEALTHY_NO_INCIDENT HEALTHY_NO_INCIDENT RECURRING"),
])
def test_lifecycle(make, statuses, want, hot_rows):
    seen, down = _observed(make, statuses.split())
    got = incidents.decide(seen, hot_rows=hot_rows, outages=down)
    by_id = dict(rows(got, "observation_id", "decision"))
    assert [by_id[k] for k in sorted(by_id)] == want.split()


OBSERVED = ("source string, category string, status string, fingerprint string, observed_at timestamp,"
            " observation_id string, arrival int, baseline boolean")


def test_duplicates_change_nothing(make):
    seen = make([("o", "q", "WARN", "f", "2024-01-01 00:00:00", "1", 0, False), ("o", "q", "PASS", "f", "2024-01-02 00:00:00", "2", 0, False)]
                + [("o", "q", "PASS", "f", "2024-01-02 00:00:00", "2", n, False) for n in (1, 2, 2, 2)]
                + [("o", "q", "PASS", "f", "2024-01-01 12:00:00", "2", 3, False), ("o", "q", "FAIL", "f", "2024-01-03 00:00:00", "3", 0, False)], OBSERVED)
    assert rows(incidents.decide(seen), "observation_id", "arrival", "decision") == sorted(
        [("1", 0, "NEW"), ("2", 0, "PENDING_RESOLUTION"), ("3", 0, "ONGOING"), *[("2", n, "DUPLICATE") for n in (1, 2, 2, 2, 3)]], key=repr)


def test_baseline_hands_its_incidents_over(make):
    first = make([("jobs", "execution", "FAIL", "f", "2024-01-01 00:00:00", "1", 0, True),
                  ("jobs", "execution", "FAIL", "f", "2024-01-01 00:01:00", "2", 0, True),
                  ("o", "volume", "FAIL", "g", "2024-01-01 00:00:00", "3", 0, True),
                  ("o", "volume", "PASS", "g", "2024-01-01 00:01:00", "4", 0, True),
                  ("o", "volume", "PASS", "g", "2024-01-02 00:00:00", "5", 0, False),
                  ("o", "volume", "WARN", "g", "2024-01-02 00:01:00", "6", 0, False),
                  ("o", "volume", "PASS", "h", "2024-01-01 00:00:00", "7", 0, True),
                  ("o", "volume", "WARN", "h", "2024-01-02 00:00:00", "8", 0, False)], OBSERVED)
    got = incidents.decide(first)
    assert rows(got, "observation_id", "decision", "opens") == [
        ("1", "NEW", True), ("2", "ONGOING", False), ("3", "BASELINED", True), ("4", "BASELINED", False),
        ("5", "PENDING_RESOLUTION", False), ("6", "ONGOING", False), ("7", "BASELINED", False), ("8", "NEW", True)]
    assert rows(incidents.episodes(got), "fingerprint", "episode_number", "observation_count") == [("f", 1, 2), ("g", 1, 3), ("h", 1, 1)]
    assert rows(incidents.notifications(got), "fingerprint", "event_type") == [("f", "NEW"), ("h", "NEW")]


def test_status_names(make):
    df = make([("success",), ("Warning",), ("TIMED_OUT",), ("unavailable",), (None,), ("odd",)], "s string")
    got = df.select(monitoring.normalise_status(F.col("s")).alias("n"))
    assert [r["n"] for r in got.collect()] == ["PASS", "WARN", "FAIL", "UNAVAILABLE", "UNKNOWN", "UNKNOWN"]


def test_combined_status_precedence(make):
    cases = [(None, None, None, "UNAVAILABLE"), ("FAIL", None, None, "FAIL"), ("PASS", None, None, "PARTIAL"),
             ("PASS", "WARN", "CURRENT", "WARN"), ("PASS", "PASS", "STALE", "WARN"),
             ("PASS", "UNKNOWN", "CURRENT", "UNKNOWN"), ("RUNNING", "PASS", "CURRENT", "RUNNING"),
             ("PASS", "PASS", "CURRENT", "PASS")]
    df = make(cases, "p string, m string, s string, want string")
    got = df.select("want", monitoring.combined_status(F.col("p"), F.col("m"), F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_inapplicable_defects_are_skipped(make):
    plan = {"messages": defects.DefectPlan("message_text", 1.0)}
    ddl = ("message_id string, conversation_id string, user_id string, device_id string, sequence_number bigint,"
           " message_text string, created_at timestamp, ingested_at timestamp, parent_at timestamp")
    row = ["m", "c", "u", "d", 1, None, "2024-01-01 00:00:00", "2024-01-01 00:00:00", None]
    empty = make([tuple(row)], ddl)
    assert rows(defects.label(empty, "messages", 1, "2024-02-01 00:00:00", plan), "issue") == [(None,)]
    plan = {"messages": defects.DefectPlan("message_text", 0.0, 1.0)}
    late = make([tuple([*row[:7], "2024-02-01 00:00:00", None])], ddl)
    labelled = defects.label(late, "messages", 1, "2024-02-01 00:00:00", plan)
    assert rows(labelled, "issue") == [(None,)]
    assert defects.dirty_rows(labelled, "messages", plan).count() == 1


def test_a_constant_has_no_correlation(spark):
    # The mean of 49 ones, merged into an empty buffer, is not one.
    df = spark.range(0, 98, 1, 2).select(F.col("id").alias("x"), (3 * F.col("id")).alias("y"))
    got = profiling.correlation(df, {"constant": (F.col("x"), F.lit(1)), "line": (F.col("x"), F.col("y"))})
    assert rows(got.selectExpr("pair", "round(correlation, 9)")) == [("constant", 0.0), ("line", 1.0)]
    assert rows(profiling.correlation(df.limit(0), {"none": (F.col("x"), F.col("y"))})) == [("none", 0.0)]


def test_a_day_with_messages_only_has_zeros(make):
    # As in the reference mart: counts are zero, rates without a denominator are null.
    messages = make([(1, "u"), (3, "u"), (3, None)], "date_key int, user_id string")
    conversations = make([(3,)], "date_key int")
    completions = make([(3, "SUCCESS"), (3, None)], "date_key int, completion_status string")
    feedback = make([(3, "RATING", 5)], "date_key int, feedback_type string, feedback_score int")
    dates = make([(d, f"2024-01-0{d}") for d in range(1, 5)], "date_key int, full_date date")
    got = marts.product_daily(messages, conversations, completions, feedback, dates).drop("full_date")
    assert rows(got) == [(1, 1, 0, 1, 0, 0, 0, 0, None, 0, 0, 0, None, None),
                         (2, 0, 0, 0, 0, 0, 0, 0, None, 0, 0, 0, None, None),
                         (3, 1, 1, 2, 2, 1, 0, 0, 0.5, 1, 1, 0, 0.5, 1.0)]
