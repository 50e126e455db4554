"""Assertions over damaged copies of the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog import declared
from tidemark.catalog.oracle import VIEWS, view
from tidemark.catalog.registry import query
from tidemark.operators import assertions as A
from tidemark.plans.lake import FACT_TABLES
from tidemark.sources.damage import DAMAGED

for _name, _text in DAMAGED.items():
    view(_name, _text.format(**{v: v for v in VIEWS}))

query("chk_date_contiguous", "minimum_date:t maximum_date:t actual_date_count:i",
      lambda k: A.calendar_gaps(k.damaged("damaged_dates")), """
      select * from (select min(full_date) as minimum_date, max(full_date) as maximum_date,
                            count(*) as actual_date_count from damaged_dates) s
      where actual_date_count <> date_diff('day', minimum_date, maximum_date) + 1""")
query("chk_type0", "user_key user_id",
      lambda k: A.attribute_drift(k.damaged("damaged_users"), k.current_user_state,
                                  ["signup_at", "signup_source"], ["user_key", "user_id"]), """
      select d.user_key, d.user_id from damaged_users d
      where exists (select 1 from current_user_state s where s.user_id = d.user_id
                    and row(s.signup_at, s.signup_source) is distinct from row(d.signup_at, d.signup_source))""")
query("chk_type1_dim", "user_key user_id",
      lambda k: A.attribute_drift(k.damaged("damaged_sensitive"), k.current_user_state,
                                  ["email", "name"], ["user_key", "user_id"]), """
      select d.user_key, d.user_id from damaged_sensitive d join current_user_state s using (user_id)
      where d.email is distinct from s.email or d.name is distinct from s.name""")
query("chk_bootstrap", "user_id effective_start_at:t",
      lambda k: A.bootstrap_mismatch(k.user_state_history, k.user_snapshot,
                                     k.damaged("damaged_users")), """
      select user_id, effective_start_at from (
          select h.user_id, h.effective_start_at, h.country_code, h.account_status, 1 as side,
                 least(coalesce(h.effective_end_at, c.cut), c.cut) as until
          from user_state_history h, (select user_id, min(dbt_valid_from) as cut
                                      from user_snapshot group by user_id) c
          where c.user_id = h.user_id and h.effective_start_at < c.cut
          union all
          select user_id, effective_start_at, country_code, account_status, -1, effective_end_at
          from damaged_users where version_source = 'historical_bootstrap') lanes
      group by user_id, effective_start_at
      having sum(side) <> 0 or count(distinct row(until, country_code, account_status)) <> 1""")
query("chk_current", "user_id current_row_count:i open_row_count:i",
      lambda k: A.coverage(k.current_user_state, k.damaged("damaged_users"),
                           {"current_row_count": F.col("is_current"),
                            "open_row_count": F.col("effective_end_at").isNull()},
                           exactly_one=("current_row_count", "open_row_count")), """
      select coalesce(s.user_id, d.user_id) as user_id, d.current_row_count, d.open_row_count
      from current_user_state s full outer join (
          select user_id, count(*) filter (where is_current) as current_row_count,
                 count(*) filter (where effective_end_at is null) as open_row_count
          from damaged_users group by 1) d on s.user_id = d.user_id
      where s.user_id is null or d.user_id is null or d.current_row_count <> 1
         or d.open_row_count <> 1""")
query("chk_snapshot_cover", "user_id open_row_count:i",
      lambda k: A.coverage(
          k.current_user_state,
          k.damaged("damaged_snapshot").filter(F.col("dbt_valid_to").isNull()),
          {"open_row_count": F.lit(True)}, exactly_one=("open_row_count",)), """
      select coalesce(s.user_id, d.user_id) as user_id, d.open_row_count
      from current_user_state s full outer join (
          select user_id, count(*) as open_row_count from damaged_snapshot
          where dbt_valid_to is null group by 1) d on s.user_id = d.user_id
      where s.user_id is null or d.user_id is null or d.open_row_count <> 1""")
query("chk_snapshot_intervals", "user_id dbt_scd_id dbt_valid_from:t dbt_valid_to:t",
      lambda k: A.bad_intervals(k.damaged("damaged_snapshot"), "user_id", "dbt_valid_from",
                                "dbt_valid_to", "dbt_scd_id",
                                ["user_id", "dbt_scd_id", "dbt_valid_from", "dbt_valid_to"],
                                hot_rows=k.hot_rows), """
      with follows as (
          select lead(dbt_scd_id) over w as later_id, lead(dbt_valid_from) over w < dbt_valid_to as cut_short
          from damaged_snapshot window w as (partition by user_id order by dbt_valid_from, dbt_scd_id))
      select user_id, dbt_scd_id, dbt_valid_from, dbt_valid_to from damaged_snapshot s
      where not coalesce(dbt_valid_from < coalesce(dbt_valid_to, timestamp '9999-12-31'), false)
         or dbt_scd_id in (select later_id from follows where cut_short)""")
query("chk_dim_intervals",
      "user_id user_key effective_start_at:t effective_end_at:t is_current:b",
      lambda k: A.bad_intervals(
          k.damaged("damaged_users"), "user_id", "effective_start_at", "effective_end_at",
          "user_key",
          ["user_id", "user_key", "effective_start_at", "effective_end_at", "is_current"],
          current="is_current", hot_rows=k.hot_rows), """
      with follows as (
          select lead(user_key) over w as later_key,
                 lead(effective_start_at) over w < effective_end_at as cut_short
          from damaged_users window w as (partition by user_id order by effective_start_at, user_key))
      select user_id, user_key, effective_start_at, effective_end_at, is_current from damaged_users
      where is_current = (effective_end_at is not null)
         or not coalesce(effective_start_at < coalesce(effective_end_at, timestamp '9999-12-31'), false)
         or user_key in (select later_key from follows where cut_short)""")
query("chk_duration", "completion_id completion_duration_seconds:i",
      lambda k: A.negative_durations(k.damaged("damaged_completions")),
      "select completion_id, completion_duration_seconds from damaged_completions"
      " where completion_duration_seconds < 0")


def _checked_facts(k, facts=None) -> dict:
    return {f: k.damaged(t) if t in DAMAGED else getattr(k, t) for f, t in _FACT.items() if facts is None or f in facts}


_FACT = {
    "conversation": "fact_conversation", "message": "damaged_messages",
    "completion": "damaged_completions", "model_inference": "damaged_inferences",
    "feedback": "fact_feedback", "error": "fact_error", "subscription": "fact_subscription",
    "purchase": "fact_purchase", "payment": "fact_payment",
}
_DIMS = {"user": "dim_user", "device": "dim_device", "model": "dim_model", "plan": "dim_plan",
         "date": "dim_date"}
_PAIRS = [(f, "user_key", "user") for f in _FACT] + [(f, "date_key", "date") for f in _FACT]
_PAIRS += list(A.FACT_KEYS)
_TABLES = {**{f: f"fact_{f}" for f in A.FACT_IDS}, "model_inference": "fact_inference"}


def _with_columns(k, columns):
    """The lake with ``columns`` of each fact, built together."""
    narrow = k.narrowed({t: columns(f) for f, t in _TABLES.items()})
    narrow.facts
    return narrow


def _key_columns(fact):
    # The damaged copy of inferences fills keys by the flag.
    flag = ["is_model_id_missing"] if fact == "model_inference" else []
    return [A.FACT_IDS[fact], *[c for f, c, _ in _PAIRS if f == fact], *flag]


def _fact_keys(k):
    return A.unresolved_keys(_checked_facts(_with_columns(k, _key_columns)),
                             {d: getattr(k, v) for d, v in _DIMS.items()})


query("chk_fact_keys", "relationship_name fact_id", _fact_keys,
      " union all ".join(
          f"select '{f}.{c}' as relationship_name, f.{A.FACT_IDS[f]} as fact_id from {_FACT[f]} f"
          f" left join {_DIMS[d]} d on f.{c} = d.{c} where f.{c} is not null and d.{c} is null"
          for f, c, d in _PAIRS))
query("chk_quality_kept", "validation_name fact_id",
      lambda k: A.repaired_defects(k.damaged("damaged_inferences"),
                                   k.damaged("damaged_completions"),
                                   k.damaged("damaged_messages")), """
      with measures as (
          select 'inference_missing_model' as validation_name, inference_id as fact_id,
                 is_model_id_missing as defect, name, value
          from (select inference_id, is_model_id_missing, cast(model_id as varchar) as model_id, cast(model_key as varchar) as model_key
                from damaged_inferences) i unpivot (value for name in (model_id, model_key))
          union all
          select 'completion_invalid_duration', completion_id, is_timestamp_order_valid = false, name, value
          from (select completion_id, is_timestamp_order_valid, cast(completion_duration_seconds as varchar) as duration
                from damaged_completions) c unpivot (value for name in (duration))
          union all
          select 'message_missing_text_length', message_id, is_message_text_missing, name, value
          from (select message_id, is_message_text_missing, cast(message_length_chars as varchar) as length
                from damaged_messages) m unpivot (value for name in (length)))
      select distinct validation_name, fact_id from measures where defect""")
_STG = {
    "conversation": "stg_conversations", "message": "stg_messages", "completion": "stg_completions",
    "model_inference": "stg_inferences", "feedback": "stg_feedback", "error": "stg_errors",
    "subscription": "stg_subscriptions", "purchase": "stg_purchases", "payment": "stg_payments",
}


def _fact_counts(k):
    # The damaged copy of messages leaves rows out by their id.
    narrow = _with_columns(k, lambda f: ["date_key", *(["message_id"] if f == "message" else [])])
    return A.row_count_gaps({f: getattr(narrow, s) for f, s in _STG.items()}, _checked_facts(narrow))


query("chk_fact_counts", "fact_name source_rows:i fact_rows:i", _fact_counts,
      "select * from (" + " union all ".join(
          f"select '{f}' as fact_name, (select count(*) from {_STG[f]}) as source_rows,"
          f" (select count(*) from {_FACT[f]}) as fact_rows" for f in _FACT)
      + ") r where source_rows <> fact_rows")
query("chk_pit_unique", "fact_name fact_id",
      lambda k: A.ambiguous_versions(_checked_facts(
          _with_columns(k, lambda f: [A.FACT_IDS[f], "user_key_match_count"]))),
      " union all ".join(
          f"select '{f}' as fact_name, {A.FACT_IDS[f]} as fact_id from {_FACT[f]}"
          " where user_key_match_count > 1" for f in _FACT))
query("chk_dau", "date_key:i product_active_users:i user_daily_active_users:i",
      lambda k: A.active_user_gaps(k.damaged("damaged_product"), k.damaged("damaged_activity")), """
      select date_key, max(stated) as product_active_users, sum(seen) as user_daily_active_users
      from (select date_key, active_users as stated, 0 as seen from damaged_product
            union all select date_key, null, case when active_flag then 1 else 0 end
            from damaged_activity) lanes
      group by date_key having max(stated) <> sum(seen)""")
_ML_GRAIN = "concat(date_key, '|', coalesce(model_key, model_id, '__UNRESOLVED__'))"
query("chk_grains", "mart_name grain_key",
      lambda k: A.repeated_grains(k.damaged("damaged_ml"), k.damaged("damaged_activity")), f"""
      select 'ml' as mart_name, {_ML_GRAIN} as grain_key from damaged_ml group by 2
      having count(*) <> 1
      union all select 'user_activity', concat(date_key, '|', user_id) from damaged_activity
      group by 2 having count(*) <> 1""")


def _checked_marts(k) -> dict:
    return {"product": k.damaged("damaged_product"), "finance": k.damaged("damaged_finance"),
            "ml": k.damaged("damaged_ml"), "user_activity": k.damaged("damaged_activity")}


_MART = {"product": "damaged_product", "finance": "damaged_finance", "ml": "damaged_ml",
         "user_activity": "damaged_activity"}
_SPECIAL = {
    "product": [],
    "finance": ["purchases_with_multiple_payment_attempts > purchases_with_payment_attempts",
                "net_revenue is distinct from gross_collected_amount - refund_amount"],
    "ml": ["p50_latency_ms > p95_latency_ms", "p95_latency_ms > p99_latency_ms"],
    "user_activity": ["active_flag is distinct from (message_count > 0)"],
}
_GRAIN = {"product": "cast(date_key as varchar)", "finance": "cast(date_key as varchar)",
          "ml": _ML_GRAIN, "user_activity": "concat(date_key, '|', user_id)"}
query("chk_gold_ranges", "mart_name grain_key",
      lambda k: A.mart_range_violations(_checked_marts(k)),
      " union all ".join(
          f"select '{m}' as mart_name, {_GRAIN[m]} as grain_key from {t} where "
          + " or ".join([*[f"{c} < 0" for c in A.MART_COUNTS[m]],
                         *[f"{c} not between 0 and 1" for c in A.MART_RATES[m]], *_SPECIAL[m]])
          for m, t in _MART.items()))
# What the mart sums count and group by; the calendar of finance also spans the ends of subscriptions.
_SUMMED = {
    "fact_message": ["message_id", "user_id", "date_key"], "fact_conversation": ["user_id", "date_key"],
    "fact_completion": ["user_id", "date_key"], "fact_feedback": ["user_id", "date_key"],
    "fact_inference": ["user_id", "date_key", "model_id", "model_key"], "fact_purchase": ["date_key"],
    "fact_payment": ["date_key"], "fact_subscription": ["date_key", "ended_at"],
}


def _gold_silver(k):
    narrow = k.narrowed(_SUMMED)
    narrow.facts_of([e for e, t in FACT_TABLES.items() if t in _SUMMED])
    return A.mart_sum_gaps(_checked_marts(narrow), _checked_facts(narrow, {f for _, _, f, _ in A.MART_SUMS.values()}))


query("chk_gold_silver", "metric_name gold_value:i silver_value:i", _gold_silver,
      "select * from (" + " union all ".join(
          f"select '{n}' as metric_name, (select sum({c}) from {_MART[m]}) as gold_value,"
          f" (select count({'user_id' if keyed else '*'}) from {_FACT[f]}) as silver_value"
          for n, (m, c, f, keyed) in A.MART_SUMS.items())
      + ") r where gold_value is distinct from silver_value")
query("chk_dq_ranges", "model_name grain_key",
      lambda k: A.check_range_violations(k.monitored.damaged("damaged_volume"), k.monitored.dq_quality,
                                         k.monitored.dq_freshness), """
      with rows as (
          select 'row_count' as model_name, concat(entity_name, '|', activity_date) as grain_key, volume_status as status,
                 [{'m': 'row_count', 'v': row_count::double}, {'m': 'rolling', 'v': rolling_7_day_average::double}] as measures
          from damaged_volume
          union all
          select 'quality_metrics' as model_name, concat(entity_name, '|', metric_name, '|', metric_date) as grain_key,
                 quality_status as status,
                 [{'m': 'numerator', 'v': numerator::double}, {'m': 'denominator', 'v': denominator::double},
                  {'m': 'over', 'v': (denominator - numerator)::double}, {'m': 'rate', 'v': metric_rate::double}] as measures
          from dq_quality
          union all
          select 'freshness' as model_name, entity_name as grain_key, freshness_status as status,
                 [{'m': 'delay', 'v': freshness_delay_hours::double}] as measures
          from dq_freshness),
      numbered as (select *, row_number() over () as id, count(*) over (partition by model_name, grain_key) as copies from rows),
      measured as (select id, x.m as measure, x.v as value from (select id, unnest(measures) as x from numbered) y),
      bounds(measure, least, most) as (values
          ('row_count', 0, null), ('rolling', 0, null), ('numerator', 0, null), ('denominator', 0, null),
          ('over', 0, null), ('rate', 0, 1), ('delay', 0, null)),
      states(model_name, status) as (values
          ('row_count', 'PASS'), ('row_count', 'WARN'), ('quality_metrics', 'PASS'), ('quality_metrics', 'WARN'),
          ('freshness', 'PASS'), ('freshness', 'WARN'), ('freshness', 'FAIL'))
      select model_name, grain_key from numbered n
      where copies > 1
         or (status is not null and not exists (select 1 from states s where s.model_name = n.model_name and s.status = n.status))
         or exists (select 1 from measured m join bounds b using (measure)
                    where m.id = n.id and (m.value < b.least or m.value > b.most))""")
query("chk_recon_pass", "reconciliation_name source_count:i target_count:i difference:i status",
      lambda k: A.failed_reconciliations(k.damaged("damaged_recon")),
      "select * from damaged_recon where difference <> 0 or status <> 'PASS'")
query("chk_hist_cover", "user_id version_count:i current_count:i",
      lambda k: A.coverage(k.stg_users, k.damaged("damaged_history"),
                           {"version_count": F.lit(True), "current_count": F.col("is_current")},
                           exactly_one=("current_count",)), """
      select user_id, nullif(sum(version), 0) as version_count,
             case when sum(version) > 0 then sum(present) end as current_count
      from (select user_id, 1 as known, 0 as version, 0 as present from stg_users
            union all select user_id, 0, 1, case when is_current then 1 else 0 end
            from damaged_history) lanes
      group by user_id having sum(known) = 0 or sum(present) <> 1""")
query("chk_hist_type1", "user_id version_sequence:i email expected_email name expected_name",
      lambda k: A.overwritten_attributes(k.damaged("damaged_history"), k.stg_users,
                                         k.stg_user_updates), """
      select h.user_id, h.version_sequence, h.email, s.email as expected_email, h.name,
             s.name as expected_name
      from damaged_history h join current_user_state s using (user_id)
      where h.email is distinct from s.email or h.name is distinct from s.name""")
query("chk_hist_versions", "user_id expected_version_count:i actual_version_count:i",
      lambda k: A.version_count_gaps(k.damaged("damaged_history"), k.stg_users,
                                     k.stg_user_updates), """
      select * from (
          select u.user_id, 1 + count(*) filter (where x.field_name in
                     ('country_code', 'account_status')
                     and x.old_value is distinct from x.new_value) as expected_version_count,
                 max(h.n) as actual_version_count
          from stg_users u left join stg_user_updates x using (user_id)
          left join (select user_id, count(*) as n from damaged_history group by 1) h
            using (user_id)
          group by u.user_id) r
      where expected_version_count is distinct from actual_version_count""")
query("chk_hist_intervals",
      "user_id version_sequence:i effective_start_at:t effective_end_at:t is_current:b",
      lambda k: _history_intervals(k), """
      with follows as (
          select user_id, lead(version_sequence) over w as later, lead(effective_start_at) over w as starts,
                 effective_end_at as ended
          from damaged_history window w as (
              partition by user_id order by version_sequence, effective_start_at nulls first))
      select distinct user_id, version_sequence, effective_start_at, effective_end_at, is_current
      from damaged_history h
      where is_current = (effective_end_at is not null)
         or not coalesce(effective_start_at < coalesce(effective_end_at, timestamp '9999-12-31'), false)
         or exists (select 1 from follows f where f.user_id = h.user_id and f.later = h.version_sequence
                    and f.starts = h.effective_start_at and f.starts < f.ended)
         or 1 < (select count(*) from damaged_history o where o.user_id = h.user_id
                 and o.version_sequence = h.version_sequence)""")


def _history_intervals(k):
    out = ["user_id", "version_sequence", "effective_start_at", "effective_end_at", "is_current"]
    rows = k.damaged("damaged_history")
    bad = A.bad_intervals(rows, "user_id", "effective_start_at", "effective_end_at",
                          "version_sequence", out, current="is_current", order="version_sequence",
                          hot_rows=k.hot_rows)
    repeated = A.not_unique(rows, ["user_id", "version_sequence"]).drop("n_rows")
    copies = rows.join(repeated, ["user_id", "version_sequence"]).select(*out)
    return bad.unionByName(copies).distinct()


query("chk_unique", "message_id n_rows:i",
      lambda k: A.not_unique(k.bronze("messages"), ["message_id"]),
      "select message_id, count(*) as n_rows from b_messages where message_id is not null"
      " group by 1 having count(*) > 1")
query("chk_not_null", "message_id conversation_id",
      lambda k: A.is_null(k.stg_messages, "message_text"),
      "select message_id, conversation_id from stg_messages where message_text is null")
query("chk_relationships", "message_id device_id",
      lambda k: A.orphans(k.stg_messages, "device_id", k.stg_devices, "device_id"),
      "select m.message_id, m.device_id from stg_messages m left join stg_devices d"
      " on m.device_id = d.device_id where m.device_id is not null and d.device_id is null")
query("chk_accepted", "payment_id payment_method",
      lambda k: A.not_accepted(k.stg_payments, "payment_method", declared.ACCEPTED["stg_payments", "payment_method"]),
      "select payment_id, payment_method from stg_payments where payment_method not in ({})".format(
          ", ".join(f"'{v}'" for v in schemas.PAYMENT_METHODS)))
query("violations_all", "check_name violations:i first_row_key",
      lambda k: declared.violations(k).groupBy("check_name").agg(
          F.count(F.lit(1)).alias("violations"), F.min("row_key").alias("first_row_key")),
      f"select check_name, count(*) as violations, min(row_key) as first_row_key from ({declared.SQL}) v group by 1")
