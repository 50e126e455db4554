"""Staging, history, dimensions, facts and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.oracle import view
from tidemark.catalog.registry import query
from tidemark.operators import facts, history, marts, staging

_TEXT = {"timestamp": "t", "date": "t", "boolean": "b", "bigint": "i", "int": "i"}


def _kinds(entity: str) -> dict[str, str]:
    out = {}
    for f in schemas.entity_schema(entity, physical=False).fields:
        simple = f.dataType.simpleString()
        out[f.name] = "m" if simple.startswith("decimal") else _TEXT.get(simple, "s")
    return out


def _fields(entity: str, extra: str = "", drop: tuple[str, ...] = ()) -> str:
    cols = [f"{n}:{k}" for n, k in _kinds(entity).items() if n not in drop]
    if entity not in schemas.REFERENCE_ENTITIES:
        cols.append("ingested_at:t")
    return " ".join([*cols, "physical_partition_date:t", extra])


ORDER = "is_timestamp_order_valid:b"

query("dedup_replay", _fields("messages"),
      lambda k: staging.dedup_replay(staging.typed(k.bronze("messages"), "messages"), "message_id"),
      "select * from d_messages")
query("dedup_latest", _fields("models"),
      lambda k: staging.dedup_latest(staging.typed(k.bronze("models"), "models"), "model_id"),
      "select * from d_models")
# Flagged staging tables and the flag of each.
_FLAGS = {
    "users": ("stg_users", "is_email_missing"), "messages": ("stg_messages", "is_message_text_missing"),
    "completions": ("stg_completions", "is_user_id_missing"), "model_inferences": ("stg_inferences", "is_model_id_missing"),
    "feedback": ("stg_feedback", "is_feedback_type_missing"), "purchases": ("stg_purchases", "is_purchase_type_missing"),
    "payments": ("stg_payments", "is_payment_method_missing"),
}
query("stg_flags", "entity_name missing_rows:i total_rows:i",
      lambda k: _flag_counts(k), " union all ".join(
          f"select '{e}' as entity_name, count(*) filter (where {flag}) as missing_rows, count(*) as total_rows from {t}"
          for e, (t, flag) in _FLAGS.items()))


def _flag_counts(k):
    out = None
    for entity, (table, flag) in _FLAGS.items():
        df = getattr(k, table)
        row = df.agg(F.count_if(flag).alias("missing_rows"), F.count(F.lit(1)).alias("total_rows"))
        row = row.select(F.lit(entity).alias("entity_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


query("stg_time_order", f"inference_id request_at:t response_at:t {ORDER}",
      lambda k: k.stg_inferences,
      f"select inference_id, request_at, response_at, is_timestamp_order_valid from stg_inferences")
query("stg_parent_order", f"payment_id purchase_id processed_at:t {ORDER}",
      lambda k: k.stg_payments,
      "select payment_id, purchase_id, processed_at, is_timestamp_order_valid from stg_payments")
query("key_recovery",
      "completion_id source_user_id user_id is_user_id_recovered:b is_user_id_missing:b",
      lambda k: staging.recover_key(
          staging.dedup_replay(staging.typed(k.bronze("completions"), "completions"), "completion_id"),
          k.stg_messages, "message_id", "user_id"),
      "select completion_id, source_user_id, user_id, is_user_id_recovered, is_user_id_missing"
      " from stg_completions")

for _key, _entity, _extra, _attr in (
    ("stg_messages", "messages", f"is_message_text_missing:b {ORDER}", "stg_messages"),
    ("stg_completions", "completions",
     f"source_user_id is_user_id_recovered:b is_user_id_missing:b {ORDER}", "stg_completions"),
    ("stg_inferences", "model_inferences", f"is_model_id_missing:b {ORDER}", "stg_inferences"),
    ("stg_feedback", "feedback", "is_feedback_type_missing:b", "stg_feedback"),
    ("stg_errors", "errors", "", "stg_errors"),
    ("stg_purchases", "purchases", "is_purchase_type_missing:b", "stg_purchases"),
    ("stg_payments", "payments", f"is_payment_method_missing:b {ORDER}", "stg_payments"),
    ("stg_subscriptions", "subscriptions", "", "stg_subscriptions"),
    ("stg_users", "users", "is_email_missing:b", "stg_users"),
    ("stg_user_updates", "user_updates", "", "stg_user_updates"),
    ("stg_conversations", "conversations", "", "stg_conversations"),
    ("stg_models", "models", "", "stg_models"),
    ("stg_devices", "devices", "", "stg_devices"),
    ("stg_plans", "subscription_plans", "", "stg_plans"),
):
    query(_key, _fields(_entity, _extra), lambda k, a=_attr: getattr(k, a), f"select * from {_attr}")

# history ---------------------------------------------------------------------------------

query("current_user_state",
      "user_id email name country_code account_status signup_at:t signup_source"
      " source_user_ingested_at:t source_user_partition_date:t latest_user_update_at:t"
      " latest_update_ingested_at:t",
      lambda k: k.current_user_state, "select * from current_user_state")
query("carry_forward",
      "user_id effective_start_at:t version_update_id country_code account_status"
      " version_sequence:i effective_end_at:t",
      lambda k: history.versions(history.state_events(k.stg_users, k.stg_user_updates), k.hot_rows),
      """select user_id, effective_start_at, version_update_id,
                last_value(c_value ignore nulls) over (w rows unbounded preceding) as country_code,
                last_value(s_value ignore nulls) over (w rows unbounded preceding) as account_status,
                row_number() over w as version_sequence,
                lead(effective_start_at) over w as effective_end_at
         from history_events
         window w as (partition by user_id
                      order by effective_start_at, coalesce(version_update_id, ''))""")
query("user_state_history",
      "user_id version_sequence:i email name country_code account_status signup_source signup_at:t"
      " source_user_ingested_at:t source_user_partition_date:t version_update_id"
      " type2_change_field effective_start_at:t effective_end_at:t is_current:b",
      lambda k: k.user_state_history, "select * from user_state_history")
query("scd2_snapshot",
      "user_id email name country_code account_status dbt_scd_id dbt_updated_at:t"
      " dbt_valid_from:t dbt_valid_to:t",
      lambda k: k.user_snapshot, "select * from user_snapshot")
query("dim_user",
      "user_key user_id country_code account_status signup_at:t signup_source"
      " effective_start_at:t effective_end_at:t is_current:b version_source",
      lambda k: k.dim_user, "select * from dim_user")
query("dim_user_sensitive", "user_key user_id email name",
      lambda k: k.dim_user_sensitive, "select * from dim_user_sensitive")
view("closed_users", """
    select user_id, closed_at from (
        select u.user_id, case when u.account_status = 'CLOSED' then u.signup_at else c.at end
               as closed_at
        from stg_users u left join (select user_id, min(updated_at) as at from stg_user_updates
             where field_name = 'account_status' and new_value = 'CLOSED' group by user_id) c
          on c.user_id = u.user_id) x where closed_at is not null""")
query("closed_times", "user_id closed_at:t",
      lambda k: history.closed_times(k.stg_users, k.stg_user_updates),
      "select * from closed_users")
_LATEST = ("select *, row_number() over (partition by user_id, field_name"
           " order by updated_at desc, update_id desc) as rn from stg_user_updates")
query("update_patch", "user_id email name country_code account_status changed",
      lambda k: history.update_patch(k.stg_user_updates)
      .withColumn("changed", F.concat_ws(",", "changed_fields")),
      f"""select user_id, {", ".join(
          f"max(new_value) filter (where field_name = '{f}') as {f}" for f in schemas.UPDATE_FIELDS)},
          concat_ws(',', {", ".join(
          f"max(field_name) filter (where field_name = '{f}')" for f in schemas.UPDATE_FIELDS)})
          as changed
          from ({_LATEST}) r where rn = 1 group by user_id""")
query("apply_patch", "user_id email name country_code account_status",
      lambda k: history.apply_patch(k.stg_users, history.update_patch(k.stg_user_updates)),
      "select s.user_id, s.email, s.name, s.country_code, s.account_status"
      " from current_user_state s where s.latest_user_update_at is not null")
query("state_by_pivot", "user_id email name country_code account_status",
      lambda k: history.state_by_pivot(k.stg_users, k.stg_user_updates),
      f"""select u.user_id, {", ".join(
          f"coalesce(p.{f}, u.{f}) as {f}" for f in schemas.UPDATE_FIELDS)}
          from stg_users u left join (select user_id, {", ".join(
          f"max(new_value) filter (where field_name = '{f}') as {f}" for f in schemas.UPDATE_FIELDS)}
          from ({_LATEST}) r where rn = 1 group by user_id) p on p.user_id = u.user_id""")

# dimensions ------------------------------------------------------------------------------

query("dim_date",
      "date_key:i full_date:t day_of_week:i day_of_month:i week_of_year:i month_number:i"
      " month_name quarter:i year:i is_weekend:b",
      lambda k: k.dim_date, "select * from dim_date")
query("dim_device", "device_key device_id device_type operating_system browser app_platform"
      " source_partition_date:t", lambda k: k.dim_device, "select * from dim_device")
query("dim_model", "model_key model_id model_name model_version provider release_date:t"
      " active_flag:b source_partition_date:t", lambda k: k.dim_model, "select * from dim_model")
query("dim_plan", "subscription_plan_key plan_id plan_name monthly_price:m currency active_flag:b"
      " source_partition_date:t", lambda k: k.dim_plan, "select * from dim_plan")

# facts -----------------------------------------------------------------------------------

query("pit_join", "message_id user_id created_at:t user_key user_key_match_count:i",
      lambda k: facts.pit_join(
          k.stg_messages.select("message_id", "user_id", "created_at"),
          k.dim_user.select("user_id", "user_key", "effective_start_at", "effective_end_at"),
          "user_id", "created_at", "message_id", hot_rows=k.hot_rows,
          disjoint_versions=k.disjoint_versions),
      "select message_id, user_id, created_at, user_key, user_key_match_count from fact_message")

_USER = "user_key user_key_match_count:i date_key:i user_id ingested_at:t source_partition_date:t"
for _key, _columns in {
    "fact_conversation": "conversation_id created_at:t",
    "fact_message": "message_id conversation_id device_key device_id sequence_number:i"
                    f" message_length_chars:i created_at:t is_message_text_missing:b {ORDER}",
    "fact_completion": "completion_id message_id conversation_id source_user_id completion_status"
                       " requested_at:t completed_at:t completion_duration_seconds:i"
                       f" is_user_id_recovered:b is_user_id_missing:b {ORDER}",
    "fact_inference": "inference_id completion_id model_key model_id request_at:t response_at:t"
                      " latency_ms:i input_tokens:i output_tokens:i total_tokens:i"
                      f" inference_status is_model_id_missing:b {ORDER}",
    "fact_feedback": "feedback_id completion_id feedback_type feedback_score:i created_at:t"
                     " is_feedback_type_missing:b",
    "fact_error": "error_id conversation_id message_id completion_id inference_id model_key"
                  " model_id error_source error_type error_code severity occurred_at:t",
    "fact_subscription": "subscription_id subscription_plan_key plan_id subscription_status"
                         " started_at:t ended_at:t actual_monthly_price:m updated_at:t",
    "fact_purchase": "purchase_id subscription_id subscription_plan_key plan_id purchase_type"
                     " purchase_status subtotal_amount:m discount_amount:m tax_amount:m"
                     " total_amount:m purchase_created_at:t updated_at:t is_purchase_type_missing:b",
    "fact_payment": "payment_id purchase_id payment_status payment_method payment_amount:m"
                    " refund_amount:m processed_at:t refunded_at:t updated_at:t"
                    f" is_payment_method_missing:b {ORDER}",
}.items():
    query(_key, f"{_columns} {_USER}", lambda k, a=_key: getattr(k, a), f"select * from {_key}")

# marts -----------------------------------------------------------------------------------


def _spine(name: str, dailies: list[str]) -> None:
    keys = " union all ".join(f"select date_key from {d}" for d in dailies)
    view(name, f"""select d.date_key, d.full_date from dim_date d,
        (select min(date_key) as lo, max(date_key) as hi from ({keys}) a) b
        where d.date_key between b.lo and b.hi""")


_spine("product_spine", ["fact_message", "fact_conversation", "fact_completion", "fact_feedback"])
_POS = "(feedback_type = 'THUMBS_UP' or (feedback_type = 'RATING' and feedback_score >= 4))"
_NEG = "(feedback_type = 'THUMBS_DOWN' or (feedback_type = 'RATING' and feedback_score <= 2))"
# One lane of events for all facts; each measure counts its own rows of the lane.
view("gold_product", f"""
    select s.date_key, s.full_date,
           count(distinct e.who) filter (e.fact = 'm') as active_users,
           count_if(e.fact = 'c') as conversation_count, count_if(e.fact = 'm') as message_count,
           count_if(e.fact = 'k') as completion_count,
           count_if(e.what = 'SUCCESS') as successful_completion_count,
           count_if(e.what = 'FAILED') as failed_completion_count,
           count_if(e.what = 'CANCELLED') as cancelled_completion_count,
           avg(case e.fact when 'k' then (coalesce(e.what, '') = 'SUCCESS')::int end)
               as completion_success_rate,
           count_if(e.fact = 'f') as feedback_count, count_if(e.what = '+') as positive_feedback_count,
           count_if(e.what = '-') as negative_feedback_count,
           count_if(e.fact = 'f') / nullif(count_if(e.fact = 'k'), 0)::double as feedback_rate,
           avg(case e.fact when 'f' then (coalesce(e.what, '') = '+')::int end) as positive_feedback_rate
    from product_spine s left join (
        select 'm' as fact, date_key, user_id as who, null as what from fact_message
        union all select 'k', date_key, null, completion_status from fact_completion
        union all select 'f', date_key, null, case when {_POS} then '+' when {_NEG} then '-' end
        from fact_feedback
        union all select 'c', date_key, null, null from fact_conversation) e
      on e.date_key = s.date_key
    group by s.date_key, s.full_date""")
query("gold_product",
      "date_key:i full_date:t active_users:i conversation_count:i message_count:i"
      " completion_count:i successful_completion_count:i failed_completion_count:i"
      " cancelled_completion_count:i completion_success_rate:f feedback_count:i"
      " positive_feedback_count:i negative_feedback_count:i feedback_rate:f"
      " positive_feedback_rate:f",
      lambda k: k.gold_product, "select * from gold_product")
query("date_spine", "date_key:i full_date:t",
      lambda k: marts.date_spine(k.dim_date, [k.fact_message, k.fact_conversation,
                                              k.fact_completion, k.fact_feedback]),
      "select * from product_spine")


def _user_daily(fact: str, measures: str) -> str:
    return (f"(select user_id, date_key, {measures} from {fact} where user_id is not null"
            " and date_key is not null group by 1, 2)")


view("gold_user_activity", f"""
    with m as {_user_daily("fact_message", "count(*) as n")},
         c as {_user_daily("fact_conversation", "count(*) as n")},
         k as {_user_daily("fact_completion", "count(*) as n, count(*) filter"
                           " (where completion_status = 'SUCCESS') as ok")},
         f as {_user_daily("fact_feedback", f"count(*) as n, count(*) filter (where {_POS}) as pos")},
         i as {_user_daily("fact_inference", "count(*) as n, sum(input_tokens) as ti,"
                           " sum(output_tokens) as tu, sum(total_tokens) as tt")},
         keys as (select user_id, date_key from m union select user_id, date_key from c
                  union select user_id, date_key from k union select user_id, date_key from f
                  union select user_id, date_key from i)
    select a.date_key, d.full_date, a.user_id, coalesce(m.n, 0) > 0 as active_flag,
           coalesce(m.n, 0) as message_count, coalesce(c.n, 0) as conversation_count,
           coalesce(k.n, 0) as completion_count, coalesce(k.ok, 0) as successful_completion_count,
           coalesce(f.n, 0) as feedback_count, coalesce(f.pos, 0) as positive_feedback_count,
           coalesce(i.n, 0) as inference_count, coalesce(ti, 0) as input_tokens,
           coalesce(tu, 0) as output_tokens, coalesce(tt, 0) as total_tokens
    from keys a join dim_date d using (date_key) left join m using (user_id, date_key)
         left join c using (user_id, date_key) left join k using (user_id, date_key)
         left join f using (user_id, date_key) left join i using (user_id, date_key)""")
query("gold_user_activity",
      "date_key:i full_date:t user_id active_flag:b message_count:i conversation_count:i"
      " completion_count:i successful_completion_count:i feedback_count:i"
      " positive_feedback_count:i inference_count:i input_tokens:i output_tokens:i total_tokens:i",
      lambda k: k.gold_user_activity, "select * from gold_user_activity")

view("gold_ml", """
    with usable as (
        select *, case when is_timestamp_order_valid and latency_ms >= 0 then latency_ms end as took
        from fact_inference),
    per_group as (
        select date_key, model_key, model_id, quantile_cont(took, [0.5, 0.95, 0.99]) as q,
               sum(took)::double / nullif(count(took), 0) as average_latency_ms,
               sum((inference_status = 'FAILED')::int) as failed_inference_count,
               sum((inference_status = 'SUCCESS')::int) as successful_inference_count,
               count(*) as inference_count, sum(total_tokens) as total_tokens,
               sum(output_tokens) as total_output_tokens, sum(input_tokens) as total_input_tokens,
               sum(output_tokens)::double / nullif(count(output_tokens), 0) as average_output_tokens,
               sum(input_tokens)::double / nullif(count(input_tokens), 0) as average_input_tokens
        from usable group by all)
    select g.* exclude (q), q[1] as p50_latency_ms, q[2] as p95_latency_ms, q[3] as p99_latency_ms,
           coalesce(successful_inference_count, 0) / inference_count::double as inference_success_rate,
           (select full_date from dim_date d where d.date_key = g.date_key) as full_date,
           m.model_name, m.model_version, m.provider
    from per_group g left join dim_model m on m.model_key = g.model_key""")
query("gold_ml",
      "date_key:i full_date:t model_key model_id model_name model_version provider"
      " inference_count:i successful_inference_count:i failed_inference_count:i"
      " inference_success_rate:f average_latency_ms:f p50_latency_ms:f p95_latency_ms:f"
      " p99_latency_ms:f total_input_tokens:i total_output_tokens:i total_tokens:i"
      " average_input_tokens:f average_output_tokens:f",
      lambda k: k.gold_ml, "select * from gold_ml")

view("retry_daily", """
    select first_key as date_key, count(*) as purchases_with_payment_attempts,
           count(*) filter (where n > 1) as purchases_with_multiple_payment_attempts,
           sum(greatest(n - 1, 0)) as retry_attempt_count
    from (select purchase_id, min(date_key) as first_key, count(*) as n from fact_payment
          group by purchase_id) a group by first_key""")
query("payment_retries",
      "date_key:i purchases_with_payment_attempts:i purchases_with_multiple_payment_attempts:i"
      " retry_attempt_count:i",
      lambda k: marts.payment_retries(k.fact_payment), "select * from retry_daily")
view("subscription_end_daily", """
    select d.date_key, count(*) as n,
           count(*) filter (where subscription_status = 'CANCELLED') as cancelled,
           count(*) filter (where subscription_status = 'EXPIRED') as expired
    from fact_subscription s join dim_date d on cast(s.ended_at as date) = d.full_date
    group by d.date_key""")
_spine("finance_spine", ["fact_subscription", "subscription_end_daily", "fact_purchase",
                         "fact_payment"])
# Facts become one lane of (day, fact, state, kind, amounts); every measure is a sum over it.
view("gold_finance", """
    with lane as (
        select date_key, 'start' as fact, null as state, null as kind,
               0 as a, 0 as b, 0 as c, 0 as d from fact_subscription
        union all select date_key, 'buy', purchase_status, purchase_type, subtotal_amount,
               discount_amount, tax_amount, total_amount from fact_purchase
        union all select date_key, 'pay', payment_status, null, payment_amount, refund_amount, 0, 0
        from fact_payment),
    sums as (
        select date_key, count_if(fact = 'start') as subscription_start_count,
               count_if(fact = 'buy') as purchase_count,
               count_if(fact = 'buy' and state = 'COMPLETED') as completed_purchase_count,
               count_if(fact = 'buy' and state = 'FAILED') as failed_purchase_count,
               count_if(fact = 'buy' and state = 'REFUNDED') as refunded_purchase_count,
               count_if(kind = 'NEW_SUBSCRIPTION') as new_subscription_purchase_count,
               count_if(kind = 'RENEWAL') as renewal_purchase_count,
               count_if(kind = 'UPGRADE') as upgrade_purchase_count,
               sum(a) filter (fact = 'buy' and state = 'COMPLETED') as done_a,
               sum(b) filter (fact = 'buy' and state = 'COMPLETED') as done_b,
               sum(c) filter (fact = 'buy' and state = 'COMPLETED') as done_c,
               sum(d) filter (fact = 'buy' and state = 'COMPLETED') as done_d,
               count_if(fact = 'pay') as payment_attempt_count,
               count_if(fact = 'pay' and state = 'SUCCESS') as successful_payment_count,
               count_if(fact = 'pay' and state = 'FAILED') as failed_payment_count,
               count_if(fact = 'pay' and state = 'REFUNDED') as refunded_payment_count,
               coalesce(sum(a) filter (fact = 'pay' and state in ('SUCCESS', 'REFUNDED')), 0) as collected,
               coalesce(sum(b) filter (fact = 'pay'), 0) as returned
        from lane group by date_key),
    days as (
        select s.date_key, s.full_date, coalesce(columns(x.* exclude (date_key)), 0),
               coalesce(e.n, 0) as subscription_end_count,
               coalesce(e.cancelled, 0) as cancelled_subscription_count,
               coalesce(e.expired, 0) as expired_subscription_count,
               coalesce(r.purchases_with_payment_attempts, 0) as purchases_with_payment_attempts,
               coalesce(r.purchases_with_multiple_payment_attempts, 0)
                   as purchases_with_multiple_payment_attempts,
               coalesce(r.retry_attempt_count, 0) as retry_attempt_count
        from finance_spine s left join sums x on x.date_key = s.date_key
        left join retry_daily r on r.date_key = s.date_key
        left join subscription_end_daily e on e.date_key = s.date_key)
    select *, done_a as completed_subtotal_amount, done_b as completed_discount_amount,
           done_c as completed_tax_amount, done_d as completed_purchase_amount,
           collected as gross_collected_amount, returned as refund_amount,
           collected - returned as net_revenue,
           successful_payment_count / nullif(payment_attempt_count, 0)::double as payment_success_rate,
           purchases_with_multiple_payment_attempts
               / nullif(purchases_with_payment_attempts, 0)::double as retry_purchase_rate
    from days""")
query("gold_finance",
      "date_key:i full_date:t subscription_start_count:i subscription_end_count:i"
      " cancelled_subscription_count:i expired_subscription_count:i purchase_count:i"
      " completed_purchase_count:i failed_purchase_count:i refunded_purchase_count:i"
      " new_subscription_purchase_count:i renewal_purchase_count:i upgrade_purchase_count:i"
      " completed_subtotal_amount:m completed_discount_amount:m completed_tax_amount:m"
      " completed_purchase_amount:m payment_attempt_count:i successful_payment_count:i"
      " failed_payment_count:i refunded_payment_count:i payment_success_rate:f"
      " gross_collected_amount:m refund_amount:m net_revenue:m"
      " purchases_with_payment_attempts:i purchases_with_multiple_payment_attempts:i"
      " retry_attempt_count:i retry_purchase_rate:f",
      lambda k: k.gold_finance, "select * from gold_finance")
