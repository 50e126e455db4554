"""Damaged copies of derived tables, so that every assertion has rows to return.

Each text runs unchanged in Spark and in the SQL oracle.
"""

_N = "cast(substring(user_id, 2) as bigint)"

DAMAGED = {
    "damaged_dates": "select * from {dim_date} where date_key % 10 <> 3",
    "damaged_users": f"""
        select user_key, user_id,
               case when {_N} % 41 = 0 then 'XX' else country_code end as country_code,
               account_status, signup_at,
               case when {_N} % 31 = 0 then 'OTHER' else signup_source end as signup_source,
               effective_start_at,
               case when {_N} % 37 = 0 then effective_end_at + interval '60' day
                    when {_N} % 71 = 0 then effective_start_at
                    else effective_end_at end as effective_end_at,
               case when {_N} % 43 = 0 then effective_end_at is not null else is_current end
                   as is_current,
               version_source
        from {{dim_user}} where {_N} % 47 <> 0 or version_source <> 'dbt_snapshot'""",
    "damaged_sensitive": f"""
        select user_key, user_id, case when {_N} % 29 = 0 then 'gone' else email end as email, name
        from {{dim_user_sensitive}}""",
    "damaged_snapshot": f"""
        select user_id, dbt_scd_id, dbt_valid_from,
               case when {_N} % 23 = 0 then dbt_valid_from
                    when {_N} % 19 = 0 then dbt_valid_to + interval '90' day
                    else dbt_valid_to end as dbt_valid_to
        from {{user_snapshot}} where {_N} % 27 <> 0 or dbt_valid_to is not null""",
    "damaged_history": f"""
        select user_id,
               case when {_N} % 33 = 0 then 1 else version_sequence end as version_sequence,
               case when {_N} % 29 = 0 then 'stale' else email end as email, name,
               effective_start_at,
               case when {_N} % 37 = 0 then effective_end_at + interval '60' day
                    else effective_end_at end as effective_end_at,
               case when {_N} % 43 = 0 then false else is_current end as is_current,
               country_code, account_status
        from {{user_state_history}} where {_N} % 53 <> 1 or version_sequence > 1""",
    "damaged_completions": """
        select completion_id, user_id, user_key, user_key_match_count, date_key,
               completion_status, is_timestamp_order_valid,
               case when cast(substring(completion_id, 2) as bigint) % 59 = 0 then -5
                    when is_timestamp_order_valid = false then 1
                    else completion_duration_seconds end as completion_duration_seconds
        from {fact_completion}""",
    "damaged_messages": """
        select message_id, user_id, is_message_text_missing,
               case when is_message_text_missing then 1 else message_length_chars end
                   as message_length_chars,
               case when n % 19 = 0 then 'lost' else device_key end as device_key,
               case when n % 29 = 0 then 'lost' else user_key end as user_key,
               case when n % 91 = 0 then 19000101 else date_key end as date_key,
               case when n % 83 = 0 then 2 else user_key_match_count end as user_key_match_count
        from (select *, cast(substring(message_id, 2) as bigint) as n from {fact_message}) m
        where n % 101 <> 0""",
    "damaged_inferences": """
        select inference_id, user_id, user_key, user_key_match_count, date_key,
               is_model_id_missing, model_id,
               case when is_model_id_missing then 'guessed' else model_key end as model_key
        from {fact_inference}""",
    "damaged_product": """
        select date_key, full_date,
               case when date_key % 5 = 0 then active_users + 1 else active_users end
                   as active_users,
               conversation_count, message_count - 1 as message_count, completion_count,
               successful_completion_count, failed_completion_count, cancelled_completion_count,
               completion_success_rate,
               case when date_key % 7 = 0 then -1 else feedback_count end as feedback_count,
               positive_feedback_count, negative_feedback_count,
               case when date_key % 3 = 0 then feedback_rate + 1 else feedback_rate end
                   as feedback_rate,
               positive_feedback_rate
        from {gold_product}""",
    "damaged_ml": """
        select * from {gold_ml}
        union all select * from {gold_ml} where date_key % 9 = 0""",
    "damaged_finance": """
        select date_key, subscription_start_count, subscription_end_count, purchase_count,
               payment_attempt_count, purchases_with_payment_attempts,
               purchases_with_multiple_payment_attempts, retry_attempt_count,
               payment_success_rate, retry_purchase_rate, gross_collected_amount, refund_amount,
               case when date_key % 4 = 0 then net_revenue + 1 else net_revenue end as net_revenue
        from {gold_finance}""",
    "damaged_activity": """
        select date_key, user_id,
               case when message_count % 4 = 3 then false else active_flag end as active_flag,
               message_count, conversation_count, completion_count, successful_completion_count,
               feedback_count, positive_feedback_count, inference_count, input_tokens,
               output_tokens, total_tokens
        from {gold_user_activity}""",
    "damaged_volume": """
        select entity_name, activity_date,
               case when date_key % 6 = 0 then -1 else row_count end as row_count,
               rolling_7_day_average, volume_status
        from {dq_volume}
        union all
        select entity_name, activity_date, row_count, rolling_7_day_average, volume_status
        from {dq_volume} where date_key % 11 = 0""",
    "damaged_recon": """
        select reconciliation_name, source_count, target_count,
               case when reconciliation_name like '%payments' then 1 else difference end
                   as difference, status
        from {dq_reconciliation}""",
}

SHARED_EMAIL = f"""
    select user_id, name, case when {_N} % 77 = 0 then 'shared@example.org'
                               when {_N} % 91 = 0 then 'not an address' else email end as email,
           case when {_N} % 83 = 0 then 'usa' else country_code end as country_code,
           case when {_N} % 89 = 0 then 'GONE' else account_status end as account_status,
           signup_source, signup_at
    from {{stg_users}}"""

#: One catalogue entry per part: families of four versions, some released out of order.
MODEL_CATALOGUE = """
    select concat('m', p_partkey) as model_id,
           concat('Model ', case when p_partkey % 50 = 1 then p_partkey - 1 else p_partkey end)
               as model_name,
           concat(1 + p_partkey % 4, '.', case when p_partkey % 100 = 1 then 'x'
                  when p_partkey % 50 = 1 then concat('', p_partkey % 4 - 1)
                  else concat('', p_partkey % 3) end)
               as model_version,
           concat('Family ', floor(p_partkey / 4)) as provider,
           case when p_partkey % 97 <> 0 then
               cast(timestamp '2023-11-01 00:00:00'
                    + (case when p_partkey % 13 = 0 then 9 else p_partkey % 4 end)
                      * interval '1' day as date) end as release_date,
           case when p_partkey % 101 <> 0 then p_partkey % 2 = 0 end as active_flag
    from {part}"""

#: Newline-delimited JSON as it might arrive: broken lines, non-objects, optional fields.
JSON_LINES = """
    select case when event_id % 331 = 0 then concat('{{"id": ', event_id)
                when event_id % 337 = 0 then concat('[', event_id, ']')
                else concat('{{"id": ', event_id, ', "kind": "', event_type, '"',
                            case event_id % 5 when 0 then ', "score": null'
                                 when 1 then concat(', "score": ', event_id % 7, '.5')
                                 when 2 then concat(', "score": ', event_id % 7) else '' end,
                            case when event_id % 3 = 0 then ', "flag": true, "tags": ["a"]'
                                 else '' end,
                            ', "props": ', props, '}}') end as line
    from {events}"""

#: What damages dirty rows before the manifest is reconciled: columns by entity and new values.
CHANGED = {
    "payments": {
        "payment_method": "case when substring(payment_id, 1, 2) = '1f' and payment_method is null then 'CARD' else payment_method end",
        "payment_amount": "case when substring(payment_id, 1, 3) = '77b' then payment_amount + 1 else payment_amount end"},
    "messages": {"message_text": "case when substring(message_id, 1, 3) = '77b' then concat(coalesce(message_text, ''), '!') else message_text end"},
    "users": {"email": "case when substring(user_id, 1, 2) = '1f' then 'x@example.org' else email end"},
}


def damaged_dirty(entity: str, columns: list[str], key: str, dirty: str) -> str:
    """Dirty rows of an entity with lost, changed, late and foreign ones among them."""
    changed = CHANGED.get(entity, {}) | {
        key: f"case when substring({key}, 1, 3) = '00a' then concat('lost-', {key}) else {key} end",
        "ingested_at": f"case when substring({key}, 1, 3) = 'c0c' then ingested_at + interval '1' hour else ingested_at end"}
    values = ", ".join(f"{changed[c]} as {c}" if c in changed else c for c in [*columns, "ingested_at"])
    return f"select {values} from {dirty} where substring({key}, 1, 3) <> 'abc'"


#: Some observations delivered twice.
REPEATED = """
    select *, 0 as arrival from {observations}
    union all
    select *, 1 as arrival from {observations} where substring(observation_id, 1, 1) in ('0', '7')"""

#: Observations whose first week is a baseline; those of volume stand for runs of jobs.
BASELINE = """
    select case when category = 'volume' then 'jobs' else source end as source,
           case when category = 'volume' then 'execution' else category end as category,
           case when category = 'volume' and status = 'WARN' then 'FAIL' else status end as status,
           fingerprint, observed_at, observation_id, arrival,
           observed_at < timestamp '2024-01-08 00:00:00' as baseline
    from {repeated}"""

#: Outbox rows in every delivery state.
OUTBOX = """
    select *, available_at as created_at,
           case substring(notification_id, 1, 1) when '0' then 'SENT' when '1' then 'RETRYABLE'
                when '2' then 'CLAIMED' when '3' then 'CLAIMED' else 'PENDING' end as status,
           case when substring(notification_id, 2, 1) = '0' then 3 else 1 end as attempt_count,
           3 as max_attempts, substring(notification_id, 3, 1) <> '0' as committed,
           case when substring(notification_id, 1, 1) = '2'
                then available_at + interval '1' hour
                else available_at + interval '60' day end as lease_expires_at,
           case when substring(notification_id, 4, 1) in ('0', '1') then 'beta' else 'alpha' end
               as checkpoint_name,
           case when substring(notification_id, 5, 1) = '0' then 9 else 1 end as checkpoint_version
    from {notifications}"""

#: Committed versions per checkpoint.
CHECKPOINTS = """
    select checkpoint_name, max(case when checkpoint_name = 'alpha' then 5 else 0 end)
               as snapshot_version
    from {notifications} group by checkpoint_name"""

#: Monitoring times tied to job runs, partly outside the run or missing.
SNAPSHOTS = """
    select run_id,
           start_time + (run_id % 7 - 1) * interval '10' minute as first_at,
           start_time + (run_id % 11) * interval '10' minute as last_at
    from {job_runs} where run_id % 13 <> 0"""
