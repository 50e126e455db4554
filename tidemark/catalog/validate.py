"""Integrity and causality validators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.oracle import view
from tidemark.catalog.registry import query
from tidemark.operators import validators as V
from tidemark.operators.monitoring import union_all
from tidemark.sources.damage import MODEL_CATALOGUE, SHARED_EMAIL

HORIZON = "2024-02-01 00:00:00"
#: From when on paid plans have their second version.
CUTOVER = "2024-01-15 00:00:00"
view("shared_email_users", SHARED_EMAIL.format(stg_users="stg_users"))
view("model_catalogue", MODEL_CATALOGUE.format(part="part"))


def labelled(source: str, row_id: str, rules: Mapping[str, str], more: str = "") -> str:
    """One select per rule over a joined source."""
    parts = [
        f"select '{label}' as violation, cast({row_id} as varchar) as row_id from src where {cond}"
        for label, cond in rules.items()
    ]
    return f"with src as ({source}) " + " union all ".join(parts) + (f" union all {more}" if more else "")


def found(table: str, key: str, prefix: str, *columns: str) -> str:
    cols = "".join(f", {c} as {prefix}_{c}" for c in columns)
    return f"(select {key}{cols}, true as {prefix}_found from {table})"


_VIOLATION = "violation row_id"

def _ingestion_sql(entity: str) -> str:
    key, times = schemas.ENTITY_ID[entity], ", ".join(schemas.EVENT_TIMES[entity])
    rules = {
        "ingested_before_event": "ingested_at < event_at",
        "beyond_horizon": f"ingested_at > timestamp '{HORIZON}'",
        "partition_mismatch": "dt <> cast(ingested_at as date)",
        "missing_time": "ingested_at is null or event_at is null",
    }
    parts = [f"select '{label}' as violation, {key} as row_id from x where {test}" for label, test in rules.items()]
    return f"""
        select '{entity}' as entity_name, * from (
            with x as (select *, coalesce({times}, null) as event_at from b_{entity})
            {" union all ".join(parts)}
            union all select 'duplicate_id', {key} from x group by 2 having count(*) > 1
            union all select 'single_date', '{entity}' from (
                select count(distinct cast(ingested_at as date)) as n from x) s where n < 2) e"""


query("val_ingestion", "entity_name " + _VIOLATION,
      lambda k: V.union_all([V.ingestion(k.bronze(e), e, HORIZON).select(F.lit(e).alias("entity_name"), "*") for e in schemas.EVENT_TIMES]),
      " union all ".join(_ingestion_sql(e) for e in schemas.EVENT_TIMES))
query("val_messages", _VIOLATION,
      lambda k: V.message_integrity(k.stg_messages, k.stg_conversations, k.stg_devices, k.closed),
      labelled(f"""select m.*, c_user_id, c_created_at, c_found, d_found, u_closed_at
          from stg_messages m
          left join {found('stg_conversations', 'conversation_id', 'c', 'user_id', 'created_at')} c
            using (conversation_id)
          left join {found('stg_devices', 'device_id', 'd')} d using (device_id)
          left join {found('closed_users', 'user_id', 'u', 'closed_at')} u
            on u.user_id = m.user_id""", "message_id", {
          "unknown_conversation": "conversation_id not in (select conversation_id from stg_conversations)"
                                  " or conversation_id is null",
          "user_mismatch": "not coalesce(user_id = c_user_id, true)",
          "unknown_device": "device_id not in (select device_id from stg_devices where device_id is not null)",
          "blank_text": "coalesce(length(trim(message_text)), 0) = 0",
          "before_conversation": "c_created_at > created_at",
          "after_close": "not coalesce(created_at < u_closed_at, true)"}))
query("val_sequence", _VIOLATION,
      lambda k: V.message_sequence(k.stg_messages, k.hot_rows),
      labelled("""select *, row_number() over w as expected, lag(created_at) over w as previous_at
          from (select *, coalesce(sequence_number, 0) as seq from stg_messages) m
          window w as (partition by conversation_id order by seq, message_id)""", "message_id", {
          "non_contiguous": "seq <> expected", "not_increasing": "created_at <= previous_at"}))
query("multi_day_conversations", "conversations:i multi_day_conversations:i",
      lambda k: V.multi_day_conversations(k.stg_messages), """
      select count(*) as conversations, count(*) filter (where d > 1) as multi_day_conversations
      from (select conversation_id, count(distinct cast(created_at as date)) as d
            from stg_messages group by 1) c""")
query("activity_skew",
      "users:i zero_users:i max_conversations:i top_share:f enough_inactive:b enough_heavy:b"
      " enough_concentration:b",
      lambda k: V.activity_skew(k.stg_users, k.stg_conversations), """
      with c as (select user_id, count(*) as n from stg_conversations group by 1),
      u as (select count(*) as users from stg_users),
      r as (select n, row_number() over (order by n desc, user_id) as rn from c),
      t as (select u.users, u.users - (select count(*) from c) as zero_users,
                   (select max(n) from c) as max_conversations,
                   (select sum(n) from r where rn <= greatest(1, floor(u.users * 0.05::double)))::double
                       / (select sum(n) from c) as top_share from u)
      select *, zero_users::double / users >= 0.15 as enough_inactive,
             max_conversations >= 31 as enough_heavy, top_share >= 0.20 as enough_concentration
      from t""")
query("val_completion_link", _VIOLATION,
      lambda k: V.completion_links(k.stg_completions, k.stg_messages),
      labelled(f"""select c.*, m_conversation_id, m_user_id, m_created_at, m_found
          from stg_completions c left join
          {found('stg_messages', 'message_id', 'm', 'conversation_id', 'user_id', 'created_at')} m
          using (message_id)""", "completion_id", {
          "unknown_message": "m_found is null",
          "conversation_mismatch": "conversation_id <> m_conversation_id",
          "user_mismatch": "user_id <> m_user_id",
          "requested_before_message": "requested_at < m_created_at"}))
query("val_inference_link", _VIOLATION,
      lambda k: V.inference_links(k.stg_inferences, k.stg_completions),
      labelled(f"""select i.*, c_user_id, c_completion_status, c_found
          from stg_inferences i left join
          {found('stg_completions', 'completion_id', 'c', 'user_id', 'completion_status')} c
          using (completion_id)""", "inference_id", {
          "unknown_completion": "c_found is null", "user_mismatch": "user_id <> c_user_id",
          "status_mismatch": "case when c_completion_status = 'SUCCESS'"
                             " then inference_status <> 'SUCCESS'"
                             " when c_completion_status <> 'SUCCESS'"
                             " then inference_status <> 'FAILED' end"}))
query("val_causal_chain", "completion_id inference_id",
      lambda k: V.broken_chains(k.stg_messages, k.stg_completions, k.stg_inferences), """
      select c.completion_id, i.inference_id
      from stg_completions c join stg_messages m using (message_id)
      join stg_inferences i on i.completion_id = c.completion_id
      where c.completion_status = 'SUCCESS'
        and not (m.created_at <= c.requested_at and c.requested_at <= i.request_at
                 and i.request_at < i.response_at and i.response_at <= c.completed_at)""")
query("val_inference_rules", _VIOLATION,
      lambda k: V.inference_rules(k.stg_inferences, k.stg_models),
      labelled(f"""select i.*, m_release_date, m_found from stg_inferences i left join
          {found('stg_models', 'model_id', 'm', 'release_date')} m using (model_id)""",
               "inference_id", {
          "unknown_model": "model_id is null or m_found is null",
          "before_release": "m_release_date > cast(request_at as date)",
          "input_tokens": "coalesce(input_tokens, 0) <= 0",
          "success_metrics": "inference_status = 'SUCCESS' and (response_at is null"
                             " or response_at <= request_at or coalesce(latency_ms, 0) <= 0"
                             " or coalesce(output_tokens, 0) <= 0)",
          "latency_mismatch": "inference_status = 'SUCCESS' and abs(round_even((epoch_us(response_at)"
                              " - epoch_us(request_at)) / 1000 - latency_ms, 0)) > 1",
          "failure_metrics": "inference_status = 'FAILED' and (response_at is not null"
                             " or latency_ms is not null or output_tokens is not null)"}))

# Bands of completion outcomes, of completions per message and feedback per success, and one inference each.
BANDS = [
    ("completion_status", "SUCCESS", 0.92, 0.96), ("completion_status", "FAILED", 0.03, 0.05),
    ("completion_status", "CANCELLED", 0.01, 0.03), ("completion_coverage", "messages", 0.98, 0.995),
    ("inferences_per_completion", "completions", 1.0, 1.0), ("feedback_rate", "SUCCESS", 0.05, 0.10),
]


def _measured(k):
    """Counts of each outcome, and counts of one entity against another."""
    total = F.lit(None).cast("bigint").alias("total")
    parts = [k.stg_completions.groupBy(F.col("completion_status").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("completion_status").alias("metric"), "value", "n", total)]
    success = k.stg_completions.filter(F.col("completion_status") == "SUCCESS")
    for metric, value, part, whole in (
        ("completion_coverage", "messages", k.stg_completions, k.stg_messages),
        ("inferences_per_completion", "completions", k.stg_inferences, k.stg_completions),
        ("feedback_rate", "SUCCESS", k.stg_feedback, success),
    ):
        both = part.select(F.lit(1).alias("p"), F.lit(0).alias("w")).unionByName(whole.select(F.lit(0).alias("p"), F.lit(1).alias("w")))
        parts.append(both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("total")).select(
            F.lit(metric).alias("metric"), F.lit(value).alias("value"), "n", "total"))
    return union_all(parts)


query("val_ratio_bands", "metric value n:i total:i share:f low:f high:f within:b",
      lambda k: V.ratio_bands(_measured(k), BANDS), f"""
      with counted(metric, value, n, total) as (
          select 'completion_status', completion_status, count(*), (select count(*) from stg_completions)
          from stg_completions group by completion_status
          union all select 'completion_coverage', 'messages', (select count(*) from stg_completions),
                           (select count(*) from stg_messages)
          union all select 'inferences_per_completion', 'completions', (select count(*) from stg_inferences),
                           (select count(*) from stg_completions)
          union all select 'feedback_rate', 'SUCCESS', (select count(*) from stg_feedback),
                           (select count(*) from stg_completions where completion_status = 'SUCCESS')),
      totals as (select metric, max(total) as total from counted group by metric),
      bands(metric, value, low, high) as (values {", ".join(str(b) for b in BANDS)}),
      shares as (
          select bands.*, coalesce(n, 0) as n, totals.total, coalesce(n::double / nullif(totals.total, 0), 0) as share
          from bands join totals using (metric) left join counted using (metric, value))
      select *, share between low and high as within from shares""")
query("val_feedback", _VIOLATION,
      lambda k: V.feedback_integrity(k.stg_feedback, k.stg_completions),
      labelled(f"""select f.*, c_user_id, c_completion_status, c_completed_at, c_found
          from stg_feedback f left join {found('stg_completions', 'completion_id', 'c', 'user_id',
                                               'completion_status', 'completed_at')} c
          using (completion_id)""", "feedback_id", {
          "unknown_completion": "c_found is null",
          "completion_not_successful": "c_completion_status <> 'SUCCESS'",
          "user_mismatch": "user_id <> c_user_id", "before_completion": "created_at < c_completed_at",
          "illegal_score": "case feedback_type when 'THUMBS_UP' then feedback_score <> 1"
                           " when 'THUMBS_DOWN' then feedback_score <> -1"
                           " when 'RATING' then feedback_score < 1 or feedback_score > 5 end"}))
_PARENTS = {"user": "stg_users", "conversation": "stg_conversations", "message": "stg_messages",
            "completion": "stg_completions", "inference": "stg_inferences"}
query("val_error_fk", _VIOLATION,
      lambda k: V.error_orphans(k.stg_errors, {n: getattr(k, t) for n, t in _PARENTS.items()}),
      " union all ".join(
          f"select 'unknown_{n}' as violation, e.error_id as row_id from stg_errors e"
          f" left join {t} p on p.{n}_id = e.{n}_id where e.{n}_id is not null and p.{n}_id is null"
          for n, t in _PARENTS.items()))
# Which columns of an error have to agree with a parent it names.
_AGREE = ", ".join(f"('{p}', '{c}')" for p, columns in (
    ("message", ("user", "conversation")), ("completion", ("user", "message", "conversation")),
    ("inference", ("completion", "user", "model"))) for c in columns)
view("error_references", "select error_id, error_source, error_type, replace(name, '_id', '') as ref, value from stg_errors unpivot include nulls ("
     " value for name in (user_id, conversation_id, message_id, completion_id, inference_id, model_id))")
view("parent_references", " union all ".join(
    f"select '{p}' as parent, {p}_id as parent_id, replace(name, '_id', '') as ref, value from {t} unpivot include nulls (value for name in ({columns}))"
    for p, t, columns in (
        ("message", "stg_messages", "user_id, conversation_id"),
        ("completion", "stg_completions", "user_id, message_id, conversation_id"),
        ("inference", "stg_inferences", "completion_id, user_id, model_id"))))
query("val_error_lineage", _VIOLATION,
      lambda k: V.error_lineage(k.stg_errors, k.stg_messages, k.stg_completions, k.stg_inferences), f"""
      select distinct a.parent || '_lineage' as violation, e.error_id as row_id
      from (values {_AGREE}) a(parent, ref)
      join error_references named on named.ref = a.parent and named.value is not null
      join error_references e on e.error_id = named.error_id and e.ref = a.ref
      left join parent_references p on p.parent = a.parent and p.parent_id = named.value and p.ref = a.ref
      where e.value <> p.value or (a.parent = 'inference' and e.value is null)""")
# What errors of a source must not hold.
_BARRED = ", ".join(f"('{label}', '{source}', '{ref}')" for label, sources, refs in (
    ("application_context", ("APPLICATION", "DATABASE"), ("completion", "inference", "model")),
    ("billing_context", ("BILLING",), ("conversation", "message", "completion", "inference", "model")))
    for source in sources for ref in refs)
_CODES = ", ".join(f"('{s}', '{t}', '{c}')" for (s, t), c in schemas.ERROR_CODES.items())
query("val_error_context", _VIOLATION, lambda k: V.error_context(k.stg_errors), f"""
      with held as (
          select error_id, error_source, bool_or(ref = 'model') as model, bool_or(ref = 'inference') as inference,
                 bool_or(ref in ('user', 'conversation', 'message', 'completion')) as request
          from error_references where value is not null group by 1, 2),
      codes(error_source, error_type, code) as (values {_CODES})
      select distinct label as violation, error_id as row_id
      from error_references e join (values {_BARRED}) b(label, error_source, ref) using (error_source, ref)
      where value is not null
      union all
      select 'model_context', error_id from stg_errors left join held using (error_id, error_source)
      where error_source = 'MODEL' and (not coalesce(model, false) or (request and not inference))
      union all
      select 'unknown_type', error_id from stg_errors anti join codes using (error_source, error_type)
      union all
      select 'wrong_code', error_id from stg_errors join codes using (error_source, error_type) where error_code <> code""")
_BASE = "case x.field_name " + " ".join(
    f"when '{f}' then u.{f}" for f in schemas.UPDATE_FIELDS) + " end"
query("val_update_chain", _VIOLATION,
      lambda k: V.update_chain(k.stg_user_updates, k.stg_users, k.hot_rows, k.cut),
      labelled(f"""select x.*, u.user_id is not null as u_found, u.signup_at,
              lag(x.updated_at) over (partition by x.user_id order by x.updated_at, x.update_id)
                  as previous_at,
              case when row_number() over f = 1 then {_BASE} else lag(x.new_value) over f end as state
          from stg_user_updates x left join stg_users u on u.user_id = x.user_id
          window f as (partition by x.user_id, x.field_name order by x.updated_at, x.update_id)""",
               "update_id", {
          "unknown_user": "not u_found",
          "unknown_field": f"field_name not in {schemas.UPDATE_FIELDS}",
          "unchanged": "old_value is not distinct from new_value",
          "not_after_previous": "updated_at <= coalesce(previous_at, signup_at)",
          "broken_chain": "u_found and old_value is distinct from state",
          "illegal_transition": "field_name = 'account_status' and coalesce((old_value, new_value)"
                                " not in (('ACTIVE', 'SUSPENDED'), ('SUSPENDED', 'ACTIVE'),"
                                " ('ACTIVE', 'CLOSED'), ('SUSPENDED', 'CLOSED')), true)"}))
query("val_users", _VIOLATION,
      lambda k: V.user_rules(k.users_with_shared_email, "2023-12-03 00:00:00", "2024-01-12 00:00:00"),
      labelled("select * from shared_email_users", "user_id", {
          "email_format": r"not regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')",
          "email_missing": "email is null",
          "country_format": "not regexp_matches(country_code, '^[A-Z]{2}$')",
          "status": "coalesce(account_status, '') not in ('ACTIVE', 'SUSPENDED', 'CLOSED')",
          "window": "signup_at < timestamp '2023-12-03 00:00:00'"
                    " or signup_at >= timestamp '2024-01-12 00:00:00'",
          "source_missing": "signup_source is null"},
          """select 'email_shared', user_id from shared_email_users where email in
             (select email from shared_email_users group by 1 having count(*) > 1)"""))
query("val_subscriptions", _VIOLATION,
      lambda k: V.subscription_timeline(k.stg_subscriptions, k.stg_users, k.stg_plans, k.closed,
                                        HORIZON, CUTOVER, k.hot_rows),
      labelled("""select s.*, u.user_id is not null as u_found, p.plan_id is not null as p_found,
              u.signup_at, p.plan_name, p.monthly_price, c.closed_at,
              row_number() over w as n, lag(s.ended_at) over w as previous_end
          from stg_subscriptions s left join stg_users u on u.user_id = s.user_id
          left join stg_plans p on p.plan_id = s.plan_id
          left join closed_users c on c.user_id = s.user_id
          window w as (partition by s.user_id order by s.started_at, s.subscription_id)""",
               "subscription_id", {
          "unknown_parent": "not u_found or not p_found",
          "timing": "started_at < signup_at or updated_at < started_at or ended_at < started_at",
          "status_end": "(subscription_status = 'ACTIVE') <> (ended_at is null)",
          "price": "actual_monthly_price < 0 or actual_monthly_price > monthly_price"
                   " or (plan_name = 'FREE') <> (actual_monthly_price = 0)",
          "first_not_free": "n = 1 and (plan_name <> 'FREE' or started_at <> signup_at)",
          "overlap": "n > 1 and (previous_end is null or previous_end > started_at)",
          "after_close": "started_at > closed_at or updated_at > closed_at or ended_at > closed_at",
          "plan_cutover": f"plan_name <> 'FREE' and right(plan_id, 2) <>"
                          f" case when started_at < timestamp '{CUTOVER}' then 'v1' else 'v2' end",
          "beyond_horizon": f"greatest(updated_at, ended_at) > timestamp '{HORIZON}'"},
          """select 'several_active', user_id from stg_subscriptions
             where subscription_status = 'ACTIVE' group by 2 having count(*) > 1
             union all select 'no_lifecycle', user_id from stg_users
             where user_id not in (select user_id from stg_subscriptions where user_id is not null)"""))
query("val_purchases", _VIOLATION,
      lambda k: V.purchase_rules(k.stg_purchases, k.stg_subscriptions, k.stg_plans, HORIZON),
      labelled("""select b.*, s.subscription_id is not null as s_found, s.user_id as s_user_id,
              s.plan_id as s_plan_id, s.started_at, s.ended_at, p.plan_name
          from stg_purchases b left join stg_subscriptions s on s.subscription_id = b.subscription_id
          left join stg_plans p on p.plan_id = s.plan_id""", "purchase_id", {
          "unknown_subscription": "not s_found",
          "lineage": "user_id <> s_user_id or plan_id <> s_plan_id",
          "free_plan": "plan_name = 'FREE'",
          "type": "coalesce(purchase_type, '') not in ('NEW_SUBSCRIPTION', 'RENEWAL', 'UPGRADE')",
          "outside_period": "purchase_created_at < started_at or purchase_created_at"
                            f" >= coalesce(ended_at, timestamp '{HORIZON}')",
          "update_order": "updated_at < purchase_created_at",
          "money_sign": "least(subtotal_amount, discount_amount, tax_amount, total_amount) < 0"
                        " or discount_amount > subtotal_amount",
          "money_identity": "total_amount <> subtotal_amount - discount_amount + tax_amount"})
      .replace("purchase_created_at >= coalesce(ended_at",
               "s_found and purchase_created_at >= coalesce(ended_at"))
query("val_payments", _VIOLATION,
      lambda k: V.payment_rules(k.stg_payments, k.stg_purchases),
      labelled("""select p.*, b.purchase_id is not null as b_found, b.user_id as b_user_id,
              b.total_amount, b.purchase_created_at
          from stg_payments p left join stg_purchases b on b.purchase_id = p.purchase_id""",
               "payment_id", {
          "unknown_purchase": "not b_found", "user_mismatch": "user_id <> b_user_id",
          "method": "payment_method is null", "amount": "payment_amount <> total_amount",
          "before_purchase": "processed_at < purchase_created_at",
          "update_order": "updated_at < processed_at",
          "refund": "payment_status = 'REFUNDED' and (refunded_at is null"
                    " or refunded_at <= processed_at or updated_at < refunded_at"
                    " or refund_amount <= 0 or refund_amount > payment_amount)",
          "unexpected_refund": "payment_status <> 'REFUNDED' and (refunded_at is not null"
                               " or refund_amount <> 0)"}))
query("purchase_status_check", "purchase_id purchase_status implied_status unordered_attempts:b",
      lambda k: V.purchase_status_gaps(k.stg_purchases, k.stg_payments, k.hot_rows), """
      with a as (select purchase_id,
                        case when bool_or(payment_status = 'REFUNDED') then 'REFUNDED'
                             when bool_or(payment_status = 'SUCCESS') then 'COMPLETED'
                             else 'FAILED' end as implied_status,
                        count(*) <> count(distinct processed_at) as unordered
                 from stg_payments group by 1)
      select coalesce(p.purchase_id, a.purchase_id) as purchase_id, p.purchase_status,
             coalesce(a.implied_status, 'NO_ATTEMPT') as implied_status,
             coalesce(a.unordered, false) as unordered_attempts
      from stg_purchases p full outer join a on a.purchase_id = p.purchase_id
      where p.purchase_status is distinct from coalesce(a.implied_status, 'NO_ATTEMPT')
         or coalesce(a.unordered, false)""")
query("val_models", _VIOLATION, lambda k: V.catalogue_rules(k.model_catalogue, k.hot_rows),
      labelled("""select *, lag(release_date) over (partition by model_name, provider
                      order by coalesce(try_cast(split_part(model_version, '.', 1) as int), -1),
                               coalesce(try_cast(split_part(model_version, '.', 2) as int), -1),
                               model_id) as previous_release
                  from model_catalogue""", "model_id", {
          "release_order": "release_date < previous_release",
          "version_not_numeric": "not regexp_matches(model_version, '^[0-9]+([.][0-9]+)*$')",
          "release_missing": "release_date is null", "flag_missing": "active_flag is null"},
          """select 'repeated_entry', model_id from model_catalogue
             where (model_name, model_version, provider) in
                   (select (model_name, model_version, provider) from model_catalogue
                    group by model_name, model_version, provider having count(*) > 1)
             union all select 'repeated_id', model_id from model_catalogue
             group by model_id having count(*) > 1"""))
query("model_adoption",
      "newest_model recent_total:i recent_active:i early_total:i early_newest:i latest_total:i"
      " latest_newest:i active_dominate:b adoption_grows:b",
      lambda k: V.model_adoption(k.stg_inferences, k.stg_models, HORIZON, recent_days=20, edge_days=75),
      f"""
      with n as (select max_by(model_id, (release_date, model_id)) as newest_model,
                        max(release_date) as released from stg_models),
      s as (select max(n.newest_model) as newest_model,
              count(*) filter (where request_at >= h - interval 20 day) as recent_total,
              count(*) filter (where request_at >= h - interval 20 day
                               and coalesce(m.active_flag, false)) as recent_active,
              count(*) filter (where e) as early_total,
              count(*) filter (where e and i.model_id = n.newest_model) as early_newest,
              count(*) filter (where request_at >= h - interval 75 day) as latest_total,
              count(*) filter (where request_at >= h - interval 75 day
                               and i.model_id = n.newest_model) as latest_newest
            from (select *, timestamp '{HORIZON}' as h,
                         request_at >= (select released from n)
                         and request_at < (select released from n) + interval 75 day as e
                  from stg_inferences) i
            left join stg_models m on m.model_id = i.model_id, n)
      select *, recent_active::double / nullif(recent_total, 0) >= 0.75 as active_dominate,
             coalesce(latest_newest::double / nullif(latest_total, 0), 0)
                 > coalesce(early_newest::double / nullif(early_total, 0), 0) * 1.5 as adoption_grows
      from s""")

DAY = "2024-01-16"
# Entities whose new rows are checked as they land.
_LANDED = ("user_updates", "messages", "completions", "model_inferences", "feedback", "errors", "subscriptions", "purchases", "payments")
view("day_labels", f"""
    with m as (select * from b_messages where dt = date '{DAY}'),
    k as (select * from b_completions where dt = date '{DAY}'),
    i as (select * from b_model_inferences where dt = date '{DAY}'),
    y as (select * from b_payments where dt = date '{DAY}'),
    b as (select * from b_purchases where dt = date '{DAY}'),
    x as (select * from b_user_updates where dt = date '{DAY}'),
    mj as (select m.*, u.user_id is not null as u_found, c.user_id as c_user_id,
                  c.created_at as c_created_at
           from m left join stg_users u on u.user_id = m.user_id
           left join stg_conversations c on c.conversation_id = m.conversation_id),
    kj as (select k.*, d.message_id as found, d.user_id as m_user_id, d.created_at as m_created_at
           from k left join (select distinct on (message_id) * from m) d using (message_id)),
    ij as (select i.*, d.completion_id is not null as c_found, o.release_date
           from i left join (select distinct completion_id from k) d using (completion_id)
           left join stg_models o on o.model_id = i.model_id),
    yj as (select y.*, d.purchase_id as found, d.user_id as b_user_id, d.purchase_created_at
           from y left join (select distinct on (purchase_id) * from b) d using (purchase_id))
    select 'user_updates.user_id' as violation from x
    where user_id not in (select user_id from stg_users)
    union all select 'user_updates.updated_at' from x where cast(updated_at as date) <> date '{DAY}'
    union all select 'messages.reference' from mj
    where not u_found or c_user_id is null or c_user_id <> user_id
    union all select 'messages.causality' from mj
    where u_found and c_user_id = user_id and created_at < c_created_at
    union all select 'completions.reference' from kj
    where found is null or user_id is distinct from m_user_id
    union all select 'completions.causality' from kj
    where user_id is not distinct from m_user_id
      and not (m_created_at <= requested_at and requested_at <= completed_at)
    union all select 'model_inferences.reference' from ij
    where not c_found or release_date is null or release_date > cast(request_at as date)
    union all select 'model_inferences.causality' from ij where response_at < request_at
    union all select 'payments.reference' from yj where found is null or b_user_id <> user_id
    union all select 'payments.causality' from yj
    where b_user_id = user_id and processed_at < purchase_created_at
    {" ".join(f"union all select '{e}.duplicate_new_id' from (select {schemas.ENTITY_ID[e]}"
              f" from b_{e} where dt = date '{DAY}' group by 1 having count(*) > 1) z"
              for e in _LANDED)}
    {" ".join(f"union all select '{e}.partition' from b_{e} where dt = date '{DAY}' and"
              f" cast(ingested_at as date) is distinct from date '{DAY}'" for e in _LANDED)}
    union all select 'user_updates.closed_before_activity_end' from x
    where field_name = 'account_status' and new_value = 'CLOSED'
      and exists (select 1 from m where m.user_id = x.user_id and m.created_at >= x.updated_at)
    union all select 'feedback.reference' from b_feedback f
    where dt = date '{DAY}' and (not exists (select 1 from k where k.completion_id = f.completion_id)
                                 or not exists (select 1 from stg_users u where u.user_id = f.user_id))
    union all select 'subscriptions.reference' from b_subscriptions s
    where dt = date '{DAY}' and (not exists (select 1 from stg_plans p where p.plan_id = s.plan_id)
                                 or not exists (select 1 from stg_users u where u.user_id = s.user_id))
    union all select 'purchases.reference' from b
    where not exists (select 1 from stg_subscriptions s where s.subscription_id = b.subscription_id
                      and s.user_id is not distinct from b.user_id)""")
query("val_day", "violation rows:i",
      lambda k: V.day_violations(
          {"users": k.stg_users, "conversations": k.stg_conversations, "models": k.stg_models,
           "plans": k.stg_plans, "known_subscriptions": k.stg_subscriptions,
           **{e: k.bronze(e) for e in _LANDED}}, DAY),
      "select violation, count(*) as rows from day_labels group by 1")
query("defect_counts", "entity_name kind n:i",
      lambda k: V.defect_counts({e: k.bronze(e) for e in (*V.DEFECT_COLUMNS, "conversations")}),
      " union all ".join(
          f"select '{e}' as entity_name, 'missing' as kind, count(*) filter (where {c} is null) as n"
          f" from b_{e} union all select '{e}', 'duplicate', count(*) - count(distinct"
          f" {schemas.ENTITY_ID[e]}) from b_{e}" for e, c in V.DEFECT_COLUMNS.items()) + """
      union all select 'messages', 'temporal', count(distinct m.message_id) from b_messages m
      join b_conversations c using (conversation_id) where m.created_at < c.created_at
      union all select 'completions', 'temporal', count(distinct completion_id) from b_completions
      where completed_at < requested_at
      union all select 'model_inferences', 'temporal', count(distinct inference_id)
      from b_model_inferences where response_at < request_at
      union all select 'payments', 'temporal', count(distinct p.payment_id) from b_payments p
      join b_purchases b using (purchase_id) where p.processed_at < b.purchase_created_at""")
