"""Distribution summaries, defects and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.oracle import view
from tidemark.catalog.registry import query
from tidemark.operators import defects as D
from tidemark.operators import profiling as P
from tidemark.operators.monitoring import union_all
from tidemark.plans.lake import DEFECT_HORIZON, SEED
from tidemark.sources.damage import JSON_LINES, damaged_dirty
from tidemark.sources.tables import TABLE_DDL

HORIZON = "2024-02-01 00:00:00"

# summaries -------------------------------------------------------------------------------

_SUMMARY = "n:i average:f median:i p95:i p99:i maximum:i"
query("metric_summary", _SUMMARY,
      lambda k: P.metric_summary(k.table("events"), F.col("value"), k.hot_rows), """
      select count(*) as n, avg(v) as average, quantile_disc(v, 0.5) as median,
             quantile_disc(v, 0.95) as p95, quantile_disc(v, 0.99) as p99, max(v) as maximum
      from (select cast(round_even(value, 0) as bigint) as v from events) e""")
_DELAY = "floor((epoch_us(ingested_at) - epoch_us(created_at)) / 1000000)"
query("pct_floor", "n:i median:i p95:i p99:i maximum:i",
      lambda k: P.delay_percentiles(
          k.bronze("messages"),
          F.floor((F.unix_micros("ingested_at") - F.unix_micros("created_at")) / 1_000_000),
          k.hot_rows), f"""
      with r as (select v, row_number() over (order by v) as rn, count(*) over () as n
                 from (select cast({_DELAY} as bigint) as v from b_messages) e)
      select max(n) as n, max(v) filter (where rn = greatest(1, floor(n * 0.5::double))) as median,
             max(v) filter (where rn = greatest(1, floor(n * 0.95::double))) as p95,
             max(v) filter (where rn = greatest(1, floor(n * 0.99::double))) as p99,
             max(v) as maximum from r""")
query("correlation", "pair correlation:f",
      lambda k: P.correlation(
          k.stg_inferences.filter(F.col("output_tokens").isNotNull()),
          {"latency_output": (F.col("latency_ms"), F.col("output_tokens")),
           "input_output": (F.col("input_tokens"), F.col("output_tokens")),
           "constant": (F.col("input_tokens"), F.lit(1))}), """
      with s as (select * from stg_inferences where output_tokens is not null)
      select 'latency_output' as pair, coalesce(corr(latency_ms, output_tokens), 0) as correlation from s
      union all select 'input_output', coalesce(corr(input_tokens, output_tokens), 0) from s
      union all select 'constant', 0.0""")
_ARRIVING = tuple(schemas.EVENT_TIMES)
query("late_arrivals",
      "entity_name total:i same_minute:i same_day:i next_day:i over_one_day:i partitions:i"
      " earliest:t latest:t",
      lambda k: P.late_arrivals({e: k.bronze(e) for e in _ARRIVING}),
      " union all ".join(f"""
      select '{e}' as entity_name, count(*) as total,
             count(*) filter (where epoch_us(ingested_at) - epoch_us(ev) < 60000000) as same_minute,
             count(*) filter (where cast(ingested_at as date) = cast(ev as date)) as same_day,
             count(*) filter (where cast(ingested_at as date) = cast(ev as date) + 1) as next_day,
             count(*) filter (where epoch_us(ingested_at) - epoch_us(ev) > 86400000000) as over_one_day,
             count(distinct cast(ingested_at as date)) as partitions,
             min(cast(ingested_at as date)) as earliest, max(cast(ingested_at as date)) as latest
      from (select *, coalesce({", ".join(schemas.EVENT_TIMES[e])}, null) as ev from b_{e}) x"""
                         for e in _ARRIVING))
query("user_buckets", "bucket users:i",
      lambda k: P.user_buckets(k.stg_users, k.stg_conversations), """
      select case when n = 0 then '0' when n <= 2 then '1-2' when n <= 10 then '3-10'
                  when n <= 30 then '11-30' when n <= 100 then '31-100' else '100+' end as bucket,
             count(*) as users
      from (select u.user_id, count(c.conversation_id) as n from stg_users u
            left join stg_conversations c using (user_id) group by 1) x group by 1""")
query("conversation_stats",
      "conversations:i messages:i average:f median:f p95:i p99:i maximum:i multi_day_conversations:i",
      lambda k: P.conversation_stats(k.stg_messages, k.hot_rows), """
      with c as (select conversation_id, count(*) as n, count(distinct cast(created_at as date)) as d
                 from stg_messages group by 1),
      r as (select *, row_number() over (order by n) as rn, count(*) over () as t from c)
      select max(t) as conversations, sum(n) as messages, sum(n)::double / max(t) as average,
             quantile_cont(n, 0.5) as median,
             max(n) filter (where rn = greatest(1, floor(t * 0.95::double))) as p95,
             max(n) filter (where rn = greatest(1, floor(t * 0.99::double))) as p99,
             max(n) as maximum, count(*) filter (where d > 1) as multi_day_conversations from r""")
query("platform_split", "platform messages:i",
      lambda k: P.platform_split(k.stg_messages, k.stg_devices), """
      select case when m.device_id is null then 'NULL' else d.app_platform end as platform,
             count(*) as messages
      from stg_messages m left join stg_devices d using (device_id) group by 1""")
query("latency_by_model", "model_id n:i median:i p95:i",
      lambda k: P.latency_by_model(k.stg_inferences), """
      select model_id, count(*) as n, quantile_disc(latency_ms, 0.5) as median,
             quantile_disc(latency_ms, 0.95) as p95
      from stg_inferences where latency_ms is not null and model_id is not null group by 1""")
_POS = "(feedback_type = 'THUMBS_UP' or (feedback_type = 'RATING' and feedback_score >= 4))"
query("feedback_by_model", "model_id successes:i feedback_count:i feedback_rate:f positive_rate:f",
      lambda k: P.feedback_by_model(k.stg_feedback, k.stg_completions, k.stg_inferences), f"""
      with i as (select completion_id, model_id from stg_inferences where model_id is not null),
      s as (select model_id, count(*) as successes from stg_completions join i using (completion_id)
            where completion_status = 'SUCCESS' group by 1),
      f as (select model_id, count(*) as n, count(*) filter (where {_POS}) as p
            from stg_feedback join i using (completion_id) group by 1)
      select model_id, successes, coalesce(n, 0) as feedback_count,
             coalesce(n::double / successes, 0) * 100 as feedback_rate,
             coalesce(p::double / nullif(n, 0), 0) * 100 as positive_rate
      from s left join f using (model_id)""")
query("feedback_per_user", "max_per_user:i mean_per_user:f users:i",
      lambda k: P.feedback_per_user(k.stg_feedback),
      "select max(n) as max_per_user, avg(n) as mean_per_user, count(*) as users"
      " from (select user_id, count(*) as n from stg_feedback group by 1) x")
query("error_summary", "dimension value n:i",
      lambda k: P.error_summary(k.stg_errors, k.stg_inferences),
      " union all ".join(
          f"select '{c}' as dimension, coalesce({c}, 'NULL') as value, count(*) as n"
          " from stg_errors group by 2"
          for c in ("error_source", "error_type", "severity", "model_id"))
      + "".join(f" union all select 'context', '{c}', count({c}) from stg_errors"
                for c in P.CONTEXT_COLUMNS)
      + """ union all select 'linked_failures', 'MODEL', count(distinct e.inference_id)
            from stg_errors e join stg_inferences i using (inference_id)
            where e.error_source = 'MODEL' and i.inference_status = 'FAILED'""")
query("plan_transitions", "transition n:i",
      lambda k: P.plan_transitions(k.stg_subscriptions, k.stg_plans, k.hot_rows), """
      select case when prev in ('PLUS', 'PRO') and plan_name = 'FREE' then 'paid -> FREE'
                  else concat(prev, ' -> ', plan_name) end as transition, count(*) as n
      from (select p.plan_name, lag(p.plan_name) over (partition by s.user_id
                       order by s.started_at, s.subscription_id) as prev
            from stg_subscriptions s join stg_plans p using (plan_id)) x
      where prev is not null and prev <> plan_name group by 1""")
query("plan_adoption",
      "users:i ever_plus:i ever_pro:i ever_paid:i never_paid:i current_free:i current_plus:i"
      " current_pro:i mean_paid_days:f",
      lambda k: P.plan_adoption(k.stg_subscriptions, k.stg_plans, k.stg_users, HORIZON), f"""
      select u as users, a.*, u - ever_paid as never_paid from (
          select count(distinct user_id) filter (where plan_name = 'PLUS') as ever_plus,
                 count(distinct user_id) filter (where plan_name = 'PRO') as ever_pro,
                 count(distinct user_id) filter (where plan_name <> 'FREE') as ever_paid,
                 count(*) filter (where act and plan_name = 'FREE') as current_free,
                 count(*) filter (where act and plan_name = 'PLUS') as current_plus,
                 count(*) filter (where act and plan_name = 'PRO') as current_pro,
                 avg((epoch_us(coalesce(ended_at, timestamp '{HORIZON}')) - epoch_us(started_at))
                     / 86400000000.0) filter (where plan_name <> 'FREE') as mean_paid_days
          from (select *, subscription_status = 'ACTIVE' as act from stg_subscriptions
                join stg_plans using (plan_id)) s) a, (select count(*) as u from stg_users) t""")
query("attempt_outcomes", "attempts outcome purchases:i",
      lambda k: P.attempt_outcomes(k.stg_payments), """
      select case n when 1 then '1' when 2 then '2' else '3+' end as attempts,
             case when first_paid then 'first_success' when any_paid then 'success_after_retry'
                  else 'all_failed' end as outcome, count(*) as purchases
      from (select purchase_id, count(*) as n, bool_or(paid) as any_paid,
                   bool_or(paid and rn = 1) as first_paid
            from (select *, payment_status in ('SUCCESS', 'REFUNDED') as paid, row_number() over
                      (partition by purchase_id order by processed_at, payment_id) as rn
                  from stg_payments) p group by 1) x group by 1, 2""")
query("money_rollup", "gross:m discounts:m tax:m completed:m refunds:m net_collected:m",
      lambda k: P.money_rollup(k.stg_purchases, k.stg_payments), """
      select *, completed - refunds as net_collected from (
          select sum(subtotal_amount) as gross, sum(discount_amount) as discounts,
                 sum(tax_amount) as tax,
                 sum(case when purchase_status in ('COMPLETED', 'REFUNDED') then total_amount
                          else 0 end) as completed from stg_purchases) a,
          (select sum(refund_amount) as refunds from stg_payments) b""")
query("update_buckets", "bucket users:i",
      lambda k: P.update_buckets(k.stg_users, k.stg_user_updates), """
      select case n when 0 then '0' when 1 then '1' else '2+' end as bucket, count(*) as users
      from (select u.user_id, count(x.update_id) as n from stg_users u
            left join stg_user_updates x using (user_id) group by 1) y group by 1""")

# defects ---------------------------------------------------------------------------------

_PARENT = {"messages": ("conversations", "conversation_id", "created_at"),
           "payments": ("purchases", "purchase_id", "purchase_created_at")}


def _fraction(entity: str, key: str, word: int = 0) -> str:
    return (f"cast(concat('0x', substr(sha256(concat('{SEED}:{entity}:', {key})), {1 + 16 * word}, 16))"
            " as ubigint)::double / 18446744073709551616.0::double")


def _iso(c: str) -> str:
    return (f"case when epoch_us({c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
            f" else strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ') end")


def _defect_views(entity: str) -> None:
    plan, key = D.PLANS[entity], schemas.ENTITY_ID[entity]
    join, base = "", plan.timestamp_base
    if entity in _PARENT:
        p, k, at = _PARENT[entity]
        join = f"left join (select {k}, {at} as parent_at from clean_{p}) p using ({k})"
    a, b = plan.missing_rate, plan.missing_rate + plan.duplicate_rate
    c = b + plan.timestamp_rate
    possible = f"when fr < {a}::double then case when {plan.missing_field} is not null then '{D.MISSING}' end"
    possible += (f" when fr < {b}::double then case when ingested_at < timestamp '{DEFECT_HORIZON}'"
                 f" then '{D.DUPLICATE}' end")
    shifted = "cast(null as timestamp)"
    if plan.timestamp_field:
        cond = f"{base} is not null"
        if base != "parent_at":
            cond += f" and {plan.timestamp_field} is not null"
        possible += f" when fr < {c}::double then case when {cond} then '{D.TEMPORAL}' end"
        shifted = f"{base} - to_seconds(1 + cast(floor(({_fraction(entity, key, 2)}) * 3600) as bigint))"
    view(f"lab_{entity}", f"""
        select *, case {possible} end as issue from (
            select x.*, {_fraction(entity, key)} as fr,
                   least(timestamp '{DEFECT_HORIZON}', ingested_at + to_seconds(300
                       + cast(floor(({_fraction(entity, key, 1)}) * 129300) as bigint))) as replay_at,
                   {shifted} as shifted_at
            from (select * from clean_{entity} {join}) x) y""")
    cols = []
    for col in schemas.entity_columns(entity):
        if col == plan.missing_field:
            cols.append(f"case when issue = '{D.MISSING}' then null else {col} end as {col}")
        elif col == plan.timestamp_field:
            cols.append(f"case when issue = '{D.TEMPORAL}' then shifted_at else {col} end as {col}")
        else:
            cols.append(col)
    text = ", ".join(cols)
    view(f"dirty_{entity}", f"""
        select {text}, ingested_at, cast(ingested_at as date) as dt from lab_{entity}
        union all select {text}, replay_at, cast(replay_at as date) from lab_{entity}
        where issue = '{D.DUPLICATE}'""")
    field = plan.timestamp_field
    view(f"log_{entity}", f"""
        select concat('inj_', substr(sha256(concat('{SEED}:{entity}:', {key}, ':', issue)), 1, 24))
                   as injection_id,
               '{entity}' as entity_name, {key} as source_record_id, issue as issue_type,
               case issue when '{D.MISSING}' then '{plan.missing_field}'
                    when '{D.DUPLICATE}' then 'ingested_at' else '{field}' end as field_name,
               case issue when '{D.MISSING}' then {plan.missing_field}
                    when '{D.DUPLICATE}' then {_iso('ingested_at')}
                    {f"else {_iso(field)}" if field else ""} end as original_value,
               case issue when '{D.DUPLICATE}' then {_iso('replay_at')}
                    when '{D.TEMPORAL}' then {_iso('shifted_at')} end as injected_value,
               {_iso('ingested_at')} as original_ingested_at,
               case issue when '{D.DUPLICATE}' then {_iso('replay_at')}
                    else {_iso('ingested_at')} end as dirty_ingested_at,
               case issue when '{D.MISSING}' then 'NULL_REQUIRED_FIELD'
                    when '{D.DUPLICATE}' then case when cast(replay_at as date)
                         = cast(ingested_at as date) then 'REPLAY_SAME_DAY' else 'REPLAY_CROSS_DAY' end
                    else '{plan.violation}' end as violation_type
        from lab_{entity} where issue is not null""")


for _e in D.PLANS:
    _defect_views(_e)
view("defect_log", " union all ".join(f"select * from log_{e}" for e in D.PLANS))

query("stable_fraction", "payment_id fraction:f second:f",
      lambda k: k.clean("payments").select(
          "payment_id",
          D.stable_fraction(SEED, "payments", F.col("payment_id")).alias("fraction"),
          D.stable_fraction(SEED, "payments", F.col("payment_id"), 1).alias("second")),
      f"select payment_id, {_fraction('payments', 'payment_id')} as fraction,"
      f" {_fraction('payments', 'payment_id', 1)} as second from clean_payments")
query("defect_select", "payment_id issue",
      lambda k: k.labelled("payments").filter(F.col("issue").isNotNull()),
      "select payment_id, issue from lab_payments where issue is not null")
query("inject_defects",
      "message_id conversation_id user_id message_text created_at:t ingested_at:t dt:t",
      lambda k: k.dirty("messages"), "select * from dirty_messages")
query("defect_manifest",
      "injection_id entity_name source_record_id issue_type field_name original_value"
      " injected_value original_ingested_at dirty_ingested_at violation_type",
      lambda k: k.defect_log, "select * from defect_log")
for _e in D.PLANS:
    view(f"damaged_dirty_{_e}", damaged_dirty(_e, schemas.entity_columns(_e), schemas.ENTITY_ID[_e], f"dirty_{_e}"))


def _reconcile_sql(entity: str) -> str:
    plan, key = D.PLANS[entity], schemas.ENTITY_ID[entity]
    columns = [c for c in schemas.entity_columns(entity) if c != key]

    def same(*skip: str) -> str:
        return " and ".join(f"d.{c} is not distinct from c.{c}" for c in columns if c not in skip)

    gap, at = plan.missing_field, plan.timestamp_field
    temporal = f"{_iso(f'd.{at}')} = g.injected_value and {same(at)} and d.ingested_at = c.ingested_at" if at else "false"
    expected = f"case when issue_type = '{D.DUPLICATE}' then 2 else 1 end"
    return f"""
      select '{entity}' as entity_name, id as record_id, issue_type, copies, unnest(list_filter([
             case when not in_clean and in_log then 'MANIFEST_WITHOUT_CLEAN' end,
             case when not in_clean and not in_log then 'DIRTY_WITHOUT_CLEAN' end,
             case when in_clean and copies <> {expected} then 'COPY_COUNT' end,
             case when in_clean and wrong > 0 then 'CONTENT' end,
             case when in_clean and issue_type = '{D.DUPLICATE}' and times <> 2 then 'REPLAY_TIME' end],
             lambda f: f is not null)) as failure
      from (
          select id, max(issue_type) as issue_type, bool_or(in_clean) as in_clean, bool_or(in_log) as in_log,
                 count(dirty_id) as copies, count(*) filter (where dirty_id is not null and not coalesce(good, false)) as wrong,
                 count(distinct ingested_at) as times
          from (
              select coalesce(c.{key}, g.source_record_id, d.{key}) as id, g.issue_type,
                     c.{key} is not null as in_clean, g.source_record_id is not null as in_log,
                     d.{key} as dirty_id, d.ingested_at,
                     case g.issue_type
                         when '{D.MISSING}' then d.{gap} is null and c.{gap} is not null
                             and {same(gap)} and d.ingested_at = c.ingested_at
                         when '{D.DUPLICATE}' then {same()} and (d.ingested_at = c.ingested_at
                             or {_iso('d.ingested_at')} = g.dirty_ingested_at)
                         when '{D.TEMPORAL}' then {temporal}
                         else {same()} and d.ingested_at is not distinct from c.ingested_at end as good
              from clean_{entity} c
              full outer join log_{entity} g on g.source_record_id = c.{key}
              full outer join damaged_dirty_{entity} d on d.{key} = coalesce(c.{key}, g.source_record_id)) j
          group by id) p"""


query("manifest_reconcile", "entity_name record_id issue_type copies:i failure",
      lambda k: union_all([
          D.reconcile_settled(k.before_defects(e), k.damaged_dirty(e), k.log(e), e, cut=k.cut).select(F.lit(e).alias("entity_name"), "*")
          for e in D.PLANS]),
      " union all ".join(_reconcile_sql(e) for e in D.PLANS))
query("manifest_summary",
      "level:i entity_name issue_type field_name violation_type issue_count:i affected_records:i"
      " affected_pct:f",
      lambda k: D.manifest_summary(
          k.defect_log,
          P.entity_summary({e: k.clean(e) for e in D.PLANS}).select("entity_name", "rows")), f"""
      with r as ({" union all ".join(f"select '{e}' as entity_name, count(*) as n from clean_{e}"
                                     for e in D.PLANS)}),
      g as (select grouping(entity_name, issue_type, field_name, violation_type) as level,
                   entity_name, issue_type, field_name, violation_type, count(*) as issue_count,
                   count(distinct source_record_id) as affected_records
            from defect_log group by grouping sets ((entity_name), (entity_name, issue_type),
                 (entity_name, issue_type, field_name), (entity_name, issue_type, violation_type)))
      select g.*, affected_records * 100.0::double / r.n as affected_pct
      from g left join r using (entity_name)""")
query("manifest_counts", "issue_type violation_type issue_count:i",
      lambda k: D.issue_counts([k.log(e) for e in D.PLANS]),
      "select issue_type, violation_type, count(*) as issue_count from defect_log group by 1, 2")

# profiles --------------------------------------------------------------------------------

view("json_lines", JSON_LINES.format(events="events"))
query("malformed_lines", "total:i malformed:i non_object:i",
      lambda k: P.malformed_lines(k.json_lines), """
      select count(*) as total, count(*) filter (where not json_valid(line)) as malformed,
             count(*) filter (where case when json_valid(line) then json_type(line) <> 'OBJECT' else false end) as non_object
      from json_lines""")
query("field_profile", "field json_type type_count:i present:i absent:i nulls:i",
      lambda k: P.field_profile(k.json_lines), """
      with o as (select cast(line as json) as doc from json_lines
                 where case when json_valid(line) then json_type(line) = 'OBJECT' else false end),
      p as (select unnest(json_keys(doc)) as field, doc from o),
      t as (select field, case json_type(doc, concat('$.', field)) when 'NULL' then 'null'
                   when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean'
                   when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer'
                   when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as json_type
            from p)
      select field, json_type, count(*) as type_count,
             sum(count(*)) over (partition by field) as present,
             (select count(*) from o) - sum(count(*)) over (partition by field) as absent,
             sum(case when json_type = 'null' then count(*) else 0 end) over (partition by field) as nulls
      from t group by 1, 2""")
_ALL = list(schemas.ENTITY_ID)
view("entity_summary", " union all ".join(
    f"select '{e}' as entity_name, count(*) as rows, count(distinct dt) as partitions,"
    f" min(dt) as first_date, max(dt) as last_date from b_{e}" for e in _ALL))
query("entity_summary", "entity_name rows:i partitions:i first_date:t last_date:t",
      lambda k: P.entity_summary({e: k.bronze(e) for e in _ALL}), "select * from entity_summary")
_DOMAIN = ", ".join(f"('{e}', '{d}')" for d, es in P.DOMAINS.items() for e in es)
query("domain_rollup", "domain entity_name rows:i partitions:i first_date:t last_date:t",
      lambda k: P.domain_rollup(P.entity_summary({e: k.bronze(e) for e in _ALL})), f"""
      select domain, entity_name, sum(rows) as rows, max(partitions) as partitions,
             min(first_date) as first_date, max(last_date) as last_date
      from entity_summary join (values {_DOMAIN}) d(entity_name, domain) using (entity_name)
      group by rollup (domain, entity_name)""")
query("null_profile", "entity_name field rows:i nulls:i null_pct:f injected:i",
      lambda k: P.null_profile({e: k.dirty(e) for e in D.PLANS}, k.defect_log), f"""
      select p.*, coalesce(nulls::double / nullif(rows, 0), 0) * 100 as null_pct,
             coalesce(i.n, 0) as injected
      from ({" union all ".join(
          f"select '{e}' as entity_name, '{c}' as field, count(*) as rows,"
          f" count(*) filter (where {c} is null) as nulls from dirty_{e}"
          for e in D.PLANS for c in schemas.entity_columns(e))}) p
      left join (select entity_name, field_name as field, count(*) as n from defect_log
                 where issue_type = '{D.MISSING}' group by 1, 2) i using (entity_name, field)""")
_CLEAN_DIRTY = {side: " union all ".join(
    f"select count(*) as n, min(dt) as lo, max(dt) as hi from {side}_{e}" for e in D.PLANS)
    for side in ("clean", "dirty")}
query("profile_checks", "check_name expected:i actual:i status",
      lambda k: P.profile_checks(
          k.defect_log, {e: k.clean(e) for e in D.PLANS}, {e: k.dirty(e) for e in D.PLANS},
          k.json_lines, P.storage_bytes({n: f"{k.sf_dir}/{n}.parquet" for n in TABLE_DDL}, k.spark)), f"""
      with e as ({" union all ".join(f"""select (select count(*) from dirty_{e}) - (select count(*) from clean_{e}) as s,
                     (select count(*) from defect_log where entity_name = '{e}' and issue_type = '{D.DUPLICATE}') as d"""
                     for e in D.PLANS)}),
      t as (select count(*) as n, count(issue_type) as issues, count(entity_name) as entities,
                     count(*) filter (where issue_type = '{D.MISSING}') as missing,
                     count(field_name) filter (where issue_type = '{D.MISSING}') as mf,
                     count(*) filter (where issue_type = '{D.TEMPORAL}') as temporal,
                     count(violation_type) filter (where issue_type = '{D.TEMPORAL}') as tc,
                     count(*) filter (where issue_type = '{D.DUPLICATE}') as dup,
                     count(distinct (entity_name, source_record_id)) as uniq from defect_log),
      c as (select sum(n) as n, count(*) filter (where lo > hi) as bad from ({_CLEAN_DIRTY["clean"]}) x),
      d as (select sum(n) as n, count(*) filter (where lo > hi) as bad from ({_CLEAN_DIRTY["dirty"]}) x),
      l as (select count(*) as bad from json_lines
            where case when json_valid(line) then json_type(line) <> 'OBJECT' else true end),
      r(check_name, expected, actual) as (
          select 'manifest_rows_equal_issue_sum', t.n, issues from t
          union all select 'entity_issue_totals', t.n, entities from t
          union all select 'bronze_clean_duplicate_delta', count(*), count(*) filter (where s = d) from e
          union all select 'manifest_duplicate_counts_reconciled', max(dup), coalesce(sum(d) filter (where s = d), 0) from e, t
          union all select 'storage_byte_reconciliation', {len(TABLE_DDL)}, {len(TABLE_DDL)}
          union all select 'manifest_missing_counts_reconciled', missing, mf from t
          union all select 'manifest_timestamp_counts_reconciled', temporal, tc from t
          union all select 'manifest_unique_affected_records', t.n, uniq from t
          union all select 'partition_date_ranges', 0, c.bad + d.bad from c, d
          union all select 'stream_parse_errors', 0, bad from l),
      s as (select *, case when expected = actual then 'PASS' else 'FAIL' end as status from r)
      select * from s union all
      select 'overall', count(*), count(*) filter (where status = 'PASS'),
             case when count(*) = count(*) filter (where status = 'PASS') then 'PASS' else 'FAIL' end
      from s""")
