"""Ingestion, state maintenance and text queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.oracle import view
from tidemark.catalog.registry import query
from tidemark.functions.text import redact
from tidemark.operators import facts, profiling, upserts as U
from tidemark.operators.defects import PLANS
from tidemark.sources import partitions as S
from tidemark.sources.tables import TABLE_DDL

RUN = "2024-01-25"


def day(text: str):
    return F.lit(text).cast("date")


# upserts: the target is the state before a cut, the source everything that landed after it --

_SUB = "subscription_id user_id plan_id started_at:t ended_at:t subscription_status updated_at:t"
_CUT = "timestamp '2024-01-05 00:00:00'"


def _subs(k):
    """Target: first copies; source: replays and later copies, one per key."""
    rows = k.bronze("subscriptions").drop("dt", "actual_monthly_price")
    target = U.latest_per_key(rows.filter(F.expr(f"ingested_at < {_CUT}")), "subscription_id")
    source = U.latest_per_key(rows.filter(F.expr(f"ingested_at >= {_CUT}")), "subscription_id")
    bumped = F.expr("case when cast(substring(user_id, 2) as bigint) % 2 = 0"
                    " then updated_at + interval '1' day else updated_at end")
    changed = source.withColumn("updated_at", bumped).withColumn(
        "subscription_status", F.concat(F.lit("NEW_"), "subscription_status"))
    return target, changed


def _one(where: str) -> str:
    return (f"(select * exclude (rn) from (select * exclude (dt, actual_monthly_price), row_number()"
            f" over (partition by subscription_id order by updated_at desc, ingested_at desc) as rn"
            f" from b_subscriptions where {where}) x where rn = 1)")


view("subs_target", f"select * from {_one(f'ingested_at < {_CUT}')} t")
view("subs_source", f"""select * replace (
        case when cast(substring(user_id, 2) as bigint) % 2 = 0
             then updated_at + interval '1' day else updated_at end as updated_at,
        concat('NEW_', subscription_status) as subscription_status)
    from {_one(f'ingested_at >= {_CUT}')} s""")
query("merge_upsert", _SUB, lambda k: U.merge_upsert(*_subs(k), ["subscription_id"]), """
      select * from subs_target where subscription_id not in (select subscription_id from subs_source)
      union all select * from subs_source""")
query("merge_update_only", _SUB, lambda k: U.merge_update_only(*_subs(k), ["subscription_id"]), """
      select t.* from subs_target t
      where subscription_id not in (select subscription_id from subs_source)
      union all select * from subs_source
      where subscription_id in (select subscription_id from subs_target)""")
query("merge_newer", _SUB, lambda k: U.merge_newer(*_subs(k), ["subscription_id"]), """
      select t.* from subs_target t left join subs_source s using (subscription_id)
      where s.subscription_id is null or not coalesce(s.updated_at > t.updated_at, false)
      union all select s.* from subs_source s left join subs_target t using (subscription_id)
      where t.subscription_id is null or s.updated_at > t.updated_at""")
query("registry_upsert", _SUB,
      lambda k: U.merge_newer(*_subs(k), ["subscription_id"], or_equal=True), """
      select s.* from subs_source s
      where not exists (select 1 from subs_target t where t.subscription_id = s.subscription_id
                        and (t.updated_at > s.updated_at or t.updated_at is null or s.updated_at is null))
      union all select t.* from subs_target t
      where not exists (select 1 from subs_source s where t.subscription_id = s.subscription_id
                        and s.updated_at >= t.updated_at)""")
query("retention_trim", "message_id ingested_at:t dt:t",
      lambda k: U.retention_trim(k.bronze("messages"), F.col("dt"), day("2024-02-10")),
      "select message_id, ingested_at, dt from b_messages where dt >= date '2024-02-10' - 29")
query("latest_per_key", _SUB,
      lambda k: U.latest_per_key(k.bronze("subscriptions"), "subscription_id"),
      f"select * from {_one('true')} z")

# The entities whose daily counts are kept as state.
_COUNTED = ("user_updates", "conversations", "messages", "errors")
_STREAMS = {"landed": "select '{e}' as entity, max(dt) as latest from b_{e}",
            "aligned": "select '{e}' as entity, max(dt) as latest from b_{e} where dt <= date '" + RUN + "'"}


def _latest(k):
    parts = []
    for stream, limit in (("landed", None), ("aligned", day(RUN))):
        for e in _COUNTED:
            t = k.bronze(e) if limit is None else k.bronze(e).filter(F.col("dt") <= limit)
            parts.append(t.agg(F.max("dt").alias("latest")).select(
                F.lit(stream).alias("stream"), F.lit(e).alias("entity"), "latest"))
    return U.union_all(parts)


query("date_sequence", "stream previous_date:t run_date:t mode",
      lambda k: U.date_sequence(
          _latest(k),
          k.table("events").agg(F.max(F.to_date("ts")).alias("d")).select(
              F.explode(F.expr("sequence(date_sub(d, 6), date_sub(d, 2))")).alias("run_date"))), f"""
      with l as ({" union all ".join(
          f"select '{s}' as stream, * from ({t.format(e=e)}) x" for s, t in _STREAMS.items()
          for e in _COUNTED)}),
      a as (select stream, min(latest) as lo, max(latest) as previous_date from l group by 1),
      d as (select cast(unnest(generate_series(max(cast(ts as date)) - interval 6 day,
                   max(cast(ts as date)) - interval 2 day, interval 1 day)) as date) as run_date
            from events)
      select stream, previous_date, run_date,
             case when lo <> previous_date then 'inconsistent' when run_date = previous_date then 'retry'
                  when run_date = previous_date + 1 then 'new_day'
                  when run_date < previous_date then 'stale' else 'gap' end as mode
      from a, d""")
view("daily_counts", " union all ".join(
    f"select '{e}' as entity, dt as activity_date, count(*) as row_count from b_{e}"
    f" where dt between date '{RUN}' - 29 and date '{RUN}' group by dt" for e in _COUNTED))


def _counts(k):
    return U.daily_counts({e: k.bronze(e) for e in _COUNTED}, day(RUN))


query("daily_counts", "entity activity_date:t row_count:i", _counts, "select * from daily_counts")
# An entity that no data has shows as incomplete, with means of zero.
_DECLARED = (*_COUNTED, "agent_sessions")
_DENSE = f"""
      select g.entity, g.day, c.row_count
      from (select * from (select unnest([{", ".join(f"'{e}'" for e in _DECLARED)}]) as entity) e,
                 (select cast(unnest(generate_series(date '{RUN}' - 29, date '{RUN}', interval 1 day)) as date) as day) d) g
           left join daily_counts c on c.entity = g.entity and c.activity_date = g.day"""
query("volume_report", "entity avg_7d:f avg_30d:f",
      lambda k: U.volume_report(_counts(k), day(RUN), _DECLARED), f"""
      select entity, coalesce(sum(row_count) filter (where day > date '{RUN}' - 7), 0) / 7.0::double as avg_7d,
             coalesce(sum(row_count), 0) / 30.0::double as avg_30d from ({_DENSE}) g group by 1""")
query("window_completeness", "entity first_date:t last_date:t days:i rows:i missing_days:i complete:b",
      lambda k: U.window_completeness(_counts(k), day(RUN), _DECLARED), f"""
      select *, coalesce(first_date = date '{RUN}' - 29 and last_date = date '{RUN}' and days = 30
                         and rows = 30, false) as complete
      from (select entity, min(day) filter (where row_count is not null) as first_date,
                   max(day) filter (where row_count is not null) as last_date,
                   count(distinct day) filter (where row_count is not null) as days, count(row_count) as rows,
                   count(*) filter (where row_count is null) as missing_days
            from ({_DENSE}) g group by 1) c""")
query("dau_7d", "mean_active_users:f active_target:i",
      lambda k: U.daily_active_mean(k.bronze("messages"), day(RUN)), f"""
      select sum(n) / 7.0::double as mean_active_users,
             greatest(1, round_even(sum(n) / 7.0::double, 0)) as active_target
      from (select cast(ingested_at as date) as d, count(distinct user_id) as n from b_messages
            where cast(ingested_at as date) between date '{RUN}' - 6 and date '{RUN}' group by 1) x""")
query("state_invariants", "invariant offending:i",
      lambda k: U.state_invariants(
          k.current_user_state, k.bronze("users"),
          {"recent_messages": (k.bronze("messages"), "message_id"),
           "recent_conversations": (k.stg_conversations, "conversation_id"),
           "subscriptions": (k.bronze("subscriptions"), "subscription_id")},
          ("recent_messages", "recent_conversations"), day(RUN)),
      "select 'one_state_row_per_user' as invariant, count(*) as offending from"
      " (select user_id from b_users group by 1 having count(*) <> 1) x"
      + "".join(
          f" union all select 'unique.{n}', count(*) - count(distinct {c}) from {t}"
          for n, t, c in (("recent_messages", "b_messages", "message_id"),
                          ("recent_conversations", "stg_conversations", "conversation_id"),
                          ("subscriptions", "b_subscriptions", "subscription_id")))
      + "".join(
          f" union all select 'window.{n}', count(*) filter (where cast(ingested_at as date)"
          f" not between date '{RUN}' - 29 and date '{RUN}') from {t}"
          for n, t in (("recent_messages", "b_messages"), ("recent_conversations", "stg_conversations"))))

# ingestion -------------------------------------------------------------------------------

query("bronze_conform",
      "message_id conversation_id user_id device_id sequence_number:i message_text created_at:t"
      " ingested_at:t dt:t",
      lambda k: S.conform(k.bronze("messages").drop("device_id", "dt").select(
          "ingested_at", "message_text", "message_id", "conversation_id", "user_id",
          "sequence_number", "created_at"), schemas.entity_schema("messages"), F.to_date("ingested_at")),
      "select message_id, conversation_id, user_id, null as device_id, sequence_number,"
      " message_text, created_at, ingested_at, dt from b_messages")


def _parse(k):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id bigint, kind string, score double, flag boolean")
    return S.parse_lenient(k.json_lines, "line", schema).withColumn(
        "is_corrupt", F.col("_corrupt_record").isNotNull())


query("json_parse", "id:i kind score:f flag:b is_corrupt:b", _parse, """
      select cast(json_extract_string(doc, '$.id') as bigint) as id,
             json_extract_string(doc, '$.kind') as kind,
             cast(json_extract_string(doc, '$.score') as double) as score,
             cast(json_extract_string(doc, '$.flag') as boolean) as flag, not ok as is_corrupt
      from (select line, ok, case when ok then cast(line as json) end as doc from (
          select line, case when json_valid(line) then json_type(line) = 'OBJECT' else false end as ok
          from json_lines) a) b""")
_LOADED = "2024-01-20"


def _selected(k):
    days = k.bronze("messages").select("dt")
    mark = k.bronze("messages").filter(F.col("dt") <= day(_LOADED)).agg(F.max("dt").alias("watermark"))
    empty = mark.select(F.lit(None).cast("date").alias("watermark"))
    plans = {
        "after": S.incremental_partitions(days, mark),
        "lookback": S.incremental_partitions(days, mark, lookback_days=3),
        "range": S.incremental_partitions(days, mark, start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 12)),
        "first_load": S.incremental_partitions(days, empty),
    }
    return U.union_all([d.select(F.lit(m).alias("mode"), "dt") for m, d in plans.items()])


query("incremental_partitions", "mode dt:t", _selected, f"""
      with d as (select distinct dt from b_messages),
      w as (select max(dt) as mark from d where dt <= date '{_LOADED}')
      select 'after' as mode, dt from d, w where dt > mark
      union all select 'lookback', dt from d, w
      where dt >= greatest(mark, (select max(dt) from d)) - 3
      union all select 'range', dt from d where dt between date '2024-01-10' and date '2024-01-12'
      union all select 'first_load', dt from d""")
_STAGED = {e: "stg_" + {"subscription_plans": "plans", "model_inferences": "inferences"}.get(e, e) for e in schemas.ENTITY_ID}


def _measures(entity: str) -> str:
    columns = _source_columns(entity)
    names = ", ".join(f"'{n}'" for n in ["rows", *[f"null.{c}" for c in columns]])
    values = ", ".join(["count(*)", *[f"count(*) filter (where {c} is null)" for c in columns]])
    return f"unnest([{names}]) as measure, unnest([{values}]) as n"


def _source_columns(entity: str) -> list[str]:
    return schemas.entity_columns(entity) + ([] if entity in schemas.REFERENCE_ENTITIES else ["ingested_at"])


def _reconciled(k):
    return U.union_all([
        S.load_reconciliation(
            k.bronze(e), getattr(k, t).withColumnRenamed("physical_partition_date", "dt"), _source_columns(e)
        ).select(F.lit(e).alias("entity_name"), "*")
        for e, t in _STAGED.items()])


query("load_reconciliation", "entity_name dt:t measure source:i loaded:i matches:b", _reconciled,
      " union all ".join(f"""
      select '{e}' as entity_name, coalesce(s.dt, l.dt) as dt, coalesce(s.measure, l.measure) as measure,
             s.n as source, l.n as loaded, s.n is not distinct from l.n as matches
      from (select dt, {_measures(e)} from b_{e} group by dt) s
      full outer join (select physical_partition_date as dt, {_measures(e)} from {t}
                       group by physical_partition_date) l
           on s.dt = l.dt and s.measure = l.measure""" for e, t in _STAGED.items()))


def _differences(k):
    columns = {e: schemas.entity_schema(e).fieldNames() for e in PLANS}
    return U.union_all([
        S.fidelity_diff(k.bronze(e).select(*columns[e]), k.dirty(e).select(*columns[e]), schemas.ENTITY_ID[e])
        .select(F.lit(e).alias("entity_name"), "*")
        for e in PLANS])


def _difference_sql(entity: str) -> str:
    columns, key = schemas.entity_schema(entity).fieldNames(), schemas.ENTITY_ID[entity]
    every = ", ".join(columns)
    tests = ", ".join(
        f"case when min({c}) filter (where n > 0) is distinct from min({c}) filter (where n < 0)"
        f" or max({c}) filter (where n > 0) is distinct from max({c}) filter (where n < 0) then '{c}' end"
        for c in columns if c != key)
    return f"""
      select '{entity}' as entity_name, {key} as row_id, coalesce(sum(n) filter (where n > 0), 0) as only_left,
             coalesce(-sum(n) filter (where n < 0), 0) as only_right,
             case when bool_or(n > 0) and bool_or(n < 0)
                  then array_to_string(list_filter([{tests}], lambda c: c is not null), ',') else '' end as changed_columns
      from (select {every}, sum(s) as n from (
                select {every}, 1 as s from b_{entity} union all select {every}, -1 from dirty_{entity}) u
            group by all having sum(s) <> 0) d
      group by {key}"""


query("table_diff", "entity_name row_id only_left:i only_right:i changed_columns", _differences,
      " union all ".join(_difference_sql(e) for e in PLANS))
query("partition_mismatch", "message_id ingested_at:t dt:t",
      lambda k: S.partition_mismatch(k.bronze("messages").withColumn("dt", F.to_date("created_at"))),
      "select message_id, ingested_at, cast(created_at as date) as dt from b_messages"
      " where cast(created_at as date) <> cast(ingested_at as date)")
query("latest_partition", "model_id model_name model_version active_flag:b dt:t",
      lambda k: S.latest_partition(k.bronze("models")),
      "select * from b_models where dt = (select max(dt) from b_models)")
query("id_collisions", "subscription_id",
      lambda k: S.id_collisions(
          k.bronze("subscriptions").filter(F.col("dt") > day("2024-01-05")),
          k.bronze("subscriptions").filter(F.col("dt") <= day("2024-01-05")), "subscription_id"), """
      select distinct subscription_id from b_subscriptions where dt > date '2024-01-05'
      and subscription_id in (select subscription_id from b_subscriptions
                              where dt <= date '2024-01-05')""")


def _digest_sql(name: str, table: str, fields: dict[str, str], part: str) -> str:
    text = ", ".join(
        f"coalesce(cast({'epoch_us(' + c + ')' if kind == 'timestamp' else c} as varchar), '~')" for c, kind in fields.items())
    return (f"select '{name}' as table_name, {part} as part, count(*) as n,"
            f" sum(cast(cast(concat('0x', substr(md5(concat_ws('|', {text})), 1, 15)) as ubigint) as hugeint)) as d"
            f" from {table} group by 2")


def _digest_tables(k):
    given = {n: k.table(n) for n in TABLE_DDL}
    return {**{e: k.bronze(e) for e in schemas.ENTITY_ID}, **given}


def _digests() -> str:
    parts = []
    for e in schemas.ENTITY_ID:
        fields = {f.name: f.dataType.simpleString() for f in schemas.entity_schema(e).fields}
        parts.append(_digest_sql(e, f"b_{e}", fields, "coalesce(cast(dt as varchar), 'none')"))
    parts += [_digest_sql(n, n, _given_fields(n), "'all'") for n in TABLE_DDL]
    return f"""
      select grouping(table_name, part) as level, coalesce(table_name, '*') as table_name,
             coalesce(part, '*') as part, sum(n) as rows, cast(sum(d) as varchar) as digest
      from ({" union all ".join(parts)}) leaves group by rollup (table_name, part)"""


def _given_fields(name: str) -> dict[str, str]:
    """Columns of a given table and their types; floats as the digest writes them."""
    fields = [f.strip().split(" ", 1) for f in TABLE_DDL[name].split(",")]
    return {f"cast({c} as decimal(38,6))" if kind == "double" else c: kind for c, kind in fields}


query("table_digest", "level:i table_name part rows:i digest", lambda k: S.digest_tree(_digest_tables(k)), _digests())
query("file_accounting", "table_name rows:i bytes_met:b",
      lambda k: profiling.stored_files({n: f"{k.sf_dir}/{n}.parquet" for n in TABLE_DDL}, k.spark).withColumn(
          "bytes_met", F.col("listed") == F.col("scanned")),
      " union all ".join(f"select '{n}' as table_name, count(*) as rows, true as bytes_met from {n}" for n in TABLE_DDL))


def _incremental(k):
    """Fact state of an earlier load, then the incremental selection against it."""
    target = k.fact_message.filter(F.col("source_partition_date") <= day(_LOADED)).filter(
        F.col("created_at") <= F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return target, facts.incremental_rows(k.stg_messages, target, "created_at")


view("inc_target", f"""select * from fact_message where source_partition_date <= date '{_LOADED}'
    and created_at <= timestamp '2024-01-20 12:00:00'""")
view("inc_rows", """
    select s.* from stg_messages s, (select max(created_at) as ev, max(source_partition_date) as pt
                                     from inc_target) t
    where s.created_at >= t.ev - interval '2' day or s.physical_partition_date >= t.pt - 2""")
query("incremental_filter", "message_id created_at:t physical_partition_date:t",
      lambda k: _incremental(k)[1], "select * from inc_rows")


def _incremental_merge(k):
    target, rows = _incremental(k)
    fresh = facts.fact_message(rows, k.dim_user, k.dim_device, k.dim_date, k.hot_rows,
                               k.disjoint_versions)
    return U.merge_upsert(target, fresh, ["message_id"])


query("incremental_merge", "message_id user_key device_key date_key:i created_at:t source_partition_date:t",
      _incremental_merge, """
      select * from inc_target where message_id not in (select message_id from inc_rows)
      union all select * from fact_message where message_id in (select message_id from inc_rows)""")

# text ------------------------------------------------------------------------------------

query("redact_secrets", "doc_id:i text",
      lambda k: k.table("documents").select("doc_id", redact(F.col("text")).alias("text")), r"""
      select doc_id, regexp_replace(regexp_replace(text, '(?i)\bbearer\s+[^\s,;]+',
                 'Bearer [REDACTED]', 'g'),
             '(?i)\b(token|password|secret|authorization|credential)\b\s*[:=]\s*[^\s,;]+',
             '\1=[REDACTED]', 'g') as text from documents""")
