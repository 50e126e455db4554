"""Incident queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.oracle import view
from tidemark.catalog.registry import query
from tidemark.operators import incidents as N
from tidemark.operators import monitoring
from tidemark.plans.lake import at
from tidemark.sources.damage import BASELINE, CHECKPOINTS, OUTBOX, REPEATED, SNAPSHOTS

_STATUS = """case upper(coalesce({c}, '')) when 'PASS' then 'PASS' when 'SUCCESS' then 'PASS'
    when 'WARN' then 'WARN' when 'WARNING' then 'WARN' when 'FAIL' then 'FAIL' when 'FAILED' then 'FAIL'
    when 'ERROR' then 'FAIL' when 'INTERNAL_ERROR' then 'FAIL' when 'TIMED_OUT' then 'FAIL'
    when 'CANCELED' then 'FAIL' when 'CANCELLED' then 'FAIL' when 'UNAVAILABLE' then 'UNAVAILABLE'
    else 'UNKNOWN' end"""


def _fp(text: str) -> str:
    return f"""sha256(concat('"', {text}, '"'))"""


def _obs(fp: str, token: str) -> str:
    """``token`` is a JSON value."""
    return f"""sha256(concat('{{"fingerprint":"', {fp}, '","observation_token":', {token}, '}}'))"""


_DAY = "coalesce(cast(reference_date as varchar), 'none')"


view("observations", f"""
    select *, {_obs("fingerprint", "to_json(cast(raw_id as varchar))")} as observation_id
    from (select source, category, check_name, observation_id as raw_id,
                 {_fp("concat(source, ':', category, ':', lower(trim(check_name)))")} as fingerprint,
                 {_STATUS.format(c="raw_status")} as status, observed_at
          from raw_check_events) x""")
query("status_normalise", "observation_id raw_status status",
      lambda k: k.raw("check_events").withColumn(
          "status", monitoring.normalise_status(F.col("raw_status"))),
      f"select observation_id, raw_status, {_STATUS.format(c='raw_status')} as status"
      " from raw_check_events")
query("fingerprint", "check_name category fingerprint n:i",
      lambda k: k.observations.groupBy("check_name", "category", "fingerprint").agg(
          F.count(F.lit(1)).alias("n")),
      "select check_name, category, fingerprint, count(*) as n from observations group by 1, 2, 3")
query("observation_id", "observation_id fingerprint observed_at:t status",
      lambda k: k.observations, "select * from observations")
query("observations", "source category identity fingerprint status observed_at:t observation_id",
      lambda k: N.check_observations(k.checks, F.coalesce(
          F.col("reference_date").cast("timestamp"), at("2024-02-01 00:00:00"))), f"""
      select 'observability' as source, category, check_name as identity, fp as fingerprint, status,
             coalesce(cast(reference_date as timestamp), timestamp '2024-02-01 00:00:00') as observed_at,
             {_obs("fp", f"""cast(case category when 'volume' then json_object('activity_date', {_DAY}, 'execution_run_id', null)
                 when 'quality' then json_object('execution_run_id', null, 'metric_date', {_DAY})
                 else to_json({_DAY}) end as varchar)""")} as observation_id
      from (select *, {_fp("concat('observability:', category, ':', lower(trim(check_name)))")} as fp
            from checks) c""")
query("run_observations", "run_id:i identity fingerprint status observed_at:t observation_id",
      lambda k: N.run_observations(k.raw("job_runs"), k.raw("job_tasks")), f"""
      select run_id, identity, fp as fingerprint, status, observed_at,
             {_obs("fp", "token")} as observation_id
      from (
          select t.run_id, concat(r.job_id, ':task:', t.task_key) as identity,
                 {_fp("concat('jobs:execution:', r.job_id, ':task:', lower(t.task_key))")} as fp,
                 {_STATUS.format(c="t.result_state")} as status,
                 coalesce(t.end_time, r.end_time) as observed_at,
                 cast(json_object('run_id', t.run_id, 'task_key', t.task_key) as varchar) as token
          from raw_job_tasks t join raw_job_runs r using (run_id)
          union all
          select r.run_id, concat(r.job_id, ':pipeline'),
                 {_fp("concat('jobs:execution:', r.job_id, ':pipeline')")},
                 {_STATUS.format(c="r.result_state")}, coalesce(r.end_time, r.start_time),
                 cast(json_object('run_id', r.run_id, 'scope', 'pipeline') as varchar)
          from raw_job_runs r left join (
              select run_id, bool_or({_STATUS.format(c="result_state")} = 'FAIL') as bad
              from raw_job_tasks group by 1) v using (run_id)
          where v.bad is null or ({_STATUS.format(c="r.result_state")} = 'FAIL' and not v.bad)) x""")
view("run_snapshots", SNAPSHOTS.format(job_runs="raw_job_runs"))
query("evidence_association", "run_id:i status reason",
      lambda k: N.evidence_association(k.raw("job_runs"), k.run_snapshots), """
      select r.run_id, 'UNCERTAIN' as status,
             case when s.first_at is null
                      then 'observability_snapshot_has_no_monitoring_execution_timestamp'
                  when r.start_time is null or r.end_time is null
                      then 'pipeline_execution_window_is_incomplete'
                  when s.first_at >= r.start_time and s.last_at <= r.end_time
                      then 'timestamp_window_match_does_not_prove_execution_identity'
                  else 'monitoring_execution_timestamp_is_outside_pipeline_run_window' end as reason
      from raw_job_runs r left join run_snapshots s using (run_id)""")
view("outages", """
    select source, last_at as at from (
        select source, max(observed_at) as last_at,
               arg_max(status, row(observed_at, observation_id)) as last_status
        from observations group by source, cast(observed_at as date)) d
    where last_status = 'UNAVAILABLE'""")
query("source_outages", "source down_at:t", lambda k: k.outages.withColumnRenamed("at", "down_at"),
      "select source, outages.at as down_at from outages")
view("decisions", """
    with a as (select *, status in ('WARN', 'FAIL') as act,
                      count(*) filter (where status in ('WARN', 'FAIL')) over w as n_active,
                      (select count(*) from outages o where o.source = observations.source
                       and o.at <= observations.observed_at) as seg
               from observations window w as (partition by fingerprint
                   order by observed_at, observation_id rows unbounded preceding)),
    p as (select *, count(*) filter (where status = 'PASS') over (
                      partition by fingerprint, n_active, seg
                      order by observed_at, observation_id rows unbounded preceding) as np from a),
    m as (select *, coalesce(max(case when status = 'PASS' then np end) over (
                      partition by fingerprint, n_active order by observed_at, observation_id
                      rows between unbounded preceding and 1 preceding), 0) >= 2 as done_before,
                 max(case when status = 'PASS' then np end) over (
                      partition by fingerprint, n_active order by observed_at, observation_id
                      rows unbounded preceding) as mx from p),
    l as (select *, lag(coalesce(mx, 0) >= 2) over (partition by fingerprint
                      order by observed_at, observation_id) as prev_done from m)
    select *, case when status in ('UNKNOWN', 'UNAVAILABLE') then 'INSUFFICIENT_EVIDENCE'
                   when act and n_active = 1 then 'NEW'
                   when act and coalesce(prev_done, false) then 'RECURRING'
                   when act then 'ONGOING'
                   when n_active = 0 or done_before then 'HEALTHY_NO_INCIDENT'
                   when np >= 2 then 'RESOLVED' else 'PENDING_RESOLUTION' end as decision
    from l""")
_DECISION = "observation_id fingerprint observed_at:t status decision"
query("incident_decisions", _DECISION, lambda k: k.decisions, "select * from decisions")
query("incident_unavailable", "fingerprint decision n:i",
      lambda k: k.decisions.groupBy("fingerprint", "decision").agg(F.count(F.lit(1)).alias("n")),
      "select fingerprint, decision, count(*) as n from decisions group by 1, 2")
view("repeated_observations", REPEATED.format(observations="observations"))
query("incident_duplicates", "observation_id arrival:i decision",
      lambda k: k.repeated_decisions, """
      select observation_id, arrival, case when row_number() over (partition by observation_id
                 order by arrival, observed_at) = 1 then decision else 'DUPLICATE' end as decision
      from repeated_observations join (select observation_id, decision from decisions) d
           using (observation_id)""")
view("baseline_observations", BASELINE.format(repeated="repeated_observations"))
# The lifecycle as a literal fold: one row of each fingerprint after the other.
view("folded_decisions", """
    with recursive sightings as (
        select *, row_number() over (partition by observation_id order by arrival, observed_at) as sighting
        from baseline_observations),
    firsts as (
        select *, row_number() over (partition by fingerprint order by observed_at, observation_id) as turn,
               (select max(o.at) from outages o where o.source = s.source and o.at <= s.observed_at) as outage,
               status in ('WARN', 'FAIL') as active,
               baseline and not (source = 'jobs' and category = 'execution' and status = 'FAIL') as quiet
        from sightings s where sighting = 1),
    fold as (
        select distinct fingerprint, 0::bigint as turn, '' as observation_id, timestamp '1970-01-01' as observed_at,
               '' as status, false as is_open, 0 as episode, 0 as passes, null::timestamp as outage,
               '' as decision, false as opens
        from firsts
        union all
        select fingerprint, turn, observation_id, observed_at, status,
               case when opens then true when decision = 'RESOLVED' then false else was_open end,
               episode + opens::int,
               case when opens or (active and not quiet) then 0
                    when decision in ('PENDING_RESOLUTION', 'RESOLVED') then so_far + 1 else so_far end,
               outage, decision, opens
        from (select *, active and (case when quiet then episode = 0 else not was_open end) as opens,
                     case when quiet then 'BASELINED'
                          when active and was_open then 'ONGOING'
                          when active and episode = 0 then 'NEW'
                          when active then 'RECURRING'
                          when status <> 'PASS' then 'INSUFFICIENT_EVIDENCE'
                          when not was_open then 'HEALTHY_NO_INCIDENT'
                          when so_far = 1 then 'RESOLVED' else 'PENDING_RESOLUTION' end as decision
              from (select n.*, f.is_open as was_open, f.episode,
                           case when n.outage is distinct from f.outage then 0 else f.passes end as so_far
                    from fold f join firsts n on n.fingerprint = f.fingerprint and n.turn = f.turn + 1) a) b)
    select fingerprint, observation_id, observed_at, status, decision, opens from fold where turn > 0
    union all
    select fingerprint, observation_id, observed_at, status, 'DUPLICATE', false
    from sightings where sighting > 1""")
query("incident_baseline", _DECISION + " opens:b", lambda k: k.baseline_decisions, "select * from folded_decisions")
view("numbered_decisions", """
    select *, count(*) filter (where decision in ('NEW', 'RECURRING')) over (partition by fingerprint
               order by observed_at, observation_id rows unbounded preceding) as episode_number
    from decisions""")
_EID = "sha256(concat(fingerprint, ':', episode_number))"
query("incident_episodes",
      "episode_id fingerprint episode_number:i episode_started_at:t last_seen_at:t resolved_at:t"
      " last_status observation_count:i lifecycle_status",
      lambda k: N.episodes(k.decisions, k.hot_rows), f"""
      select *, {_EID} as episode_id,
             case when resolved_at is not null then 'RESOLVED' else 'OPEN' end as lifecycle_status
      from (select fingerprint, episode_number, min(observed_at) as episode_started_at,
                   max(observed_at) as last_seen_at,
                   max(observed_at) filter (where decision = 'RESOLVED') as resolved_at,
                   arg_max(status, (observed_at, observation_id)) as last_status,
                   count(*) as observation_count
            from numbered_decisions
            where episode_number > 0 and decision in
                  ('NEW', 'RECURRING', 'ONGOING', 'PENDING_RESOLUTION', 'RESOLVED')
            group by 1, 2) e""")
view("notifications", f"""
    select sha256(concat(episode_id, ':', decision)) as notification_id, episode_id,
           decision as event_type, fingerprint, observed_at as available_at
    from (select *, {_EID} as episode_id from numbered_decisions) n
    where decision in ('NEW', 'RECURRING', 'RESOLVED')""")
view("outbox", OUTBOX.format(notifications="notifications"))
view("outbox_checkpoints", CHECKPOINTS.format(notifications="outbox"))
query("incident_outbox", "notification_id episode_id event_type fingerprint available_at:t",
      lambda k: N.notifications(k.decisions, k.hot_rows), "select * from notifications")
query("outbox_eligible", "notification_id event_type status available_at:t checkpoint_name",
      lambda k: N.eligible_outbox(k.outbox, k.outbox_checkpoints, at("2024-01-28 00:00:00"), 50), """
      select * from outbox o where attempt_count < max_attempts and committed
        and available_at <= timestamp '2024-01-28 00:00:00'
        and (status in ('PENDING', 'RETRYABLE') or (status = 'CLAIMED'
             and lease_expires_at <= timestamp '2024-01-28 00:00:00'))
        and exists (select 1 from outbox_checkpoints c where c.checkpoint_name = o.checkpoint_name
                    and c.snapshot_version >= o.checkpoint_version)
      order by available_at, created_at, notification_id limit 50""")
query("outbox_insert", "notification_id event_type status attempt_count:i",
      lambda k: N.insert_once(
          k.outbox.filter("event_type <> 'RESOLVED'").select("notification_id", "event_type", "status", "attempt_count"),
          N.notifications(k.decisions, k.hot_rows)), """
      select notification_id, event_type, case when event_type = 'RESOLVED' then 'PENDING' else status end as status,
             case when event_type = 'RESOLVED' then 0 else attempt_count end as attempt_count from outbox""")
query("cursor_scan", "run_id:i end_time:t",
      lambda k: N.cursor_scan(k.raw("job_runs"), at("1997-06-01 00:00:00"), 500), """
      select * from raw_job_runs where end_time is not null
        and (end_time, run_id) > (timestamp '1997-06-01 00:00:00', 500)""")
view("issues", "select * from checks where status <> 'PASS'")


def _issues(k):
    return k.checks.filter(F.col("status") != "PASS")


query("issue_topk", "category check_name reference_date:t status selected:b reason",
      lambda k: N.issue_topk(_issues(k)), """
      with r as (select *, row_number() over (partition by category in ('quality', 'volume', 'freshness')
                    order by case status when 'FAIL' then 0 when 'WARN' then 1 else 99 end,
                             case category when 'quality' then 0 when 'volume' then 1
                                  when 'freshness' then 2 else 99 end,
                             check_name, reference_date nulls first) as rn,
                    category in ('quality', 'volume', 'freshness') as ok from issues)
      select category, check_name, reference_date, status, ok and rn <= 2 as selected,
             case when not ok then 'unsupported_category' when rn <= 2 then 'selected'
                  else 'investigation_limit_reached' end as reason from r""")
query("issue_actions",
      "category check_name reference_date:t status occurrence:i action priority requires_approval:b",
      lambda k: N.issue_actions(_issues(k), k.hot_rows), """
      select i.category, check_name, reference_date, status,
             row_number() over (partition by i.category, check_name, action
                                order by reference_date nulls first, status) as occurrence,
             action, case when action = 'diagnostic' and (i.category = 'execution' or status = 'FAIL')
                          then 'P0' else priority end as priority, requires_approval
      from issues i, (values ('diagnostic', 'P1', false), ('proposed_remediation', 'P2', true),
                             ('verification', 'P3', false)) a(action, priority, requires_approval)""")
