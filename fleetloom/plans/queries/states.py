"""State, time and ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import redirects as G
from fleetloom.operators import states as S
from fleetloom.operators import timeline as T
from fleetloom.operators.joins import workspace_pods_by_label
from fleetloom.plans.bindings import NOW_MS, Fleet
from fleetloom.plans.queries.graphs import _RESOLVED
from fleetloom.plans.registry import query
from fleetloom.sources.logs import parse_log_lines

_PORT_ERROR = """ports as (select i.*, k.id is not null as known, k.protocol, lag(i.port) over w as b1,
      lag(i.port, 2) over w as b2 from image_ports i left join kind_ports k on k.kind = i.kind and k.id = i.port_id
      window w as (partition by i.kind, i.option_id order by i.port_pos)),
    port_error as (select kind, option_id, arg_min(case when port in (b1, b2) then
        'duplicate port number ' || cast(port as varchar) || ' in imageConfig'
        when not known then 'port with id "' || port_id || '" not found in workspaceKind'
        else 'unsupported protocol "' || protocol || '" for port with id "' || port_id || '"' end, port_pos) as error
      from ports where port in (b1, b2) or not known or protocol <> 'HTTP' group by 1, 2)"""


@query(
    "owned_census",
    """with o as (select namespace, owner, type, name from helper_objects where type <> 'ConfigMap'
      union all select namespace, owner, 'StatefulSet', name from sets)
    select namespace, owner as name, type, count(*) as n, min(name) as first from o group by 1, 2, 3""",
)
def _owned_census(t: Fleet) -> DataFrame:
    census = S.owned_census(t.sets, t.helper_objects)
    kinds = [F.struct(F.lit(k).alias("type"), f"owned.{k}.count", f"owned.{k}.first") for k in (S.ACCOUNT, S.SET, S.SERVICE, S.ROUTE)]
    rows = census.select("namespace", "name", F.explode(F.array(*kinds)).alias("k")).filter("k.count > 0")
    return rows.select("namespace", "name", "k.type", F.col("k.count").alias("n"), "k.first")


@query(
    "derive_state",
    f"""{_RESOLVED}, {_PORT_ERROR},
    owned as (select namespace, owner, count(*) as n, min(name) as name from sets group by 1, 2),
    helped as (select namespace, owner, count(*) filter (type = 'ServiceAccount') as na,
      min(name) filter (type = 'ServiceAccount') as account, count(*) filter (type = 'Service') as ns,
      min(name) filter (type = 'Service') as service, count(*) filter (type = 'VirtualService') as nr,
      min(name) filter (type = 'VirtualService') as route from helper_objects group by 1, 2),
    x as (select w.namespace, w.name, w.kind, w.paused, k.name is not null as kind_known,
      case when i.id is null then 'imageConfig with id "' || w.image_id || '" not found' else i.error end as ie,
      case when p.id is null then 'podConfig with id "' || w.pod_id || '" not found' else p.error end as pe,
      o.n, o.name as set_name, na, account, ns, service, nr, route, q.error as port_error, s.uid as set_uid, s.generation,
      s.observed_generation, s.update_revision, d.name as pod, d.uid as pod_uid, d.owner_uid, d.deleting, d.revision,
      d.scheduled_status, d.scheduled_reason, d.scheduled_message, d.phase, d.ready_status, d.ready_message,
      d.waiting_reason, d.waiting_message
    from workspaces w left join kinds k on k.name = w.kind
    left join resolved i on i.option_type = 'image' and i.kind = w.kind and i.id = w.image_id
    left join resolved p on p.option_type = 'pod' and p.kind = w.kind and p.id = w.pod_id
    left join port_error q on q.kind = w.kind and q.option_id = w.image_id
    left join owned o on o.namespace = w.namespace and o.owner = w.name
    left join helped h on h.namespace = w.namespace and h.owner = w.name
    left join sets s on s.namespace = o.namespace and s.name = o.name
    left join pods d on d.namespace = w.namespace and d.name = o.name || '-0'),
    y as (select x.*, sw.message as sw, sw.uid is not null as has_sw, pw.message as pw, pw.uid is not null as has_pw
    from x left join last_warnings sw on sw.namespace = x.namespace and sw.uid = x.set_uid
    left join last_warnings pw on pw.namespace = x.namespace and pw.uid = x.pod_uid),
    z as (select namespace, name, case
      when not kind_known then 'Error|Workspace references unknown WorkspaceKind: ' || kind
      when ie is not null then 'Error|Workspace has invalid imageConfig: ' || ie
      when pe is not null then 'Error|Workspace has invalid podConfig: ' || pe
      when na > 1 then 'Error|Workspace owns multiple ServiceAccounts: ' || account || ' and ' || (na - 1) || ' more'
      when n > 1 then 'Error|Workspace owns multiple StatefulSets: ' || set_name || ' and ' || (n - 1) || ' more'
      when port_error is not null then 'Error|Failed to generate Service with error: ' || port_error
      when ns > 1 then 'Error|Workspace owns multiple Services: ' || service || ' and ' || (ns - 1) || ' more'
      when nr > 1 then 'Error|Workspace owns multiple VirtualServices: ' || route || ' and ' || (nr - 1) || ' more'
      when pod is not null and owner_uid <> set_uid then 'Error|Workspace Pod ' || pod ||
        ' is not owned by the Workspace StatefulSet ' || set_name
      when set_uid is null then 'Unknown|Workspace is in an unknown state'
      when generation <> observed_generation then
        'Pending|Workspace is pending: Waiting for Kubernetes to reconcile StatefulSet'
      when pod is null and paused then 'Paused|Workspace is paused'
      when pod is null and has_sw then 'Error|Workspace StatefulSet has warning event: ' || sw
      when pod is null then 'Pending|Workspace is pending: Waiting for Pod to be created'
      when deleting then 'Terminating|Workspace is terminating'
      when revision <> update_revision then 'Pending|Workspace is pending: Waiting for Pod to be updated'
      when scheduled_status <> 'True' and scheduled_reason = 'Unschedulable' then
        'Error|Workspace Pod is unschedulable: ' || scheduled_message
      when scheduled_status <> 'True' and scheduled_reason = 'SchedulingGated' then
        'Error|Workspace Pod is waiting for scheduling gate: ' || scheduled_message
      when scheduled_status <> 'True' and scheduled_reason = 'SchedulerError' then
        'Error|Workspace Pod has scheduler error: ' || scheduled_message
      when phase = 'Running' and ready_status = 'True' then 'Running|Workspace is running'
      when waiting_reason = 'CrashLoopBackOff' then
        'Error|Workspace Container is not running (CrashLoopBackOff): ' || waiting_message
      when waiting_reason = 'ImagePullBackOff' then
        'Error|Workspace Container is not running (ImagePullBackOff): ' || waiting_message
      when has_pw then 'Error|Workspace Pod has warning event: ' || pw
      when phase = 'Pending' then 'Pending|Workspace is pending: Pod is pending'
      when phase = 'Running' then 'Pending|Workspace is pending: Pod is running but not ready: ' || ready_message
      when phase = 'Failed' then 'Error|Workspace Pod in failed phase'
      else 'Unknown|Workspace is in an unknown state' end as s from y)
    select namespace, name, split_part(s, '|', 1) as state, substr(s, strpos(s, '|') + 1) as state_message from z""",
)
def _derive_state(t: Fleet) -> DataFrame:
    closure = G.close(t.options)
    inputs = S.state_inputs(t.workspaces, t.kinds, t.options, closure, t.sets, t.pods, t.object_events, t.helper_objects)
    return S.derive_state(inputs)


_HISTORY = """h as (select *, lag(state) over w as prev_state, lag(paused) over w as prev_paused from state_history
      window w as (partition by namespace, workspace order by ts_ms, seq)),
    starts as (select * from h where state = 'Running' and prev_state is distinct from 'Running'),
    since as (select h.namespace, h.workspace, max_by(h.state, (h.ts_ms, h.seq)) as state,
      coalesce((select max(s.ts_ms) from starts s where s.namespace = h.namespace and s.workspace = h.workspace), 0)
        as last_running_ms,
      (select count(*) from starts s where s.namespace = h.namespace and s.workspace = h.workspace) as runs
    from h group by 1, 2)"""


@query("running_epochs", f"with {_HISTORY} select namespace, workspace, ts_ms, seq from starts")
def _running_epochs(t: Fleet) -> DataFrame:
    return T.running_epochs(t.state_history).select("namespace", "workspace", "ts_ms", "seq")


@query("running_since", f"with {_HISTORY} select * from since")
def _running_since(t: Fleet) -> DataFrame:
    return T.running_since(t.state_history)


@query(
    "pause_time",
    f"""with {_HISTORY}, last as (select namespace, workspace, max_by(paused, (ts_ms, seq)) as paused,
      max(ts_ms) filter (where paused and not coalesce(prev_paused, false)) as began from h group by 1, 2)
    select namespace, workspace, paused, case when paused then began else 0 end as pause_ms from last""",
)
def _pause_time(t: Fleet) -> DataFrame:
    return T.pause_time(t.state_history)


@query(
    "probe_due",
    f"""with r as (select w.namespace, w.name, w.probe_start_ms as start, case when w.probe_result = 'Success'
        then coalesce(k.interval_s, 3600) else 300 end * 1000 as required, {NOW_MS} - w.probe_start_ms as elapsed
      from workspaces w join kinds k on k.name = w.kind where k.has_probe),
    d as (select *, start is not null and start > 0 and elapsed < required as waiting from r)
    select namespace, name, not waiting as due, cast(case when waiting then required - elapsed else 0 end as bigint)
      as remaining_ms from d""",
)
def _probe_due(t: Fleet) -> DataFrame:
    kinds = t.kinds.filter("probe is not null").select(
        F.col("name").alias("kind"), F.col("probe.interval_s"), F.col("probe.min_interval_s")
    )
    rows = t.workspaces.select("namespace", "name", "kind", "probe_start_ms", "probe_result").join(kinds, "kind")
    due = T.probe_due(
        rows, NOW_MS, F.col("interval_s"), F.col("min_interval_s"), F.col("probe_start_ms"), F.col("probe_result")
    )
    return due.select("namespace", "name", "due", "remaining_ms")


_PROBES = """told as (select *, case when result <> 'Success' then result
        when output in ('not json', '{"has_activity": "yes"}', '{"last_activity": "noon"}') then 'Failure'
        else result end as outcome from probes),
    read as (select * replace (outcome as result), case when outcome <> 'Success' then null
      when trim(output) = '' or output = '{}' or output = '{"has_activity": true}' then end_ms
      when output like '{"has_activity": false%' then null
      else epoch_us(cast(substr(output, 20, 10) || ' 08:00:00' as timestamp)) // 1000 end as activity_ms from told)"""


@query(
    "probe_activity",
    f"with {_PROBES} select event_id, namespace, workspace, start_ms, result, activity_ms from read",
)
def _probe_activity(t: Fleet) -> DataFrame:
    return T.probe_activity(t.probes).select(
        "event_id", "namespace", "workspace", "start_ms", "result", "activity_ms"
    )


@query(
    "fold_probes",
    f"""with {_HISTORY}, {_PROBES}, cur as (select r.*, coalesce(s.last_running_ms, 0) as last_running_ms
      from read r left join since s on s.namespace = r.namespace and s.workspace = r.workspace
      where r.start_ms >= coalesce(s.last_running_ms, 0)),
    f as (select namespace, workspace, max(last_running_ms) as last_running_ms,
      max_by(activity_ms, (start_ms, event_id)) filter (where result = 'Success' and activity_ms is not null) as told_ms,
      count(*) filter (where result = 'Success' and activity_ms is null) as silent,
      max_by(end_ms, (start_ms, event_id)) filter (where result = 'Success') as last_update_ms,
      max_by(start_ms, (start_ms, event_id)) as last_probe_start_ms,
      max_by(result, (start_ms, event_id)) as last_probe_result, count(*) as probes from cur group by 1, 2)
    select namespace, workspace, last_running_ms, case when told_ms is not null then told_ms
      when silent > 0 and last_running_ms > 0 then last_running_ms else 0 end as last_activity_ms,
      coalesce(last_update_ms, 0) as last_update_ms, last_probe_start_ms, last_probe_result, probes from f""",
)
def _fold_probes(t: Fleet) -> DataFrame:
    running = T.running_since(t.state_history)
    return T.fold_probes(T.probe_activity(t.probes), running, ["start_ms", "event_id"])


@query(
    "activity_level",
    f"""with r as (select namespace, name, eligible_after_ms, case when state = 'Running' then eligible_after_ms - {NOW_MS}
      end as remaining_ms from workspaces)
    select namespace, name, remaining_ms, case when remaining_ms <= 300000 then 'critical' when remaining_ms <= 900000
      then 'warning' else 'none' end as level, remaining_ms is not null and eligible_after_ms = 0 as activity_unknown
    from r""",
)
def _activity_level(t: Fleet) -> DataFrame:
    rows = t.workspaces.select("namespace", "name", "state", "eligible_after_ms")
    return T.activity_level(rows, NOW_MS).drop("state", "eligible_after_ms")


@query(
    "escalations",
    """with p as (select l.*, coalesce(b.level, 'none') as from_level from levels l left join levels b
      on b.namespace = l.namespace and b.workspace = l.workspace and b.snapshot_id = l.snapshot_id - 1)
    select namespace, workspace, snapshot_id, from_level, level as to_level from p
    where (from_level = 'none' and level <> 'none' or from_level = 'warning' and level = 'critical')
      and snapshot_id > (select min(snapshot_id) from levels)""",
)
def _escalations(t: Fleet) -> DataFrame:
    return T.escalations(t.snapshot_levels)


def _logs(t: Fleet) -> DataFrame:
    return parse_log_lines(t.log_text).withColumn("previous", F.lit(False))


_TAIL = """with n as (select *, row_number() over (partition by namespace, workspace, container
        order by ts_ms desc, seq desc) as n from log_lines where container = 'main' {since}),
    b as (select *, cast(sum(strlen(line) + 1) over (partition by namespace, workspace, container order by ts_ms, seq)
      as bigint) as bytes from n where n <= {lines})
    select namespace, workspace, container, ts_ms, seq, line, bytes from b where bytes <= {cap}"""


def _tail_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_ms", F.unix_millis("ts")).drop("ts", "previous")


@query("log_tail", _TAIL.format(since="", lines=1000, cap=100 * 1024 * 1024))
def _log_tail(t: Fleet) -> DataFrame:
    return _tail_columns(T.log_tail(_logs(t)))


@query("log_tail_since", _TAIL.format(since="and ts_ms >= 1704067203000", lines=5, cap=900))
def _log_tail_since(t: Fleet) -> DataFrame:
    since = F.timestamp_millis(F.lit(1704067203000))
    return _tail_columns(T.log_tail(_logs(t), lines=5, since=since, byte_cap=900))


_ASKED = """r as (select request_id, namespace, name as workspace, case op when 'create' then null when 'pause' then 'main'
      when 'update' then 'proxy' else 'setup' end as container, image_id like 'img-new%' as previous from reqs)"""


def _asked(t: Fleet) -> DataFrame:
    op = F.col("op")
    container = F.when(op == "pause", "main").when(op == "update", "proxy").when(op == "start", "setup")
    return t.requests.select(
        "request_id",
        "namespace",
        F.col("name").alias("workspace"),
        container.alias("container"),
        F.col("image_id").startswith("img-new").alias("previous"),
    )


@query(
    "log_availability",
    f"""with {_ASKED} select r.*, case when w.name is null then 'WORKSPACE_NOT_FOUND'
      when w.pod_name = '' or p.name is null then 'POD_NOT_RUNNING'
      when r.container = 'proxy' and p.sidecar <> 'proxy' then 'CONTAINER_NOT_FOUND'
      when r.previous and (r.container = 'proxy' or coalesce(r.container, 'main') = 'main' and not p.has_previous)
        then 'PREVIOUS_NOT_FOUND'
      when not r.previous and coalesce(r.container, 'main') = 'main' and p.waiting_reason is not null
        then 'CONTAINER_NOT_RUNNING' else 'AVAILABLE' end as status
    from r left join workspaces w on w.namespace = r.namespace and w.name = r.workspace
    left join pods p on p.namespace = w.namespace and p.name = w.pod_name""",
)
def _log_availability(t: Fleet) -> DataFrame:
    return T.log_availability(_asked(t), t.workspaces, t.pods)


@query(
    "usage_status",
    """with by_label as (select namespace, workspace_label, min(name) as pod from pods
      where workspace_label is not null group by 1, 2),
    sampled as (select distinct namespace, pod from usage_samples)
    select r.request_id, r.namespace, r.name as workspace, l.pod, case when w.name is null then 'WORKSPACE_NOT_FOUND'
      when l.pod is null then 'WORKSPACE_NOT_RUNNING' when s.pod is null then 'PENDING' else 'AVAILABLE' end as status
    from reqs r left join workspaces w on w.namespace = r.namespace and w.name = r.name
    left join by_label l on l.namespace = w.namespace and l.workspace_label = w.name
    left join sampled s on s.namespace = l.namespace and s.pod = l.pod""",
)
def _usage_status(t: Fleet) -> DataFrame:
    requests = t.requests.select("request_id", "namespace", F.col("name").alias("workspace"))
    pods = workspace_pods_by_label(t.workspaces.select("namespace", "name"), t.pods)
    return T.usage_status(requests, t.workspaces, pods, t.usage_samples)
