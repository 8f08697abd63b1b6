"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.operators import joins as J
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query


@query(
    "with_kind",
    """select w.namespace, w.name, w.kind, k.display_name as kind_display_name, k.name is null as kind_missing
    from workspaces w left join kinds k on k.name = w.kind""",
)
def _with_kind(t: Fleet) -> DataFrame:
    return J.with_kind(t.workspaces.select("namespace", "name", "kind"), t.kinds.select("name", "display_name"))


@query(
    "with_current_option",
    """select namespace, name, image_id, pod_id, image_known, pod_known, image_display, pod_display from (
      select w.*, i.display_name as image_display, p.display_name as pod_display
      from ws_options w left join image_rows i on i.kind = w.kind and i.id = w.image_id
      left join pods_opt p on p.kind = w.kind and p.id = w.pod_id)""",
)
def _with_current_option(t: Fleet) -> DataFrame:
    joined = J.with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"),
        t.options.select("kind", "option_type", "id", "display_name"),
    )
    return joined.drop("kind").withColumnsRenamed(
        {"image_opt_display_name": "image_display", "pod_opt_display_name": "pod_display"}
    )


@query(
    "annotate_chain",
    """with steps as (select kind, id as source, case when size_num % 6 = 0 then 'img-' || cast(pos as varchar) || 'x'
        else redirect_to end as target from image_rows where redirect_to is not null)
    select s.kind, s.source, s.target, o.display_name as source_display,
      coalesce(d.display_name, '__UNKNOWN_IMAGE_CONFIG__') as target_display,
      case when o.redirect_to = s.target and o.redirect_text is not null then
        case when o.redirect_level in ('Info', 'Warning', 'Danger') then o.redirect_level else 'Info' end end
        as message_level,
      case when o.redirect_to = s.target then o.redirect_text end as message_text
    from steps s join image_rows o on o.kind = s.kind and o.id = s.source
    left join image_rows d on d.kind = s.kind and d.id = s.target""",
)
def _annotate_chain(t: Fleet) -> DataFrame:
    stale = F.element_at("labels", 2)["value"].cast("int") % 6 == 0
    steps = t.image_options.filter(F.col("redirect").isNotNull()).select(
        "kind",
        "option_type",
        F.col("id").alias("source"),
        F.when(stale, F.concat("id", F.lit("x"))).otherwise(F.col("redirect.to")).alias("target"),
    )
    return J.annotate_chain(steps, t.image_options, F.lit(C.UNKNOWN_IMAGE)).drop("option_type")


@query(
    "pvc_pods",
    """select p.namespace, p.name as claim, c.pod, c.phase as pod_phase from pvcs p
    left join pod_claims c on c.namespace = p.namespace and c.claim = p.name""",
)
def _pvc_pods(t: Fleet) -> DataFrame:
    return J.pvc_pods(t.pvcs, t.pods).drop("pod_node")


@query(
    "pvc_workspaces",
    """select p.namespace, p.name as claim, c.workspace, w.state from pvcs p
    left join claim_workspaces c on c.namespace = p.namespace and c.claim = p.name
    left join workspaces w on w.namespace = c.namespace and w.name = c.workspace""",
)
def _pvc_workspaces(t: Fleet) -> DataFrame:
    return J.pvc_workspaces(t.pvcs, t.mounts, t.workspaces).drop("pod_name")


@query(
    "pvc_volume",
    """select p.namespace, p.name, p.storage_class, v.uid as volume_uid, v.reclaim,
      case when v.uid is not null then s.uid end as class_uid,
      case when v.uid is not null then s.display_name end as class_display_name
    from pvcs p left join pvs v on v.name = p.volume left join storage_classes s on s.name = p.storage_class""",
)
def _pvc_volume(t: Fleet) -> DataFrame:
    joined = J.pvc_volume(t.pvcs.drop("labels", "access_modes", "size"), t.pvs, t.storage_classes)
    return joined.drop("volume", "volume_mode")


@query(
    "secret_mounts",
    """select s.namespace, s.name as secret, m.workspace from secret_meta s left join (
      select distinct m.namespace, m.target, m.workspace from mounts m
      join workspaces w on w.namespace = m.namespace and w.name = m.workspace where m.source = 'secret') m
    on m.namespace = s.namespace and m.target = s.name""",
)
def _secret_mounts(t: Fleet) -> DataFrame:
    return J.secret_mounts(t.secrets, t.mounts, t.workspaces)


_LATEST = """select namespace, pod, container, arg_max(cpu, (ts_ms, seq, cpu, memory)) as cpu,
  arg_max(memory, (ts_ms, seq, cpu, memory)) as memory, max(ts_ms) as ts_ms
  from usage_samples group by namespace, pod, container"""


@query(
    "container_usage",
    f"""with u as ({_LATEST}), c as (
      select namespace, name as pod, 'main' as container, cpu_request, memory_limit from pods
      union all select namespace, name, sidecar, null, null from pods)
    select c.namespace, c.pod, c.container, c.cpu_request, c.memory_limit, u.cpu, u.memory, u.ts_ms
    from c left join u on u.namespace = c.namespace and u.pod = c.pod and u.container = c.container""",
)
def _container_usage(t: Fleet) -> DataFrame:
    return J.container_usage(t.pods, t.usage_samples, ["ts", "seq", "cpu", "memory"]).select(
        "namespace",
        "pod",
        "container",
        F.try_element_at("requests", F.lit("cpu")).alias("cpu_request"),
        F.try_element_at("limits", F.lit("memory")).alias("memory_limit"),
        "cpu",
        "memory",
        F.unix_millis("ts").alias("ts_ms"),
    )


@query(
    "image_ports",
    """select o.kind, o.option_id as image_id, cast(o.port_pos as bigint) as port_pos, o.port_id,
      cast(o.port as bigint) as port, k.protocol
    from image_ports o join kind_ports k on k.kind = o.kind and k.id = o.port_id""",
)
def _image_ports(t: Fleet) -> DataFrame:
    return J.image_ports(t.options, t.kinds).select("kind", "image_id", "port_pos", "port_id", "port", "protocol")


@query(
    "event_owner",
    """select e.event_id, e.namespace, e.involved_uid as uid, w.name as workspace, e.type from object_events e
    join workspaces w on w.namespace = e.namespace and e.involved_uid in (w.pod_uid, w.set_uid)
    where e.involved_uid <> ''""",
)
def _event_owner(t: Fleet) -> DataFrame:
    events = t.object_events.select("event_id", "namespace", "involved_uid", "type")
    return J.event_owner(events, t.workspaces)


@query(
    "affected_workspaces",
    "select namespace, name, kind from workspaces where kind in (select name from kinds where deprecated)",
)
def _affected_workspaces(t: Fleet) -> DataFrame:
    changed = t.kinds.filter("deprecated")
    return J.affected_workspaces(changed, t.workspaces.select("namespace", "name", "kind"))


@query(
    "affected_kinds",
    """with changed as (select distinct name from assets where labelled)
    select name as kind from kinds where icon_url is null and icon_name in (select name from changed)
      or logo_name in (select name from changed)""",
)
def _affected_kinds(t: Fleet) -> DataFrame:
    from fleetloom.sources.snapshots import labelled_source

    return J.affected_kinds(labelled_source(t.assets), t.kinds)


_ASSET_STATUS = """select r.kind, r.asset, r.url, case when r.url is not null then null
    when not exists (select 1 from assets a where a.name = r.name) then 'NotFound'
    when h.sha is null then 'KeyNotFound' end as code, h.sha as sha256 from (
      select name as kind, 'icon' as asset, icon_url as url, case when icon_url is null then icon_name end as name,
        case when icon_url is null then icon_key end as key from kinds
      union all select name, 'logo', null, logo_name, logo_key from kinds) r
    left join asset_hash h on h.name = r.name and h.key = r.key"""


@query(
    "asset_status",
    f"""with s as ({_ASSET_STATUS})
    select kind, asset, code as error, sha256 from s""",
)
def _asset_status(t: Fleet) -> DataFrame:
    return J.asset_status(t.kinds, t.assets).select("kind", "asset", "error", "sha256")


@query(
    "asset_ref",
    f"""with s as ({_ASSET_STATUS})
    select kind, asset, coalesce(url, '/hub/api/v1/workspacekinds/' || kind || '/assets/' || asset ||
      coalesce('?sha256=' || sha256, '')) as url,
      case code when 'NotFound' then 'CONFIGMAP_MISSING' when 'KeyNotFound' then 'CONFIGMAP_KEY_MISSING' end as error
    from s""",
)
def _asset_ref(t: Fleet) -> DataFrame:
    from fleetloom.operators.views import asset_ref

    return asset_ref(t.kinds, t.assets, "/hub/")


@query("content_hashes", "select namespace, name, key, sha as sha256 from asset_hash")
def _content_hashes(t: Fleet) -> DataFrame:
    return J.content_hashes(t.assets)


@query(
    "pod_for_workspace",
    """select s.namespace, s.name, p.uid as found_pod_uid, p.uid is not null and p.owner_uid <> s.uid as pod_foreign
    from sets s left join pods p on p.namespace = s.namespace and p.name = s.name || '-0'""",
)
def _pod_for_workspace(t: Fleet) -> DataFrame:
    found = J.pod_for_workspace(t.sets.select("namespace", "name", "uid"), t.pods)
    return found.select("namespace", "name", "found_pod_uid", "pod_foreign")


@query(
    "workspace_pods_by_label",
    """select w.namespace, w.name as workspace, p.pod, p.phase as pod_phase, p.pod is not null as running
    from workspaces w left join (select namespace, workspace_label, min(name) as pod, arg_min(phase, name) as phase
      from pods where workspace_label is not null group by 1, 2) p
    on p.namespace = w.namespace and p.workspace_label = w.name""",
)
def _pods_by_label(t: Fleet) -> DataFrame:
    return J.workspace_pods_by_label(t.workspaces.select("namespace", "name"), t.pods)


_CONFLICTS = """with users as (select c.*, w.pod_name from claim_workspaces c
      join workspaces w on w.namespace = c.namespace and w.name = c.workspace),
    other as (select u.namespace, u.claim, u.workspace, p.mode_class,
      exists (select 1 from users o where o.namespace = u.namespace and o.claim = u.claim
        and o.workspace <> u.workspace) as ws_conflict,
      exists (select 1 from pod_claims q where q.namespace = u.namespace and q.claim = u.claim
        and q.pod <> u.pod_name and q.phase not in ('Succeeded', 'Failed')) as pod_conflict
      from users u join pvcs p on p.namespace = u.namespace and p.name = u.claim)"""


@query(
    "mount_blocked",
    f"""{_CONFLICTS} select namespace, claim, workspace, ws_conflict, pod_conflict,
      mode_class = 'rwop' and (ws_conflict or pod_conflict) as blocked from other""",
)
def _mount_blocked(t: Fleet) -> DataFrame:
    return J.mount_conflicts(t.mounts, t.pvcs, t.pods, t.workspaces).select(
        "namespace",
        "claim",
        "workspace",
        F.col("other_workspace").isNotNull().alias("ws_conflict"),
        F.col("other_pod").isNotNull().alias("pod_conflict"),
        "blocked",
    )


@query(
    "rwo_in_use_warning",
    f"""{_CONFLICTS} select namespace, claim, workspace from other
    where mode_class in ('rwo', 'mixed') and (ws_conflict or pod_conflict)""",
)
def _rwo_warning(t: Fleet) -> DataFrame:
    conflicts = J.mount_conflicts(t.mounts, t.pvcs, t.pods, t.workspaces)
    return conflicts.filter("rwo_warning").select("namespace", "claim", "workspace")


@query(
    "unmountable_reason",
    """select p.namespace, p.name, coalesce(p.can_mount_label = 'true', false) as can_mount,
      cast(case when p.can_mount_label = 'true' then null when p.mode_class = 'rwop' and exists (
        select 1 from pod_claims c where c.namespace = p.namespace and c.claim = p.name) then 1
      when p.mode_class in ('rwo', 'mixed') and exists (select 1 from claim_workspaces c
        where c.namespace = p.namespace and c.claim = p.name) then 2 end as bigint) as reason from pvcs p""",
)
def _unmountable(t: Fleet) -> DataFrame:
    reasons = J.unmountable_reason(t.pvcs, t.pods, t.mounts, t.workspaces)
    return reasons.select("namespace", "name", "can_mount", "reason")
