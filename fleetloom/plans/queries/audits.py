"""Audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import audits as V
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query


@query(
    "unknown_kinds",
    """select namespace, name, 'workspace kind "' || kind || '" not found' as message from ws_options
    where not kind_known""",
)
def _unknown_kinds(t: Fleet) -> DataFrame:
    return V.unknown_kinds(t.workspaces, t.kinds)


_UNKNOWN = """select namespace, name, kind, 'image' as option_type, image_id as id from ws_options
      where kind_known and not image_known
    union all select namespace, name, kind, 'pod', pod_id from ws_options where kind_known and not pod_known"""


@query("unknown_options", _UNKNOWN)
def _unknown_options(t: Fleet) -> DataFrame:
    return V.unknown_options(t.workspaces, t.kinds, t.options)


@query(
    "unknown_options_changed",
    f"with u as ({_UNKNOWN}) select * from u where option_type = 'image'",
)
def _unknown_options_changed(t: Fleet) -> DataFrame:
    previous = t.workspaces.withColumn("image_id", F.lit("img-before"))
    return V.unknown_options(t.workspaces, t.kinds, t.options, previous)


@query(
    "missing_defaults",
    """with d as (select name as kind, 'image' as option_type, default_image as id from kinds
      union all select name, 'pod', default_pod from kinds)
    select d.* from d where not exists (select 1 from options o where o.kind = d.kind
      and o.option_type = d.option_type and o.id = d.id)""",
)
def _missing_defaults(t: Fleet) -> DataFrame:
    return V.missing_defaults(t.kinds, t.options)


@query(
    "dangling_redirects",
    """select s.kind, s.option_type, s.id as source, s.redirect_to as target from options s
    where s.redirect_to is not null and not exists (select 1 from options o where o.kind = s.kind
      and o.option_type = s.option_type and o.id = s.redirect_to)""",
)
def _dangling_redirects(t: Fleet) -> DataFrame:
    return V.dangling_redirects(t.options)


@query(
    "port_violations",
    """with p as (select i.*, k.id is not null as known, k.protocol, lag(i.port) over w as before1,
        lag(i.port, 2) over w as before2 from image_ports i left join kind_ports k on k.kind = i.kind and k.id = i.port_id
      window w as (partition by i.kind, i.option_id order by i.port_pos))
    select kind, option_id as image_id, port_id, 'Duplicate' as code, 'port ' || port || ' is defined more than once'
      as message from p where port in (before1, before2)
    union all select kind, option_id, port_id, 'Missing', 'missing from the ports of the kind' from p where not known
    union all select kind, option_id, port_id, 'Unsupported', 'unsupported protocol ' || protocol from p
      where protocol <> 'HTTP'""",
)
def _port_violations(t: Fleet) -> DataFrame:
    return V.port_violations(t.options, t.kinds)


@query(
    "claim_audit",
    """with u as (select m.namespace, m.workspace, m.source, m.target as name, p.name as found, p.can_mount_label
      from mounts m left join pvcs p on p.namespace = m.namespace and p.name = m.target where m.source <> 'secret')
    select namespace, workspace, source, name, 'Invalid' as code, 'claim "' || name || '" not found' as message
      from u where found is null
    union all select namespace, workspace, source, name, 'Forbidden',
      'claim "' || name || '" is not labeled with fleet/can-mount=true' from u
      where found is not null and coalesce(can_mount_label, '') <> 'true'""",
)
def _claim_audit(t: Fleet) -> DataFrame:
    return V.claim_audit(t.mounts, t.pvcs)


@query(
    "secret_audit",
    """with u as (select m.namespace, m.workspace, m.target as name, p.name as found, p.can_mount_label
      from mounts m left join secret_meta p on p.namespace = m.namespace and p.name = m.target
      where m.source = 'secret')
    select namespace, workspace, name, 'Invalid' as code, 'secret "' || name || '" not found' as message
      from u where found is null
    union all select namespace, workspace, name, 'Forbidden',
      'secret "' || name || '" is not labeled with fleet/can-mount=true' from u
      where found is not null and coalesce(can_mount_label, '') <> 'true'""",
)
def _secret_audit(t: Fleet) -> DataFrame:
    return V.secret_audit(t.mounts, t.secrets)


@query(
    "storage_class_audit",
    """with u as (select p.namespace, p.name as claim, p.storage_class as name, s.name as found, s.can_use_label
      from pvcs p left join storage_classes s on s.name = p.storage_class)
    select namespace, claim, name, 'Invalid' as code, 'storage class "' || name || '" not found' as message
      from u where found is null
    union all select namespace, claim, name, 'Forbidden',
      'storage class "' || name || '" is not labeled with fleet/can-use=true' from u
      where found is not null and coalesce(can_use_label, '') <> 'true'""",
)
def _storage_class_audit(t: Fleet) -> DataFrame:
    return V.storage_class_audit(t.pvcs, t.storage_classes)


@query(
    "change_request_audit",
    """with o as (select 'secret' as target, namespace, name, can_update_label from secret_meta
      union all select 'claim', namespace, name, can_update_label from pvcs)
    select r.request_id, r.op, r.namespace, r.name, case when o.name is null then 'NotFound'
      when coalesce(o.can_update_label, '') <> 'true' then 'NotUpdatable' else 'Accepted' end as outcome
    from change_requests r left join o on o.namespace = r.namespace and o.name = r.name
      and o.target = case when r.op like '%secret' then 'secret' else 'claim' end""",
)
def _change_request_audit(t: Fleet) -> DataFrame:
    return V.change_request_audit(t.view("change_requests"), t.secrets, t.pvcs)


@query(
    "resource_class",
    """select object, type, case when type = 'example.com/gpu' then 'extended' when type like 'hugepages-%'
      then 'hugepages' when type in ('cpu', 'memory', 'ephemeral-storage') then 'plain' else 'unsupported' end as class
    from resource_entries""",
)
def _resource_class(t: Fleet) -> DataFrame:
    entries = t.view("resource_entries")
    return entries.select("object", "type", V.resource_class(F.col("type")).alias("class"))


# quantities as whole thousandths, parsed by hand from the shapes the binding writes
def _milli(column: str) -> str:
    digits = f"cast(regexp_extract({column}, '[0-9]+') as hugeint)"
    return f"""case when coalesce({column}, '') in ('', '1.2.3') or ends_with({column}, 'kg') then null
      when ends_with({column}, '000m') then {digits} when ends_with({column}, 'm') then {digits}
      when starts_with({column}, '-') then -{digits} * 1000 when ends_with({column}, '.5') then {digits} * 1000 + 500
      when ends_with({column}, 'e3') then {digits} * 1000000 when ends_with({column}, 'Mi') then {digits} * 1048576000
      when ends_with({column}, 'Ki') then {digits} * 1024000 else {digits} * 1000 end"""


def _findings(field: str) -> str:
    value = "r" if field == "request" else "l"
    return f"""union all select object, type, '{field}', 'malformed' from s where "{field}" <> '' and {value} is null
    union all select object, type, '{field}', 'negative' from s where {value} < 0
    union all select object, type, '{field}', 'fractional' from s where counted and {value} >= 0 and {value} % 1000 <> 0
    union all select object, type, '{field}', 'not_in_pages' from s
      where type = 'hugepages-2Mi' and {value} % 2097152000 <> 0"""


@query(
    "resource_audit",
    f"""with e as (select object, type, request, "limit", {_milli("request")} as r, {_milli('"limit"')} as l,
        type = 'example.com/gpu' as counted, type like 'hugepages-%' as sized,
        type in ('cpu', 'memory', 'ephemeral-storage') as plain from resource_entries where type <> ''),
    s as (select * from e where counted or sized or plain)
    select object, type, 'type' as field, 'unknown_type' as code from e where not (counted or sized or plain)
    union all select object, type, 'type', 'bad_page_size' from s where type = 'hugepages-x'
    union all select object, type, 'request', 'differs_from_limit' from s where not plain and r <> l
    union all select object, type, 'request', 'above_limit' from s where plain and r > l
    {_findings("request")} {_findings("limit")}""",
)
def _resource_audit(t: Fleet) -> DataFrame:
    return V.resource_audit(t.view("resource_entries"), ["object"])


@query(
    "mount_path_audit",
    """with m as (select *, trim(mount_path) as trimmed, rtrim(trim(mount_path), '/') as path from mounts),
    c as (select *, count(*) over (partition by namespace, workspace, path) as uses from m)
    select namespace, workspace, source, target, mount_path, case when trimmed = '' then 'empty'
      when length(trimmed) < 2 then 'too_short' else 'not_absolute' end as code from c
      where length(trimmed) < 2 or not starts_with(trimmed, '/') or starts_with(trimmed, '//')
    union all select namespace, workspace, source, target, mount_path, 'in_use' from c
      where uses > 1 and path <> ''""",
)
def _mount_path_audit(t: Fleet) -> DataFrame:
    return V.mount_path_audit(t.mounts)


@query(
    "name_audit",
    """select 'kind' as object_type, name as bad_name from kinds
    union all select 'namespace', n_name from nation
    union all select 'asset', key from (select distinct url as key from pages)""",
)
def _name_audit(t: Fleet) -> DataFrame:
    workspaces = V.name_audit(t.workspaces, "workspace", [])
    kinds = V.name_audit(t.kinds, "kind", [])
    namespaces = V.name_audit(t.namespaces, "namespace", [])
    assets = V.name_audit(t.given("pages").select(F.col("url").alias("name")).distinct(), "asset", [])
    return workspaces.unionByName(kinds).unionByName(namespaces).unionByName(assets)


@query(
    "metadata_audit",
    """select 'event-' || cast(event_id as varchar) as object, 'labels' as map, 'message' as key,
      'malformed label value' as message from object_events
    union all select 'event-' || cast(event_id as varchar), 'labels', '-' || involved_uid, 'malformed label key'
      from object_events
    union all select 'event-' || cast(event_id as varchar), 'annotations', reason || '/a/b', 'malformed annotation key'
      from object_events
    union all select name, 'labels', 'bad key', 'malformed label key' from kinds where n = 6""",
)
def _metadata_audit(t: Fleet) -> DataFrame:
    events = t.object_events.select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("object"),
        F.create_map(
            F.lit("reason"),
            F.col("reason"),
            F.lit("message"),
            F.col("message"),
            F.concat(F.lit("-"), F.col("involved_uid")),
            F.lit(""),
            F.lit("fleet.example.org/kind"),
            F.col("involved_kind"),
        ).alias("labels"),
        F.create_map(
            F.concat("reason", F.lit("/a/b")), F.col("message"), F.lit("Fleet.example.org/Note"), F.col("message")
        ).alias("annotations"),
    )
    kinds = t.kinds.select(F.col("name").alias("object"), "labels", "annotations")
    return V.metadata_audit(events.unionByName(kinds), ["object"], "labels", "annotations")
