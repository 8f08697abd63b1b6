"""Denormalised views and small view columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.functions import columns as K
from fleetloom.functions import labels as L
from fleetloom.operators import views as V
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

_AUDIT = """created_ms as created_at_ms, created_by, case when updated_at like '____-__-__T%Z' then
  epoch_us(try_cast(replace(replace(updated_at, 'T', ' '), 'Z', '') as timestamp)) // 1000 end as updated_at_ms,
  updated_by"""


@query(
    "workspace_view",
    f"""select w.namespace, w.name, coalesce(w.display_name, '') as display_name, w.kind,
      not w.kind_known as kind_missing, w.paused, w.pause_ms, w.last_running_ms, w.state, w.state_message,
      coalesce(i.display_name, '__UNKNOWN_IMAGE_CONFIG__') as image_display,
      case when i.id is null then '__UNKNOWN_IMAGE_CONFIG__' else coalesce(i.description, '') end as image_text,
      coalesce(p.display_name, '__UNKNOWN_POD_CONFIG__') as pod_display,
      cast(case when i.id is not null then 4 end as bigint) as image_label_count,
      cast(case when i.id is not null then 3 end as bigint) as service_count,
      w.last_activity_ms, w.last_update_ms, {_AUDIT}
    from ws_options w left join image_rows i on i.kind = w.kind and i.id = w.image_id
    left join pods_opt p on p.kind = w.kind and p.id = w.pod_id""",
)
def _workspace_view(t: Fleet) -> DataFrame:
    view = V.workspace_view(t.workspaces, t.kinds, t.options)
    return view.select(
        *[c for c in view.columns if c not in ("image", "pod", "image_labels", "pod_labels", "deleted_at_ms")],
        F.col("image.display_name").alias("image_display"),
        F.col("image.description").alias("image_text"),
        F.col("pod.display_name").alias("pod_display"),
        F.when(F.col("image_labels").isNotNull(), F.size("image_labels")).cast("bigint").alias("image_label_count"),
    )


@query(
    "workspace_details",
    """select w.namespace, w.name, nullif(w.pod_name, '') as pod, m.source, m.target,
      case when m.source = 'home' then case when w.kind_known then k.home_path else '__UNKNOWN_HOME_MOUNT_PATH__' end
        else m.mount_path end as mount_path,
      case when m.source is not null then m.source = 'data' and coalesce(m.read_only, false) end as read_only
    from ws_options w left join kinds k on k.name = w.kind
    left join mounts m on m.namespace = w.namespace and m.workspace = w.name""",
)
def _workspace_details(t: Fleet) -> DataFrame:
    return V.workspace_details(t.workspaces, t.kinds, t.mounts)


@query(
    "option_info",
    """select w.namespace, w.name, w.image_id as id, coalesce(i.display_name, '__UNKNOWN_IMAGE_CONFIG__') as display_name,
      case when i.id is null then '__UNKNOWN_IMAGE_CONFIG__' else coalesce(i.description, '') end as description
    from workspaces w left join image_rows i on i.kind = w.kind and i.id = w.image_id""",
)
def _option_info(t: Fleet) -> DataFrame:
    images = t.image_options.select(
        "kind",
        F.col("id").alias("image_id"),
        F.col("display_name").alias("shown"),
        "description",
        F.lit(True).alias("known"),
    )
    joined = t.workspaces.select("namespace", "name", "kind", "image_id").join(images, ["kind", "image_id"], "left")
    known = F.coalesce("known", F.lit(False))
    info = V.option_info(known, F.col("image_id"), F.col("shown"), F.col("description"), C.UNKNOWN_IMAGE)
    return joined.select("namespace", "name", info.alias("o")).select("namespace", "name", "o.*")


@query(
    "labels_map",
    """select kind, option_type, id, key, arg_max(value, label_pos) as value from option_labels group by 1, 2, 3, 4""",
)
def _labels_map(t: Fleet) -> DataFrame:
    return t.options.select("kind", "option_type", "id", F.explode(L.labels_map(F.col("labels"))).alias("key", "value"))


@query("audit_cols", f"select namespace, name, {_AUDIT} from workspaces")
def _audit_cols(t: Fleet) -> DataFrame:
    none = F.lit(None).cast("bigint")
    marks = K.audit_cols(F.col("created_ms"), none, F.col("annotations"))
    return t.workspaces.select("namespace", "name", *marks).drop("deleted_at_ms")


@query(
    "permission_cols",
    """select namespace, name, coalesce(can_mount_label = 'true', false) as can_mount,
      coalesce(can_update_label = 'true', false) as can_update, false as can_use, 'claim' as object from pvcs
    union all select namespace, name, coalesce(can_mount_label = 'true', false),
      coalesce(can_update_label = 'true', false), false, 'secret' from secret_meta
    union all select null, name, false, false, coalesce(can_use_label = 'true', false), 'class' from storage_classes""",
)
def _permission_cols(t: Fleet) -> DataFrame:
    def rows(df: DataFrame, kind: str, namespaced: bool = True) -> DataFrame:
        namespace = F.col("namespace") if namespaced else F.lit(None).cast("string")
        return df.select(
            namespace.alias("namespace"), "name", *L.permission_cols(F.col("labels")), F.lit(kind).alias("object")
        )

    return (
        rows(t.pvcs, "claim").unionByName(rows(t.secrets, "secret")).unionByName(rows(t.storage_classes, "class", False))
    )


@query(
    "redirect_level",
    """select kind, option_type, id, case when redirect_level in ('Info', 'Warning', 'Danger') then redirect_level
      else 'Info' end as level from options""",
)
def _redirect_level(t: Fleet) -> DataFrame:
    return t.options.select("kind", "option_type", "id", K.redirect_level(F.col("redirect.level")).alias("level"))


@query(
    "service_urls",
    """select w.namespace, w.name, o.port_id, coalesce(o.display_name, k.default_display_name) as display_name,
      '/workspace/connect/' || w.namespace || '/' || w.name || '/' || o.port_id || '/' as path,
      o.port_id = 'api' as remove_prefix, cast(o.port as bigint) as target_port
    from workspaces w join image_ports o on o.kind = w.kind and o.option_id = w.image_id
    join kind_ports k on k.kind = w.kind and k.id = o.port_id where k.protocol = 'HTTP'""",
)
def _service_urls(t: Fleet) -> DataFrame:
    return V.service_urls(t.workspaces, t.options, t.kinds)


@query(
    "merge_metadata",
    """with layers as (
      select w.namespace, w.name, 1 as layer, 'team' as key, k.team as value from ws_options w
        join kinds k on k.name = w.kind where w.image_known
      union all select w.namespace, w.name, 2, l.key, l.value from ws_options w join (
        select kind, id, key, arg_max(value, label_pos) as value from option_labels where option_type = 'image'
        group by 1, 2, 3) l on l.kind = w.kind and l.id = w.image_id where w.kind_known
      union all select namespace, name, 3, 'fleet/created-by', created_by from ws_options
        where created_by is not null and kind_known and image_known
      union all select namespace, name, 3, 'fleet/updated-at', updated_at from ws_options
        where updated_at is not null and kind_known and image_known
      union all select namespace, name, 3, 'fleet/updated-by', updated_by from ws_options
        where updated_by is not null and kind_known and image_known
      union all select namespace, name, 4, 'size', name from ws_options where kind_known and image_known)
    select namespace, name, key, arg_max(value, layer) as value from layers group by 1, 2, 3""",
)
def _merge_metadata(t: Fleet) -> DataFrame:
    from fleetloom.operators.joins import with_current_option, with_kind

    joined = with_current_option(
        with_kind(
            t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id", "annotations"),
            t.kinds.select("name", "labels"),
        ).filter(~F.col("kind_missing")),
        t.options.select("kind", "option_type", "id", "labels"),
    ).filter("image_known")
    merged = V.merge_metadata(
        F.map_filter("kind_labels", lambda k, _v: k == "team"),
        L.labels_map(F.col("image_opt_labels")),
        F.col("annotations"),
        F.create_map(F.lit("size"), F.col("name")),
    )
    return joined.select("namespace", "name", F.explode(merged).alias("key", "value"))


@query(
    "merge_env",
    """select namespace, name, 0 as pos, 'LANG' as env, 'C' as value from ws_options where image_known
    union all select namespace, name, 1, 'SIZE', case when pod_known then pod_id else image_size_raw end from (
      select w.*, i.size_label as image_size_raw from ws_options w join image_rows i
      on i.kind = w.kind and i.id = w.image_id) where image_known
    union all select w.namespace, w.name, 2, 'TYPE', i.type_label from workspaces w join image_rows i
      on i.kind = w.kind and i.id = w.image_id
    union all select namespace, name, 3, 'POD', cast(pod_k as varchar) from ws_options where image_known and pod_known""",
)
def _merge_env(t: Fleet) -> DataFrame:
    from fleetloom.operators.joins import with_current_option

    joined = with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"),
        t.options.select("kind", "option_type", "id", "env"),
    ).filter("image_known")
    merged = V.merge_env(F.col("image_opt_env"), F.col("pod_opt_env"))
    return joined.select("namespace", "name", F.posexplode(merged).alias("pos", "e")).select(
        "namespace", "name", "pos", F.col("e.name").alias("env"), F.col("e.value").alias("value")
    )


@query(
    "display_name",
    "select namespace, name, case when trim(display_name) <> '' then display_name else name end as shown from workspaces",
)
def _display_name(t: Fleet) -> DataFrame:
    shown = K.display_name(F.col("name"), F.col("display_name"))
    return t.workspaces.select("namespace", "name", shown.alias("shown"))


@query(
    "package_labels",
    "select kind, option_type, id, key, value from option_labels where ends_with(key, 'Version')",
)
def _package_labels(t: Fleet) -> DataFrame:
    return t.options.select("kind", "option_type", "id", F.explode(L.package_labels(F.col("labels"))).alias("l")).select(
        "kind", "option_type", "id", "l.*"
    )


@query(
    "resource_value",
    """select o.kind, o.option_type, o.id, arg_min(l.value, l.label_pos) filter (where l.key = 'type') as type_value,
      arg_min(l.value, l.label_pos) filter (where l.key = 'cpu') as cpu_value from options o
    left join option_labels l on l.kind = o.kind and l.option_type = o.option_type and l.id = o.id group by 1, 2, 3""",
)
def _resource_value(t: Fleet) -> DataFrame:
    return t.options.select(
        "kind",
        "option_type",
        "id",
        L.first_label(F.col("labels"), "type").alias("type_value"),
        L.first_label(F.col("labels"), "cpu").alias("cpu_value"),
    )


@query("normalise_state", "select namespace, name, coalesce(nullif(state, ''), 'Unknown') as state from workspaces")
def _normalise_state(t: Fleet) -> DataFrame:
    return t.workspaces.select("namespace", "name", K.normalise_state(F.col("state")).alias("state"))


@query(
    "revision",
    "select namespace, name, sha256(uid || ':' || name || ':' || cast(generation as varchar)) as revision from workspaces",
)
def _revision(t: Fleet) -> DataFrame:
    marker = K.revision(F.col("uid"), F.col("name"), F.col("generation"))
    return t.workspaces.select("namespace", "name", marker.alias("revision"))


@query(
    "kind_status",
    """select w.namespace, w.name, case when k.deprecated then 'Deprecated' else 'Active' end as status
    from workspaces w join kinds k on k.name = w.kind""",
)
def _kind_status(t: Fleet) -> DataFrame:
    status = t.kinds.select(F.col("name").alias("kind"), K.kind_status(F.col("deprecated")).alias("status"))
    return t.workspaces.select("namespace", "name", "kind").join(status, "kind").drop("kind")


_MOUNTS = """own as (select m.namespace, m.workspace, case when m.source = 'home' then k.home_path else m.mount_path end
      as mount_path, case m.source when 'home' then 0 when 'data' then 1 else 2 end as class, m.pos,
      case when m.source = 'home' then 'home-volume' else m.source || '-volume-' || cast(m.pos as varchar) end as volume,
      m.target, m.source = 'data' and coalesce(m.read_only, false) as read_only
      from mounts m join workspaces w on w.namespace = m.namespace and w.name = m.workspace
      join kinds k on k.name = w.kind),
    cand as (select * from own
      union all select w.namespace, w.name, '/dev/shm', 3, 0, 'shm', null, false from workspaces w
        join kinds k on k.name = w.kind
      union all select w.namespace, w.name, '/mnt/0', 3, 1, 'shm', null, false from workspaces w
        join kinds k on k.name = w.kind),
    ranked as (select distinct *, rank() over (partition by namespace, workspace, mount_path
      order by class, pos, volume, target nulls first, read_only) as r from cand)
    select namespace, workspace, mount_path, case class when 0 then 'home' when 1 then 'data' when 2 then 'secret'
      else 'extra' end as source, volume, target, read_only from ranked"""


@query("effective_mounts", f"with {_MOUNTS} where r = 1")
def _effective_mounts(t: Fleet) -> DataFrame:
    return V.effective_mounts(t.workspaces, t.kinds, t.mounts)


@query("dropped_mounts", f"with {_MOUNTS} where r > 1")
def _dropped_mounts(t: Fleet) -> DataFrame:
    return V.dropped_mounts(t.workspaces, t.kinds, t.mounts)


@query(
    "effective_settings",
    """select w.namespace, w.name, cast(case when w.paused then 0 else 1 end as bigint) as replicas,
      case when i.size_num < 15 then 'Always' else 'IfNotPresent' end as pull_policy,
      coalesce(p.scheduler, k.scheduler, '') as scheduler, cast((p.k + 1) * 250 as varchar) || 'm' as cpu_request,
      case when p.k < 6 then cast(p.k + 1 as varchar) end as cpu_limit
    from workspaces w join kinds k on k.name = w.kind join image_rows i on i.kind = w.kind and i.id = w.image_id
    join pods_opt p on p.kind = w.kind and p.id = w.pod_id""",
)
def _effective_settings(t: Fleet) -> DataFrame:
    settings = V.effective_settings(t.workspaces, t.kinds, t.options)
    return settings.select(
        "namespace",
        "name",
        "replicas",
        "pull_policy",
        "scheduler",
        F.try_element_at("resources.requests", F.lit("cpu")).alias("cpu_request"),
        F.try_element_at("resources.limits", F.lit("cpu")).alias("cpu_limit"),
    )


@query(
    "stamp_audit",
    """select namespace, name, created_by as create_created_by, created_by as create_updated_by,
      case when created_by is not null then updated_at end as create_updated_at,
      '2024-02-01T00:00:00Z' as update_updated_at, created_by as update_updated_by from workspaces""",
)
def _stamp_audit(t: Fleet) -> DataFrame:
    actor = F.col("created_by")
    created = K.stamp_create(F.col("annotations"), actor)
    updated = K.stamp_update(F.col("annotations"), actor, F.lit("2024-02-01T00:00:00Z"))

    def mark(column, key):
        return F.try_element_at(column, F.lit(key))

    return t.workspaces.select(
        "namespace",
        "name",
        mark(created, C.CREATED_BY).alias("create_created_by"),
        mark(created, C.UPDATED_BY).alias("create_updated_by"),
        mark(created, C.UPDATED_AT).alias("create_updated_at"),
        mark(updated, C.UPDATED_AT).alias("update_updated_at"),
        mark(updated, C.UPDATED_BY).alias("update_updated_by"),
    )
