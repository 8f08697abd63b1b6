"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import aggregates as A
from fleetloom.operators.joins import pod_containers, with_current_option
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

_COUNTS = """counts as (select kind, option_type, id, count(*) as n from (
      select kind, 'image' as option_type, image_id as id from workspaces
      union all select kind, 'pod', pod_id from workspaces) group by 1, 2, 3),
    usage as (select o.kind, o.option_type, o.id, coalesce(c.n, 0) as workspaces from options o
      left join counts c on c.kind = o.kind and c.option_type = o.option_type and c.id = o.id)"""


@query("option_usage", f"with {_COUNTS} select * from usage")
def _option_usage(t: Fleet) -> DataFrame:
    return A.option_usage(t.workspaces, t.options)


_KIND_TOTAL = "select k.name as kind, count(w.name) as workspaces from kinds k left join workspaces w on w.kind = k.name group by 1"


@query("kind_usage", _KIND_TOTAL)
def _kind_usage(t: Fleet) -> DataFrame:
    return A.kind_usage(t.workspaces, t.kinds)


_KIND_NS = """select w.kind, w.namespace, count(*) as workspaces from workspaces w join kinds k on k.name = w.kind
    group by 1, 2"""


@query("kind_namespace_usage", _KIND_NS)
def _kind_namespace_usage(t: Fleet) -> DataFrame:
    return A.kind_namespace_usage(t.workspaces, t.kinds)


@query(
    "usage_summary",
    f"""with {_COUNTS}, total as ({_KIND_TOTAL}), by_ns as ({_KIND_NS})
    select kind, 'total' as dimension, '' as key, workspaces from total
    union all select kind, option_type, id, workspaces from usage
    union all select kind, 'namespace', namespace, workspaces from by_ns""",
)
def _usage_summary(t: Fleet) -> DataFrame:
    return A.usage_summary(t.workspaces, t.kinds, t.options)


@query(
    "unused_kinds",
    "select name, display_name from kinds where name not in (select kind from workspaces)",
)
def _unused_kinds(t: Fleet) -> DataFrame:
    return A.unused_kinds(t.kinds, t.workspaces).select("name", "display_name")


def _with_pod_labels(t: Fleet) -> DataFrame:
    return with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id", "state"),
        t.options.select("kind", "option_type", "id", "labels"),
    )


_GPU = "case gpu_label when '2' then 2.0 when 'tesla' then 1.0 else 0.0 end"


@query(
    "gpu_totals",
    f"""select cast(coalesce(sum({_GPU}) filter (where state = 'Running'), 0) as double) as in_use,
      cast(sum({_GPU}) as double) as requested from ws_options""",
)
def _gpu_totals(t: Fleet) -> DataFrame:
    return A.gpu_totals(_with_pod_labels(t), F.col("pod_opt_labels"))


_GPU_NS = f"select namespace, cast(sum({_GPU}) as double) as gpus, count(*) as members from ws_options group by 1"


@query(
    "gpu_by_namespace",
    f"with g as ({_GPU_NS}) select namespace, gpus, members from g order by gpus desc, namespace",
)
def _gpu_by_namespace(t: Fleet) -> DataFrame:
    return A.order_by_gpus(A.gpu_by_namespace(_with_pod_labels(t), F.col("pod_opt_labels")))


@query("gpu_members", f"select namespace, name, cast({_GPU} as double) as gpus from ws_options")
def _gpu_members(t: Fleet) -> DataFrame:
    return A.gpu_members(_with_pod_labels(t), F.col("pod_opt_labels"))


@query(
    "top_gpu_namespaces",
    f"with g as ({_GPU_NS}) select * from g where gpus > 0 order by gpus desc, namespace limit 2",
)
def _top_gpu(t: Fleet) -> DataFrame:
    return A.top_gpu_namespaces(_with_pod_labels(t), F.col("pod_opt_labels"))


@query(
    "idle_gpu_count",
    "select count(*) as idle_with_gpu from ws_options where state <> 'Running' and gpu_label is not null",
)
def _idle_gpu(t: Fleet) -> DataFrame:
    return A.idle_gpu_count(_with_pod_labels(t), F.col("pod_opt_labels"))


@query("facets", "select distinct key, value from option_labels")
def _facets(t: Fleet) -> DataFrame:
    return A.facets(t.options)


_AVAILABLE = """select l.key, l.value, bool_or(coalesce(not coalesce(o.hidden, false) and o.redirect_to is null, false))
      as available from option_labels l join options o on o.kind = l.kind and o.option_type = l.option_type
      and o.id = l.id group by 1, 2"""


@query("facet_availability", _AVAILABLE)
def _facet_availability(t: Fleet) -> DataFrame:
    shown = ~F.coalesce("hidden", F.lit(False)) & F.col("redirect").isNull()
    return A.facet_availability(t.options, shown)


@query(
    "selectable_facets",
    f"""with a as ({_AVAILABLE}) select key, value from a where available and key = 'size'""",
)
def _selectable_facets(t: Fleet) -> DataFrame:
    shown = ~F.coalesce("hidden", F.lit(False)) & F.col("redirect").isNull()
    selected = A.facets(t.options).filter(F.col("key") == "size")
    return A.selectable_facets(selected, A.facet_availability(t.options, shown))


@query(
    "last_warning",
    "select namespace, uid, n as warnings, event_id, message, last_ms from last_warnings",
)
def _last_warning(t: Fleet) -> DataFrame:
    newest = A.last_warning(t.object_events)
    return newest.withColumn("last_ms", F.unix_millis("last_ts")).drop("last_ts", "reason")


@query(
    "multi_owned",
    """select namespace, owner, role, name, owned from (select *, count(*) over (partition by namespace, owner, role)
      as owned from sided where side = 'observed') where owned > 1""",
)
def _multi_owned(t: Fleet) -> DataFrame:
    return A.multi_owned(t.owned_objects.filter("side = 'observed'"))


@query(
    "pvc_by_class",
    """select p.namespace, p.name, coalesce(nullif(p.storage_class, ''), 'default') as "group",
      coalesce(s.display_name, coalesce(nullif(p.storage_class, ''), 'default')) as group_display_name,
      coalesce(p.can_mount_label <> 'true', true) as disabled
    from pvcs p left join storage_classes s on s.name = nullif(p.storage_class, '')""",
)
def _pvc_by_class(t: Fleet) -> DataFrame:
    return A.pvc_by_class(t.pvcs, t.storage_classes)


@query(
    "resource_keys",
    """select namespace, name as pod, 'main' as container, unnest(case when cpu_request is null and memory_limit is null
      then ['memory', 'cpu'] else ['cpu', 'memory'] end) as resource from pods""",
)
def _resource_keys(t: Fleet) -> DataFrame:
    return A.resource_keys(pod_containers(t.pods))
