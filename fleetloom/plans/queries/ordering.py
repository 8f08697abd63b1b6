"""Sort, paging and stable order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import ordering as O
from fleetloom.operators.joins import with_current_option
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query


@query(
    "sort_workspaces",
    """select namespace, name, kind, last_activity_ms, state from workspaces
    order by last_activity_ms desc, namespace, name""",
)
def _sort_workspaces(t: Fleet) -> DataFrame:
    rows = t.workspaces.select("namespace", "name", "kind", "last_activity_ms", "state")
    return O.sort_workspaces(rows)


@query(
    "sort_workspaces_by_gpu_text",
    "select namespace, name, coalesce(gpu_label, '') as gpu from ws_options order by gpu desc, namespace, name",
)
def _sort_by_gpu(t: Fleet) -> DataFrame:
    from fleetloom.functions.labels import first_label

    joined = with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"),
        t.options.select("kind", "option_type", "id", "labels"),
    )
    gpu = F.coalesce(first_label(F.col("pod_opt_labels"), "gpu"), F.lit(""))
    return O.sort_workspaces(joined.select("namespace", "name", gpu.alias("gpu")), "gpu")


@query(
    "page",
    """select namespace, name, last_activity_ms from workspaces order by last_activity_ms desc, namespace, name
    limit 10 offset 20""",
)
def _page(t: Fleet) -> DataFrame:
    rows = t.workspaces.select("namespace", "name", "last_activity_ms")
    return O.page(rows, O.row_order(rows), 3)


@query(
    "page_clamped",
    """with c as (select greatest(1, cast(ceil(count(*) / 40.0) as bigint)) as pages from workspaces),
    r as (select namespace, name, row_number() over (order by last_activity_ms desc, namespace, name) as n
      from workspaces)
    select namespace, name from r, c where n > (pages - 1) * 40""",
)
def _page_clamped(t: Fleet) -> DataFrame:
    rows = t.workspaces.select("namespace", "name", "last_activity_ms")
    return O.page(rows, O.row_order(rows), 10**6, 40).select("namespace", "name")


@query("sort_kinds", "select name, display_name, coalesce(hidden, false) as hidden from kinds order by hidden, name")
def _sort_kinds(t: Fleet) -> DataFrame:
    rows = t.kinds.select("name", "display_name", F.coalesce("hidden", F.lit(False)).alias("hidden"))
    return O.sort_kinds(rows, "hidden")


_STABLE = """with prev as (select name as id, generation * 1000000000 + cast(substr(name, 4) as bigint) as prev_rank
      from workspaces where state <> 'Pending'),
    cur as (select name as id, last_activity_ms as sort_key from workspaces where state <> 'Error')
    select c.id, c.sort_key, p.id is null as is_new, p.prev_rank from cur c left join prev p on p.id = c.id"""


@query("stable_order", _STABLE)
def _stable_order(t: Fleet) -> DataFrame:
    rank = F.col("generation") * 1000000000 + F.substr("name", F.lit(4)).cast("bigint")
    previous = t.workspaces.filter("state <> 'Pending'").select(F.col("name").alias("id"), rank.alias("prev_rank"))
    current = t.workspaces.filter("state <> 'Error'").select(
        F.col("name").alias("id"), F.col("last_activity_ms").alias("sort_key")
    )
    return O.stable_order(previous, current, "sort_key").orderBy("order_key").drop("order_key")
