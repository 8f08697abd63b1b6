"""Desired against observed, old against new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import diffs as D
from fleetloom.operators.aggregates import option_usage
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

_SIDES = """d as (select namespace, owner, role, min(name) as name, arg_min(subject, name) as subject,
      arg_min(mode, name) as mode, arg_min(tier, name) as tier from sided where side = 'desired' group by 1, 2, 3),
    o as (select namespace, owner, role, min(name) as name, arg_min(subject, name) as subject,
      arg_min(mode, name) as mode, arg_min(tier, name) as tier from sided where side = 'observed' group by 1, 2, 3),
    pairs as (select d.*, o.name as o_name, o.subject as o_subject, o.mode as o_mode, o.tier as o_tier
      from d join o using (namespace, owner, role))"""

# labels carry mode on both sides and tier on the desired side only (an empty tier equals none);
# annotations carry the side where the tier is gold
_LABELS_DIFFER = "(mode <> o_mode or tier <> '')"
_NOTES_DIFFER = "((tier = 'gold') or (o_tier = 'gold'))"


def _sides(t: Fleet) -> tuple[DataFrame, DataFrame]:
    columns = [*D.OBJECT_KEY, "name", "subjects", "labels", "annotations", "owned_keys"]
    objects = t.owned_objects
    return (
        objects.filter("side = 'desired'").select(*columns),
        objects.filter("side = 'observed'").select(*columns),
    )


def _firsts(t: Fleet) -> tuple[DataFrame, DataFrame]:
    desired, observed = _sides(t)
    return D.first_by_name(desired, D.OBJECT_KEY), D.first_by_name(observed, D.OBJECT_KEY)


@query(
    "reconcile_plan",
    f"""with {_SIDES}
    select namespace, owner, role, o_name as name, case when {_LABELS_DIFFER} or {_NOTES_DIFFER} or subject <> o_subject
      then 'update' else 'keep' end as action from pairs
    union all select namespace, owner, role, name, 'create' from d where not exists (select 1 from o
      where o.namespace = d.namespace and o.owner = d.owner and o.role = d.role)
    union all select namespace, owner, role, name, 'delete' from o where not exists (select 1 from d
      where o.namespace = d.namespace and o.owner = d.owner and o.role = d.role)
    union all select s.namespace, s.owner, s.role, s.name, 'delete' from sided s join o
      using (namespace, owner, role) where s.side = 'observed' and s.name <> o.name""",
)
def _reconcile_plan(t: Fleet) -> DataFrame:
    desired, observed = _sides(t)
    return D.reconcile_plan(desired, observed, ["labels", "annotations"], ["subjects"])


@query(
    "map_drift_replace",
    f"""with {_SIDES}
    select namespace, owner, role, 'mode' as key, mode as desired, o_mode as observed from pairs where mode <> o_mode
    union all select namespace, owner, role, 'tier', tier, null from pairs where tier <> ''""",
)
def _map_drift_replace(t: Fleet) -> DataFrame:
    return D.map_drift_replace(*_firsts(t), "labels")


@query(
    "map_drift_merge",
    f"""with {_SIDES}
    select namespace, owner, role, 'side' as key, case when tier <> 'gold' then 'remove' when o_tier = 'gold'
      then 'change' else 'add' end as action from pairs where tier = 'gold' or o_tier = 'gold'""",
)
def _map_drift_merge(t: Fleet) -> DataFrame:
    return D.map_drift_merge(*_firsts(t), "annotations")


@query(
    "map_drift_merge_unowned",
    f"""with {_SIDES}
    select namespace, owner, role, 'mode' as key, case when mode = o_mode then 'keep' else 'change' end as action from pairs
    union all select namespace, owner, role, 'tier', case when tier = '' then 'keep' else 'add' end from pairs""",
)
def _map_drift_merge_unowned(t: Fleet) -> DataFrame:
    return D.map_drift_merge(*_firsts(t), "labels")


@query(
    "field_drift",
    f"""with {_SIDES}
    select namespace, owner, role, 'labels' as field from pairs where {_LABELS_DIFFER}
    union all select namespace, owner, role, 'annotations' from pairs where {_NOTES_DIFFER}
    union all select namespace, owner, role, 'subjects' from pairs where subject <> o_subject""",
)
def _field_drift(t: Fleet) -> DataFrame:
    return D.field_drift(*_firsts(t), ["labels", "annotations"], ["subjects"])


@query(
    "readopt",
    """select s.namespace, s.owner, s.name, s.owner_kind, case when s.owner_api like 'fleet.example.org/%'
      and s.owner_kind = 'Workspace' then 'adopt' else 'error' end as action from sided s
    join workspaces w on w.namespace = s.namespace and w.name = s.owner
    where s.side = 'observed' and not (s.owner_uid = w.uid and s.owner_api = 'fleet.example.org/v1beta1')""",
)
def _readopt(t: Fleet) -> DataFrame:
    observed = t.owned_objects.filter("side = 'observed'")
    return D.readopt(observed, t.workspaces, "fleet.example.org/v1beta1")


_CHANGES = """changes as (select coalesce(n.kind, o.kind) as kind, 'image' as option_type, coalesce(n.id, o.id) as id,
      case when o.id is null then 'added' when n.id is null then 'removed' when n.edited then 'changed' else 'kept' end
        as status,
      o.id is null or n.id is null or n.redirect_to is distinct from o.redirect_to as recheck_redirects
    from image_rows o full join new_images n on n.kind = o.kind and n.id = o.id
    union all select kind, 'pod', id, 'kept', false from pods_opt)"""


@query(
    "option_changes",
    f"""with {_CHANGES} select kind, option_type, id, status, status in ('added', 'changed') as recheck_value,
      recheck_redirects from changes""",
)
def _option_changes(t: Fleet) -> DataFrame:
    return D.option_changes(t.options, t.new_options)


@query(
    "redirect_rechecks",
    f"with {_CHANGES} select distinct kind, option_type from changes where recheck_redirects",
)
def _redirect_rechecks(t: Fleet) -> DataFrame:
    return D.redirect_rechecks(D.option_changes(t.options, t.new_options))


@query(
    "option_change_audit",
    f"""with {_CHANGES}, used as (select kind, image_id as id, count(*) as workspaces from workspaces group by 1, 2)
    select c.kind, c.option_type, c.id, c.status, u.workspaces,
      'imageConfig value "' || c.id || '" is in use and cannot be ' || c.status as message
    from changes c join used u on u.kind = c.kind and u.id = c.id where c.status in ('changed', 'removed')""",
)
def _option_change_audit(t: Fleet) -> DataFrame:
    return D.option_change_audit(t.options, t.new_options, option_usage(t.workspaces, t.options))


@query(
    "membership_diff",
    """with a as (select distinct 'ws-' || cast(l_orderkey as varchar) as owner, 'v-' || cast(l_suppkey as varchar) as name
      from lineitem where l_linestatus = 'F' or l_discount > 0.055),
    b as (select distinct 'ws-' || cast(l_orderkey as varchar) as owner, 'v-' || cast(l_suppkey as varchar) as name
      from lineitem where l_linestatus = 'O' or l_tax > 0.045)
    select coalesce(a.owner, b.owner) as owner, coalesce(a.name, b.name) as name, case when b.owner is null then 'removed'
      when a.owner is null then 'added' else 'kept' end as status
    from a full join b on a.owner = b.owner and a.name = b.name""",
)
def _membership_diff(t: Fleet) -> DataFrame:
    rows = t.given("lineitem").select(
        F.concat(F.lit("ws-"), F.col("l_orderkey").cast("string")).alias("owner"),
        F.concat(F.lit("v-"), F.col("l_suppkey").cast("string")).alias("name"),
        "l_linestatus",
        "l_discount",
        "l_tax",
    )
    before = rows.filter((F.col("l_linestatus") == "F") | (F.col("l_discount") > 0.055))
    after = rows.filter((F.col("l_linestatus") == "O") | (F.col("l_tax") > 0.045))
    return D.membership_diff(before, after)
