"""Redirect graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.columns import pending_update
from fleetloom.operators import redirects as G
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

# walk: every option and every step of its chain; a step is taken unless its target was seen before
_WALK = """with recursive walk(kind, option_type, start, cur, next_id, pos, seen) as (
    select kind, option_type, id, id, redirect_to, 0, [id] from options
    union all
    select w.kind, w.option_type, w.start, o.id, o.redirect_to, w.pos + 1, list_append(w.seen, o.id)
    from walk w join options o on o.kind = w.kind and o.option_type = w.option_type and o.id = w.next_id
    where not list_contains(w.seen, w.next_id)),
  last as (select kind, option_type, start, arg_max(cur, pos) as cur, arg_max({'n': next_id}, pos).n as next_id, max(pos) as hops,
      arg_max(seen, pos) as seen from walk group by 1, 2, 3),
  outcome as (select *, next_id is not null and list_contains(seen, next_id) as circular,
      next_id is not null and not list_contains(seen, next_id) as missing from last)"""

_RESOLVED = f"""{_WALK}, resolved as (select kind, option_type, start as id,
    case when not circular and not missing then cur end as desired,
    cast(case when not circular and not missing then hops end as bigint) as steps,
    case when circular then option_type || 'Config with id "' || cur || '" has a circular redirect'
      when missing then option_type || 'Config with id "' || next_id || '" not found, was redirected from "' || cur || '"'
      end as error from outcome)"""


@query("resolve_redirects", f"{_RESOLVED} select * from resolved")
def _resolve(t: Fleet) -> DataFrame:
    closure = G.close(t.options)
    return G.resolve_redirects(t.options.select(*G.NODE), t.options, closure)


@query(
    "redirect_steps",
    f"""{_WALK} select w.kind, w.option_type, w.start, cast(w.pos as bigint) as pos, w.cur as source, w.next_id as target
    from walk w join outcome o on o.kind = w.kind and o.option_type = w.option_type and o.start = w.start
    where not o.circular and not o.missing and w.pos < o.hops""",
)
def _steps(t: Fleet) -> DataFrame:
    return G.redirect_steps(t.options, G.close(t.options))


@query(
    "redirect_preview",
    f"""{_WALK} select w.kind, w.option_type, w.start, cast(w.pos as bigint) as pos, w.cur as source, s.display_name as
      source_display, w.next_id as target, coalesce(d.display_name, w.next_id || ' (not found)') as target_display,
      case when s.redirect_text is not null then case when s.redirect_level in ('Info', 'Warning', 'Danger')
        then s.redirect_level else 'Info' end end as message_level, s.redirect_text as message_text
    from walk w join outcome o on o.kind = w.kind and o.option_type = w.option_type and o.start = w.start
    join options s on s.kind = w.kind and s.option_type = w.option_type and s.id = w.cur
    left join options d on d.kind = w.kind and d.option_type = w.option_type and d.id = w.next_id
    where w.pos < o.hops or o.missing and w.pos = o.hops""",
)
def _preview(t: Fleet) -> DataFrame:
    return G.redirect_preview(t.options, G.close(t.options))


@query(
    "preview_summary",
    f"""{_WALK} select kind, option_type, start as id, cast(hops + case when missing then 1 else 0 end as bigint) as steps,
      case when not circular and not missing and hops > 0 then cur end as final_target, circular as cycle_detected
    from outcome""",
)
def _summary(t: Fleet) -> DataFrame:
    return G.preview_summary(G.close(t.options))


@query(
    "redirect_cycles",
    f"""{_WALK} select kind, option_type, start as id, list_min(seen) as cycle_id, cast(len(seen) as bigint)
      as cycle_length from outcome where circular and next_id = start""",
)
def _cycles(t: Fleet) -> DataFrame:
    return G.redirect_cycles(G.close(t.options))


_WS = f"""{_RESOLVED} select w.namespace, w.name, i.desired as desired_image, p.desired as desired_pod,
    case when i.id is null then 'imageConfig with id "' || w.image_id || '" not found' else i.error end as image_error,
    case when p.id is null then 'podConfig with id "' || w.pod_id || '" not found' else p.error end as pod_error,
    coalesce(i.steps > 0, false) or coalesce(p.steps > 0, false) as pending_restart
  from workspaces w left join resolved i on i.option_type = 'image' and i.kind = w.kind and i.id = w.image_id
  left join resolved p on p.option_type = 'pod' and p.kind = w.kind and p.id = w.pod_id"""


@query("pending_restart", _WS)
def _pending_restart(t: Fleet) -> DataFrame:
    resolved = G.resolve_workspaces(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"), t.options, G.close(t.options)
    )
    return G.pending_restart(resolved).select(
        "namespace", "name", "desired_image", "desired_pod", "image_error", "pod_error", "pending_restart"
    )


@query(
    "pending_update",
    f"""{_RESOLVED} select w.namespace, w.name, coalesce(i.steps > 0, false) or coalesce(p.steps > 0, false) as pending
  from workspaces w left join resolved i on i.option_type = 'image' and i.kind = w.kind and i.id = w.image_id
  left join resolved p on p.option_type = 'pod' and p.kind = w.kind and p.id = w.pod_id""",
)
def _pending_update(t: Fleet) -> DataFrame:
    resolved = G.resolve_workspaces(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"), t.options, G.close(t.options)
    )
    return resolved.select("namespace", "name", pending_update(F.col("image_steps"), F.col("pod_steps")).alias("pending"))
