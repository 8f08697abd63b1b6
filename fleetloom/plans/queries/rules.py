"""Rule engine and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import PROBE_INTERVAL_S, SCOPE_IMAGE
from fleetloom.operators import admission as M
from fleetloom.operators import rules as R
from fleetloom.operators.aggregates import option_usage
from fleetloom.plans.bindings import NOW_MS, Fleet
from fleetloom.plans.registry import query
from fleetloom.plans.rule_sets import ACTIVITY_RULES, FILTER_RULES

# one row per workspace with the labels the rules read; null when the namespace or option is unknown
_CTX = """ctx as (select w.*, n.name is not null as ns_known, n.tier, n.region from ws_options w
    left join ns_labels n on n.name = w.namespace)"""


def _rule_cases(image_known: str, pod_known: str) -> dict[str, str]:
    """Number of the first matching rule per scope, written out by hand."""
    return {
        "image": f"""case when ns_known and tier = 'production' and image_type = 'PROMO' then 1
          when image_type not in ('ECONOMY', 'SMALL') and {pod_known} and gpu_label is not null then 2
          when image_type = 'CUSTOM' then 5 else 0 end""",
        "pod": f"""case when {image_known} and image_type = 'LARGE' and ns_known and region <> 'ASIA' then 3
          when gpu_label is not null and ns_known and tier = 'dev' then 4 else 0 end""",
        "kind": """case when ns_known and region = 'ASIA' then 7
          when ns_known and region in ('EUROPE', 'AFRICA') and kind in ('Brand#13', 'Brand#17') then 8
          when ns_known and tier = 'dev' and kind in ('Brand#2', 'Brand#12', 'Brand#22') then 9 else 0 end""",
    }


_CASES = _rule_cases("image_known", "pod_known")
_EFFECT = """rule in (1, 7) as ui_hide, rule in (2, 4, 8) as api_hide, rule in (3, 4, 5, 8, 9) as deny,
    case rule when 3 then 'large images need another pod size' when 4 then 'no GPUs in dev'
      when 8 then 'secret reason' when 9 then 'not in dev' end as deny_message"""

_FILTER = f"""with {_CTX}, hits as (
    select namespace, name, 'IMAGE_CONFIG' as scope, {_CASES["image"]} as rule from ctx where image_known
    union all select namespace, name, 'POD_CONFIG', {_CASES["pod"]} from ctx where pod_known
    union all select namespace, name, 'WORKSPACE_KIND', {_CASES["kind"]} from ctx where kind_known)
  select namespace, name, scope, {_EFFECT} from hits"""


def _targets(t: Fleet) -> DataFrame:
    targets = R.workspace_targets(t.workspaces, t.options, t.namespaces)
    return targets.join(t.kinds.select(F.col("name").alias("kind")), "kind", "left_semi")


def _effects(df: DataFrame) -> DataFrame:
    return df.select("namespace", "name", "scope", "ui_hide", "api_hide", "deny", "deny_message")


@query("evaluate_filter_rules", _FILTER)
def _filter_case(t: Fleet) -> DataFrame:
    return _effects(R.evaluate_filter_rules(_targets(t), FILTER_RULES))


@query("evaluate_filter_rules_stored", _FILTER)
def _filter_stored(t: Fleet) -> DataFrame:
    return _effects(R.evaluate_filter_rules(_targets(t), t.filter_rules))


@query("match_rules", _FILTER)
def _filter_rows(t: Fleet) -> DataFrame:
    return _effects(R.evaluate_filter_rules(_targets(t), t.filter_rules))


# a rule for each part; ``loose`` where its condition on the region is not valid
_PART_RULES = """part_rules as (select p_brand as kind, p_partkey as rule_idx, p_type, p_size % 4 as effect, p_name,
      r_name as asked, p_partkey % 7 = 0 as turned, p_partkey % 11 = 0
        or not regexp_full_match(r_name, '[A-Za-z0-9]([A-Za-z0-9_.-]*[A-Za-z0-9])?') as loose
    from part join region on r_regionkey = p_partkey % 5)"""


@query(
    "match_rules_of_parts",
    f"""with {_CTX}, {_PART_RULES}, first as (select namespace, name, min(rule_idx) as rule_idx from ctx
      join part_rules r on r.kind = ctx.kind and image_known and image_type = p_type and (loose or (ns_known and
        case when turned then region is distinct from asked else region = asked end)) group by namespace, name)
    select c.namespace, c.name, 'IMAGE_CONFIG' as scope, coalesce(effect = 2, false) as ui_hide,
      coalesce(effect = 1, false) as api_hide, coalesce(effect = 0, false) as deny,
      case when effect = 0 then p_name end as deny_message
    from ctx c left join first using (namespace, name) left join part_rules r using (rule_idx) where image_known""",
)
def _match_rules_of_parts(t: Fleet) -> DataFrame:
    images = _targets(t).filter(F.col("scope") == SCOPE_IMAGE)
    return _effects(R.evaluate_filter_rules(images, t.part_rules))


@query(
    "lint_rules_of_parts",
    f"""with {_PART_RULES} select kind, rule_idx, 'match[1]' as field, 'invalid label selector' as message
      from part_rules where loose
    union all select kind, rule_idx, 'effect', 'rule has no effect' from part_rules where effect = 3""",
)
def _lint_rules_of_parts(t: Fleet) -> DataFrame:
    return R.lint_filter_rules(t.part_rules)


@query(
    "condition_source",
    f"""with {_CTX} select namespace, name, 'IMAGE_CONFIG' as scope, image_type as image_type, gpu_label from ctx
      where image_known
    union all select namespace, name, 'POD_CONFIG', image_type, gpu_label from ctx where pod_known
    union all select namespace, name, 'WORKSPACE_KIND', image_type, gpu_label from ctx""",
)
def _condition_source(t: Fleet) -> DataFrame:
    targets = R.workspace_targets(t.workspaces, t.options, t.namespaces)
    maps = R.source_maps(targets)
    return targets.select(
        "namespace",
        "name",
        "scope",
        F.try_element_at(maps["image"], F.lit("type")).alias("image_type"),
        F.try_element_at(maps["pod"], F.lit("gpu")).alias("gpu_label"),
    )


@query(
    "usable_filter_rules",
    """select name as kind, r.i as rule_idx, r.n as conditions from kinds, (values (0, 2), (1, 2), (2, 2), (3, 2),
      (4, 1), (6, 1), (7, 1), (8, 1), (9, 1)) r(i, n)
    where not (r.i = 7 and name not in ('Brand#13', 'Brand#17'))
      and not (r.i = 8 and name not in ('Brand#2', 'Brand#12', 'Brand#22')) and not (r.i = 9 and name <> 'Brand#5')""",
)
def _usable_rules(t: Fleet) -> DataFrame:
    usable = R.usable_filter_rules(t.filter_rules)
    return usable.select("kind", "rule_idx", F.size("conditions").alias("conditions"))


@query(
    "visible_kinds",
    f"""with ctx as (select distinct w.kind, w.namespace, k.display_name, k.hidden, k.deprecated,
        n.name is not null as ns_known, n.tier, n.region from workspaces w join kinds k on k.name = w.kind
        left join ns_labels n on n.name = w.namespace
      union all select name, null, display_name, hidden, deprecated, false, null, null from kinds),
    hits as (select *, {_CASES["kind"]} as rule from ctx)
    select kind, namespace, display_name, coalesce(deprecated, false) as deprecated,
      coalesce(hidden, false) or rule = 7 as hidden, rule in (8, 9) as deny,
      case rule when 9 then 'not in dev' end as deny_message from hits where rule <> 8""",
)
def _visible_kinds(t: Fleet) -> DataFrame:
    contexts = t.workspaces.select("kind", "namespace").distinct()
    open_contexts = t.kinds.select(F.col("name").alias("kind"), F.lit(None).cast("string").alias("namespace"))
    return R.visible_kinds(t.kinds, FILTER_RULES, contexts.unionByName(open_contexts), t.namespaces)


@query(
    "kind_view",
    """select name, display_name, coalesce(description, '') as description, coalesce(hidden, false) as hidden,
      coalesce(deprecated, false) as deprecated, team, cast(n * 10 as varchar) as cost from kinds""",
)
def _kind_view(t: Fleet) -> DataFrame:
    open_contexts = t.kinds.select(F.col("name").alias("kind"), F.lit(None).cast("string").alias("namespace"))
    seen = R.visible_kinds(t.kinds, FILTER_RULES, open_contexts, t.namespaces).select(
        F.col("kind").alias("name"), "display_name", "hidden", "deprecated"
    )
    rest = t.kinds.select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.try_element_at("labels", F.lit("team")).alias("team"),
        F.try_element_at("annotations", F.lit("cost")).alias("cost"),
    )
    return seen.join(rest, "name")


_LIST = f"""with c as (
      select request_id as context_id, namespace, kind, image_id, pod_id from reqs
      union all select 'open-' || name, 'NATION_' || cast(n % 26 as varchar), name, null, null from kinds),
    ctx as (select c.*, i.type as sel_type, i.id is not null as sel_image, p.gpu_label as sel_gpu,
        p.id is not null as sel_pod, n.name is not null as ns_known, n.tier, n.region, k.name is not null as kind_known
      from c left join image_ctx i on i.kind = c.kind and i.id = c.image_id
      left join pods_opt p on p.kind = c.kind and p.id = c.pod_id
      left join ns_labels n on n.name = c.namespace left join kinds k on k.name = c.kind),
    images as (select x.context_id, x.kind, 'image' as option_type, o.id, r.display_name, o.hidden,
        x.ns_known, x.tier, x.region, o.type as image_type, x.sel_gpu as gpu_label, x.sel_pod as pod_known
      from ctx x join image_ctx o on o.kind = x.kind and (x.image_id is null or o.id = x.image_id)
      join image_rows r on r.kind = o.kind and r.id = o.id),
    pods_listed as (select x.context_id, x.kind, 'pod' as option_type, o.id, o.display_name, o.hidden,
        x.ns_known, x.tier, x.region, x.sel_type as image_type, o.gpu_label, x.sel_image as image_known
      from ctx x join pods_opt o on o.kind = x.kind and (x.pod_id is null or o.id = x.pod_id)),
    hits as (select context_id, kind, option_type, id, display_name, hidden, {_CASES["image"]} as rule from images
      union all select context_id, kind, option_type, id, display_name, hidden, {_CASES["pod"]} from pods_listed),
    usage as (select o.kind, o.option_type, o.id, count(w.name) as workspaces from options o left join (
        select kind, 'image' as option_type, image_id as id, name from workspaces
        union all select kind, 'pod', pod_id, name from workspaces) w
      on w.kind = o.kind and w.option_type = o.option_type and w.id = o.id group by 1, 2, 3),
    effects as (select h.*, {_EFFECT} from hits h),
    listed as (select e.context_id, e.kind, e.option_type, e.id, e.display_name,
      coalesce(e.hidden, false) or e.ui_hide as hidden, e.deny, e.deny_message, u.workspaces, null as error
    from effects e join usage u on u.kind = e.kind and u.option_type = e.option_type and u.id = e.id where not e.api_hide
    union all select context_id, kind, 'image', image_id, null, null, null, null, null,
      'no image option ' || image_id || ' in kind ' || kind
      from ctx where image_id is not null and not sel_image
    union all select context_id, kind, 'pod', pod_id, null, null, null, null, null,
      'no pod option ' || pod_id || ' in kind ' || kind
      from ctx where pod_id is not null and not sel_pod)"""


def _contexts(t: Fleet) -> DataFrame:
    n = F.substr("name", F.lit(7)).cast("bigint")
    open_contexts = t.kinds.select(
        F.concat(F.lit("open-"), F.col("name")).alias("context_id"),
        F.concat(F.lit("NATION_"), (n % 26).cast("string")).alias("namespace"),
        F.col("name").alias("kind"),
        F.lit(None).cast("string").alias("image_id"),
        F.lit(None).cast("string").alias("pod_id"),
    )
    asked = t.requests.select(F.col("request_id").alias("context_id"), "namespace", "kind", "image_id", "pod_id")
    return asked.unionByName(open_contexts)


@query("list_option_values", f"{_LIST} select * from listed")
def _list_option_values(t: Fleet) -> DataFrame:
    usage = option_usage(t.workspaces, t.options)
    return R.list_option_values(_contexts(t), t.options, t.namespaces, FILTER_RULES, usage)


@query(
    "contextual_default",
    f"""{_LIST}, defaults as (select 'open-' || name as context_id, name as kind, 'image' as option_type,
        default_image as default_id from kinds
      union all select 'open-' || name, name, 'pod', default_pod from kinds)
    select d.*, case when o.id is not null and l.id is not null and (coalesce(o.hidden, false) or not l.hidden)
      then d.default_id end as resolved_id from defaults d
    left join options o on o.kind = d.kind and o.option_type = d.option_type and o.id = d.default_id
    left join listed l on l.context_id = d.context_id and l.option_type = d.option_type and l.id = d.default_id
      and l.error is null""",
)
def _contextual_default(t: Fleet) -> DataFrame:
    contexts = _contexts(t)
    usage = option_usage(t.workspaces, t.options)
    offered = R.list_option_values(contexts, t.options, t.namespaces, FILTER_RULES, usage)
    pair = F.array(
        F.struct(F.lit("image").alias("option_type"), F.col("default_image").alias("default_id")),
        F.struct(F.lit("pod").alias("option_type"), F.col("default_pod").alias("default_id")),
    )
    defaults = t.kinds.select(
        F.concat(F.lit("open-"), F.col("name")).alias("context_id"), F.col("name").alias("kind"), F.explode(pair).alias("d")
    ).select("context_id", "kind", "d.*")
    return R.contextual_default(defaults, t.options, offered)


def _admit_sql(mutation: str) -> str:
    return f"""
      select request_id, 'kind' as field, 'Forbidden' as code, 'workspace {mutation} not allowed: workspace kind "' ||
        kind || '" is hidden' as message from hit where kind_rule = 8
      union all select request_id, 'kind', 'Forbidden', 'workspace {mutation} not allowed: workspace kind "' || kind ||
        '" is restricted: not in dev' from hit where kind_rule = 9
      union all select request_id, 'image', 'Forbidden', 'not allowed: image config option "' || image_id ||
        '" is hidden' from hit where kind_rule in (0, 7) and image_known and image_rule = 2 and image_checked
      union all select request_id, 'image', 'Forbidden', 'not allowed: image config option "' || image_id ||
        '" is restricted' from hit where kind_rule in (0, 7) and image_known and image_rule = 5 and image_checked
      union all select request_id, 'pod', 'Forbidden', 'not allowed: pod config option "' || pod_id || '" is hidden'
        from hit where kind_rule in (0, 7) and pod_known and pod_rule = 4 and pod_checked
      union all select request_id, 'pod', 'Forbidden', 'not allowed: pod config option "' || pod_id ||
        '" is restricted: ' || case pod_rule when 3 then 'large images need another pod size' else 'no GPUs in dev' end
        from hit where kind_rule in (0, 7) and pod_known and pod_rule in (3, 4) and pod_checked"""


def _hit_sql(source: str, checked: str) -> str:
    return f"""hit as (select *, {_CASES["kind"]} as kind_rule, {_CASES["image"]} as image_rule,
      {_CASES["pod"]} as pod_rule, {checked} from (
        select r.*, i.id is not null as image_known, i.type as image_type, p.id is not null as pod_known, p.gpu_label,
          n.name is not null as ns_known, n.tier, n.region from {source} r
        left join image_ctx i on i.kind = r.kind and i.id = r.image_id
        left join pods_opt p on p.kind = r.kind and p.id = r.pod_id
        left join ns_labels n on n.name = r.namespace) where ns_known)"""


@query(
    "admit_create",
    f"""with known as (select r.* from reqs r join kinds k on k.name = r.kind),
    {_hit_sql("known", "true as image_checked, true as pod_checked")}
    select request_id, 'kind' as field, 'Invalid' as code, 'workspace kind "' || kind || '" not found' as message
      from reqs where kind not in (select name from kinds)
    union all select request_id, 'namespace', 'Invalid', 'namespace "' || namespace || '" not found' from known
      where namespace not in (select name from ns_labels)
    union all {_admit_sql("create")}""",
)
def _admit_create(t: Fleet) -> DataFrame:
    return M.admit_create(t.requests, t.kinds, t.options, t.namespaces, FILTER_RULES)


@query(
    "admit_update",
    f"""with cur as (select r.request_id, r.namespace, r.name, r.image_id, r.pod_id, r.revision, w.kind,
        w.image_id as current_image, w.pod_id as current_pod, w.uid,
        sha256(w.uid || ':' || w.name || ':' || cast(w.generation as varchar)) as current_revision
      from reqs r left join workspaces w on w.namespace = r.namespace and w.name = r.name),
    fresh as (select c.* from cur c join kinds k on k.name = c.kind where revision = current_revision),
    {_hit_sql("fresh", "image_id <> current_image as image_checked, pod_id <> current_pod as pod_checked")}
    select request_id, 'name' as field, 'NotFound' as code, 'workspace not found' as message from cur where uid is null
    union all select request_id, 'revision', 'Conflict', 'workspace revision is stale' from cur
      where revision <> current_revision
    union all select request_id, 'kind', 'Internal', 'workspace kind "' || kind || '" not found' from cur
      where revision = current_revision and kind not in (select name from kinds)
    union all select request_id, 'namespace', 'Invalid', 'namespace "' || namespace || '" not found' from fresh
      where namespace not in (select name from ns_labels)
    union all {_admit_sql("update")}""",
)
def _admit_update(t: Fleet) -> DataFrame:
    return M.admit_update(t.requests, t.workspaces, t.kinds, t.options, t.namespaces, FILTER_RULES)


@query(
    "revision_conflicts",
    """select r.request_id, r.namespace, r.name from reqs r join workspaces w
      on w.namespace = r.namespace and w.name = r.name
    where r.revision <> sha256(w.uid || ':' || w.name || ':' || cast(w.generation as varchar))""",
)
def _revision_conflicts(t: Fleet) -> DataFrame:
    return M.revision_conflicts(t.requests, t.workspaces).select("request_id", "namespace", "name")


_OUTCOME = """select r.request_id, r.op, r.namespace, r.name, case when w.name is null then 'NotFound'
      when r.op = 'pause' and w.paused then 'InvalidState'
      when r.op = 'start' and (not w.paused or w.state <> 'Paused') then 'InvalidState' else 'Accepted' end as outcome
    from reqs r left join workspaces w on w.namespace = r.namespace and w.name = r.name
    where r.op in ('pause', 'start')"""


@query("apply_pause_requests", _OUTCOME)
def _apply_pause_requests(t: Fleet) -> DataFrame:
    return M.apply_pause_requests(t.workspaces, t.requests).drop("paused", "state")


@query(
    "paused_snapshot",
    f"""with o as ({_OUTCOME}) select w.namespace, w.name, coalesce(o.op = 'pause', w.paused) as paused
    from workspaces w left join o on o.namespace = w.namespace and o.name = w.name and o.outcome = 'Accepted'""",
)
def _paused_snapshot(t: Fleet) -> DataFrame:
    decided = M.apply_pause_requests(t.workspaces, t.requests)
    return M.paused_snapshot(t.workspaces, decided).select("namespace", "name", "paused")


# number of the first rule reached by hand: rules 0..6, 3 is an error
_ACTIVITY = """case when not kind_known then null when tier = 'production' then 0 when gpu_label is not null then 1
    when tier = 'dev' and kind in ('Brand#12', 'Brand#18') then 3
    when kind in ('Brand#4', 'Brand#6') and coalesce(memory_label, '') not in ('2Gi', '4Gi') then 4
    when cast(substr(kind, 7) as int) < 14 then 5 end"""
_DECISION = f"""decided as (select *, case when idx is null then 'none' when idx = 3 then 'error' else 'matched' end as status,
      case idx when 0 then false when 1 then true when 4 then true when 5 then true end as pause,
      cast(case idx when 0 then 0 when 1 then 1800 when 4 then 7200 when 5 then 3600 end as bigint)
        as seconds_since_active,
      cast(case when idx = 1 then 300 when idx in (0, 4, 5) then 0 end as bigint) as min_running_seconds
    from (select *, {_ACTIVITY} as idx from ctx))"""
_ACTIVITY_SQL = f"""with {_CTX}, {_DECISION} select namespace, name, status, cast(idx as bigint) as rule_idx, pause,
    seconds_since_active, min_running_seconds from decided"""


def _decision(df: DataFrame) -> DataFrame:
    return df.select(
        "namespace", "name", "status", "rule_idx", "pause", "seconds_since_active", "min_running_seconds"
    )


@query("evaluate_activity_rules_stored", _ACTIVITY_SQL)
def _activity_stored(t: Fleet) -> DataFrame:
    return _decision(R.evaluate_activity_rules(t.workspaces, t.options, t.namespaces, t.activity_rules))


@query("evaluate_activity_rules_rows", _ACTIVITY_SQL)
def _activity_rows(t: Fleet) -> DataFrame:
    rules = t.activity_rules
    return _decision(R.evaluate_activity_rules(t.workspaces, t.options, t.namespaces, rules))


@query("evaluate_activity_rules", f"{_ACTIVITY_SQL} where kind_known")
def _activity_case(t: Fleet) -> DataFrame:
    known = t.workspaces.join(t.kinds.select(F.col("name").alias("kind")), "kind", "left_semi")
    return _decision(R.evaluate_activity_rules(known, t.options, t.namespaces, ACTIVITY_RULES))


@query(
    "activity_rule_errors",
    f"with {_CTX}, {_DECISION} select kind, cast(idx as bigint) as rule_idx, count(*) as workspaces from decided where status = 'error' group by 1, 2",
)
def _activity_errors(t: Fleet) -> DataFrame:
    decided = R.evaluate_activity_rules(t.workspaces, t.options, t.namespaces, t.activity_rules)
    return (
        decided.filter("status = 'error'").groupBy("kind", "rule_idx").agg(F.count("*").alias("workspaces"))
    )


@query(
    "pause_decision",
    f"""with {_CTX}, {_DECISION},
    judged as (select d.*, coalesce(k.has_probe, false) and d.state = 'Running' and d.status = 'matched' and d.pause
      as pausing from decided d left join kinds k on k.name = d.kind),
    due as (select *, case when pausing then case when last_activity_ms > 0
      then last_activity_ms + seconds_since_active * 1000 else 0 end end as after from judged),
    elig as (select *, coalesce(pausing and last_activity_ms > 0 and {NOW_MS} >= after and (min_running_seconds = 0 or
      (last_running_ms > 0 and {NOW_MS} - last_running_ms >= min_running_seconds * 1000)), false) as eligible from due)
    select namespace, name, after as eligible_after_ms, eligible, eligible and probe_result = 'Success' as pause_now
    from elig""",
)
def _pause_decision(t: Fleet) -> DataFrame:
    decided = R.evaluate_activity_rules(t.workspaces, t.options, t.namespaces, t.activity_rules)
    probes = t.kinds.select(F.col("name").alias("kind"), F.col("probe").isNotNull().alias("has_probe"))
    joined = decided.join(probes, "kind", "left").withColumn("has_probe", F.coalesce("has_probe", F.lit(False)))
    judged = R.pause_decision(joined, NOW_MS, F.col("probe_result") == "Success")
    return judged.select("namespace", "name", "eligible_after_ms", "eligible", "pause_now")


@query(
    "lint_filter_rules",
    """select name as kind, 4 as rule_idx, 'match[0]' as field, 'invalid label selector' as message from kinds
    union all select name, 5, 'match[0]', 'invalid label selector' from kinds
    union all select name, 9, 'effect', 'rule has no effect' from kinds where name = 'Brand#5'
    union all select name, 9, 'match[0]', 'image conditions are only valid in option scopes' from kinds
      where name = 'Brand#5'""",
)
def _lint_filter_rules(t: Fleet) -> DataFrame:
    return R.lint_filter_rules(t.filter_rules)


@query(
    "lint_activity_rules",
    """with r as (select name as kind, n, has_probe, coalesce(interval_s, 3600) as interval_s from kinds)
    select kind, 6 as rule_idx, 'error' as severity, 'at most one catch-all rule is allowed' as message from r
      where n in (7, 8)
    union all select kind, 5, 'error', 'catch-all must be the last rule' from r where n in (7, 8)
    union all select r.kind, v.i, 'warning', 'seconds since active is less than twice the probe interval' from r,
      (values (1, 1800), (3, 60), (4, 7200), (5, 3600), (6, 9000)) v(i, s) where v.s < 2 * (case when not has_probe
        then 3600 else interval_s end) and not (v.i = 3 and n not in (12, 18)) and not (v.i = 4 and n not in (4, 6))
      and not (v.i = 5 and n > 13) and not (v.i = 6 and n not in (7, 8))
    union all select kind, 1, 'error', 'an activity probe is required' from r where not has_probe
    union all select kind, 3, 'error', 'invalid label selector' from r where n in (12, 18)""",
)
def _lint_activity_rules(t: Fleet) -> DataFrame:
    return R.lint_activity_rules(t.activity_rules, t.kinds, PROBE_INTERVAL_S)
