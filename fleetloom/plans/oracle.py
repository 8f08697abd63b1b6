"""Check SQL: the fleet views as common table expressions over the given tables."""

from __future__ import annotations

import re

from fleetloom.plans.bindings import VIEWS

_BASE_MS = 1704067200000


def _duck(expression: str) -> str:
    expression = re.sub(r"MS\((\w+)\)", r"(epoch_us(\1) // 1000)", expression)
    while "STR(" in expression:
        start = expression.index("STR(")
        depth, end = 1, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(expression[end], 0)
            end += 1
        inner = expression[start + 4 : end - 1]
        expression = f"{expression[:start]}cast({inner} as varchar){expression[end:]}"
    return expression


def _projection(table: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{_duck(e)} as {c}" for c, e in columns.items()) + f" from {table}"


CTES: dict[str, str] = {name: _projection(table, columns) for name, (table, columns) in VIEWS.items()}

CTES["set_rows"] = CTES.pop("sets")
CTES["sets"] = """
select * from set_rows
union all select * replace (name || '-b' as name, uid || '-b' as uid) from set_rows where extra_set"""
CTES["ns_labels"] = (
    "select n.name, n.tier, r.r_name as region from namespaces n left join region r on r.r_regionkey = n.region_key"
)
CTES["pod_rows"] = (
    "select distinct 'Brand#' || cast(p_partkey % 25 + 1 as varchar) as kind, cast(p_size % 8 as bigint) as k from part"
)
CTES["pods_opt"] = """
select kind, k as pos, 'pod-' || k as id, 'Pod ' || k as display_name,
  case when k < 6 then 'Size class ' || k end as description, k = 4 as hidden,
  case k when 0 then 'pod-1' when 1 then 'pod-2' when 3 then 'pod-4' when 4 then 'pod-3' when 7 then 'pod-9' end
    as redirect_to,
  'Info' as redirect_level, case when k < 4 then
    'use ' || case k when 0 then '1' when 1 then '2' when 3 then '4' end end as redirect_text,
  cast(k + 1 as varchar) as cpu_label, cast((k + 1) * 2 as varchar) || 'Gi' as memory_label,
  case k when 5 then '0' when 6 then '2' when 7 then 'tesla' end as gpu_label,
  case when k = 2 then 'gang' end as scheduler, k
from pod_rows"""
CTES["kinds"] = """
select 'Brand#' || cast(n as varchar) as name, 'Kind ' || cast(n as varchar) as display_name,
  case when n <= 20 then 'Workbench ' || cast(n as varchar) end as description,
  case when n <> 4 then n in (3, 17) end as hidden, case when n <> 4 then n in (5, 11) end as deprecated,
  'img-' || cast(first_part as varchar) as default_image,
  case when n = 7 then 'pod-none' else 'pod-' || cast(first_pod as varchar) end as default_pod,
  case when n = 2 then '/mnt/1' else '/home/user' end as home_path,
  n not in (9, 20) as has_probe, 300 as min_interval_s, case when n <> 8 then 3600 + n * 60 end as interval_s,
  case when n % 5 = 0 then 'kind-scheduler' end as scheduler,
  case when n % 3 = 0 then 'https://img.example.org/' || cast(n as varchar) end as icon_url,
  'cfg-src' || cast(n % 20 as varchar) as icon_name, 'doc-' || cast(n as varchar) as icon_key,
  case when n % 4 = 0 then 'cfg-none' else 'cfg-src' || cast(n % 20 as varchar) end as logo_name,
  case when n % 2 = 0 then 'doc-' || cast(n % 20 as varchar) else 'doc-none' end as logo_key,
  'team-' || cast(n % 4 as varchar) as team, n
from (select p_partkey % 25 + 1 as n, min(p_partkey) as first_part, min(p_size % 8) as first_pod from part group by 1)"""
CTES["kind_ports"] = """
select name as kind, 'web' as id, 'HTTP' as protocol, 'Web' as default_display_name from kinds
union all select name, 'api', 'HTTP', 'API' from kinds
union all select name, 'debug', case when n = 6 then 'TCP' else 'HTTP' end, 'Debugger' from kinds where n <= 20"""
CTES["image_ports"] = """
select kind, id as option_id, 0 as port_pos, 'web' as port_id, 8000 + size_num as port,
  case when size_num < 20 then 'Web UI' end as display_name from image_rows
union all select kind, id, 1, 'api', case when size_num % 9 = 0 then 8000 + size_num else 9000 + size_num end, null
  from image_rows
union all select kind, id, 2, 'debug', 7000 + size_num, 'Debug' from image_rows"""
CTES["options"] = """
select kind, 'image' as option_type, pos, id, display_name, description, hidden, redirect_to,
  case when redirect_to is not null then redirect_level end as redirect_level,
  case when redirect_to is not null then redirect_text end as redirect_text from image_rows
union all
select kind, 'pod', pos, id, display_name, description, hidden, redirect_to,
  case when redirect_to is not null then redirect_level end,
  case when redirect_to is not null then redirect_text end from pods_opt"""
CTES["option_labels"] = """
select kind, 'image' as option_type, id, 0 as label_pos, 'type' as key, type_label as value from image_rows
union all select kind, 'image', id, 1, 'size', size_label from image_rows
union all select kind, 'image', id, 2, 'pythonVersion', '3.' || cast(size_num % 5 as varchar) from image_rows
union all select kind, 'image', id, 3, 'type', case when size_num % 10 = 0 then 'CUSTOM' else type_label end
  from image_rows
union all select kind, 'pod', id, 0, 'cpu', cpu_label from pods_opt
union all select kind, 'pod', id, 1, 'memory', memory_label from pods_opt
union all select kind, 'pod', id, 2, 'gpu', gpu_label from pods_opt where gpu_label is not null"""
# labels as the rule engine sees them: the last duplicate wins
CTES["image_ctx"] = """
select kind, id, case when size_num % 10 = 0 then 'CUSTOM' else type_label end as type, size_label as size,
  hidden, size_num, pos from image_rows"""
CTES["ws_options"] = """
select w.*, i.id is not null as image_known, p.id is not null as pod_known, i.type as image_type,
  i.size as image_size, p.gpu_label, p.cpu_label, p.memory_label, p.k as pod_k, k.name is not null as kind_known
from workspaces w left join kinds k on k.name = w.kind
left join image_ctx i on i.kind = w.kind and i.id = w.image_id
left join pods_opt p on p.kind = w.kind and p.id = w.pod_id"""
CTES["new_images"] = """
select * replace (case when size_num % 11 <> 0 then redirect_to end as redirect_to), size_num % 7 = 0 as edited
  from image_rows where size_num > 3 or type_label <> 'STANDARD'
union all select * replace (id || '-new' as id), false as edited from image_rows where size_num > 44"""
CTES["assets"] = """
select 'assets' as namespace, 'cfg-' || source as name, 'doc-' || cast(doc_id as varchar) as key,
  sha256(text) as sha, false as is_binary, source in ('src0', 'src1', 'src2', 'src3') as labelled from documents
union all
select 'assets', 'cfg-src' || cast(page_id % 20 as varchar), 'doc-' || cast(page_id as varchar), sha256(html), true,
  page_id % 20 in (0, 1, 2, 3) from pages"""
CTES["asset_hash"] = """
select namespace, name, key, coalesce(max(sha) filter (where is_binary), max(sha) filter (where not is_binary)) as sha
from assets group by all"""
CTES["doc_lines"] = """
select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p
from documents"""
CTES["log_lines"] = f"""
select 'NATION_' || cast(doc_id % 26 as varchar) as namespace, 'ws-' || cast(doc_id as varchar) as workspace,
  'main' as container, {_BASE_MS} + p * 1000 as ts_ms, p * 2 as seq, line from doc_lines
union all
select 'NATION_' || cast(conv_id % 26 as varchar), 'ws-' || cast(conv_id as varchar),
  case when role = 'user' then 'main' else 'proxy' end, {_BASE_MS} + turn * 60000, turn * 2 + 1, text
from conversations"""
CTES["sided"] = """
select 'desired' as side, * from owned_objects where flag <> 'R'
union all select 'observed', * from owned_objects where flag <> 'N'"""
CTES["reqs"] = """
select *, sha256(known_uid || ':' || name || ':' || cast(known_generation as varchar)) as revision from requests"""
CTES["levels"] = """
select 'NATION_' || cast(user_id % 26 as varchar) as namespace, 'ws-' || cast(user_id as varchar) as workspace,
  epoch_us(ts) // 3600000000 as snapshot_id,
  case when max(value) > 60 then 'critical' when max(value) > 20 then 'warning' else 'none' end as level
from events group by 1, 2, 3"""
CTES["pod_claims"] = """
select distinct namespace, name as pod, uid as pod_uid, phase, claim from (
  select namespace, name, uid, phase, claim_a as claim from pods
  union all select namespace, name, uid, phase, claim_b from pods)"""
CTES["claim_workspaces"] = """
select distinct m.namespace, m.target as claim, m.workspace from mounts m
join workspaces w on w.namespace = m.namespace and w.name = m.workspace where m.source <> 'secret'"""
CTES["last_warnings"] = """
select namespace, involved_uid as uid, count(*) as n, max(last_ms) as last_ms,
  arg_min(message, (-last_ms, event_id)) as message, arg_min(event_id, (-last_ms, event_id)) as event_id
from object_events where type = 'Warning' and involved_uid <> '' group by 1, 2"""


def check_sql(body: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    order: list[str] = []

    def visit(text: str, current: str | None) -> None:
        for name in CTES:
            if name != current and name not in order and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTES[name], name)
                order.append(name)

    visit(body, None)
    if not order:
        return body.strip()
    views = ", ".join(f"{name} as ({CTES[name].strip()})" for name in order)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[len('with recursive ') :]}"
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
