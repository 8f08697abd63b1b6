"""Check SQL of the conversation operators."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), {byte}), 4294967295)"


def _step(state: str, initial: str) -> str:
    """The state after a turn; null where the grammar has none."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    return "case " + " ".join(f"when {state} = '{a}' and {initial} = '{b}' then '{c}'" for (a, b), c in steps.items()) + " end"


_NEXT = "case when state = 'u' then 'assistant' else 'user' end"

#: All derivations row by row: every state keeps its least (cost, audit); up to three turns are inserted at each place.
REPAIR = rf"""
with recursive rows as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault from conversations
),
hurt as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
        case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case when fault = 3 then 2 else 1 end)) as copy
    from rows where fault <> 0
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from hurt),
judged as (
    select *, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') as body,
        row_number() over (partition by conv_id, role, text order by i) as again,
        lag(role) over (partition by conv_id order by i) as role_before from placed
),
turns as (
    select *, case when body = '' then 'blank' when again > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
    from judged
),
convs as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (role_before is not null and left(role_before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
    from turns group by conv_id
),
inserts as (select unnest([0, 1, 2, 3]) as k),
walk as (
    select conv_id, 0::bigint as i, '' as state, 0::bigint as cost, '' as audit, [''][1:0] as kept, true as best from convs
    union all
    select * from (
        with open as (select w.conv_id, w.i, w.state, w.cost, w.audit, w.kept from walk w where w.best),
        wide as (
            select conv_id, i, case when k = 0 then state when (k % 2 = 1) = (state = 'u') then 'a' else 'u' end as state, cost + 5 * k as cost,
                audit || repeat('I', k::bigint) as audit,
                kept || list_transform(range(k::bigint), lambda j: case when (j % 2 = 0) = (state = 'u') then 'assistant:' else 'user:' end) as kept
            from open, inserts
        ),
        edited as (
            select w.conv_id, w.i + 1 as i, e.edit, w.state as was, w.cost, w.audit, w.kept, t.role, t.text, t.fault,
                case e.edit when 'D' then w.state when 'K' then {_step("w.state", "left(t.role, 1)")}
                    else {_step("w.state", "e.edit")} end as state
            from wide w join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
            cross join (select unnest(['D', 'K', 'u', 'a']) as edit) e
            where e.edit = 'D' or t.fault in ('', 'truncated')
        ),
        priced as (
            select conv_id, i, state,
                cost + case edit when 'D' then 2 when 'K' then 0 else 1 end + case when edit <> 'D' and fault = 'truncated' then 5 else 0 end as cost,
                audit || case when edit in ('u', 'a') then 'R' else edit end as audit,
                case edit when 'D' then kept when 'K' then kept || [role || ':' || text]
                    when 'u' then kept || ['user:' || text] else kept || ['assistant:' || text] end as kept
            from edited where state is not null
        )
        select conv_id, i, state, cost, audit, kept, row_number() over (partition by conv_id, i, state order by cost, audit) = 1 as best from priced
    )
),
ends as (
    select w.conv_id, k, cost + 5 * k as cost, audit || repeat('I', k::bigint) as audit,
        kept || list_transform(range(k::bigint), lambda j: case when (j % 2 = 0) = (state = 'u') then 'assistant:' else 'user:' end) as kept,
        case when k = 0 then state when (k % 2 = 1) = (state = 'u') then 'a' else 'u' end as state
    from walk w join convs c on c.conv_id is not distinct from w.conv_id and c.n = w.i cross join inserts where w.best
),
chosen as (select *, row_number() over (partition by conv_id order by cost, audit) as place from ends where state in ('', 'a'))
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
    coalesce(audit, '') as audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join convs c on c.conv_id is not distinct from o.conv_id
left join chosen e on e.conv_id is not distinct from o.conv_id and e.place = 1
"""

#: Every prefix of every rebuilt conversation, and every pair of a prefix with one that goes on from it.
TRIE = rf"""
with recursive rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role)::varchar || ':' || role || text)) - 1 as pos from rows),
ids as (select conv_id, {_crc32("conv_id::varchar")} % 4 as h from (select distinct conv_id from rows)),
rebuilt as (
    select i.conv_id, pos - 10 as pos, role, text from ids i join placed p on p.conv_id = i.conv_id - i.conv_id % 20 and pos < h
    union all select i.conv_id, pos, role, text from ids i join placed p on p.conv_id = i.conv_id and pos >= h
),
turns as (
    select conv_id, row_number() over (partition by conv_id order by pos) as depth, md5(length(role)::varchar || ':' || role || text) as digest,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rebuilt
),
walk as (
    select conv_id, 0::bigint as depth, '' as path, '' as parent, 0::bigint as words from ids
    union all select t.conv_id, t.depth, md5(w.path || t.digest), w.path, t.words from walk w join turns t on t.conv_id = w.conv_id and t.depth = w.depth + 1
),
lengths as (select conv_id, max(depth) as length from walk group by conv_id),
nodes as (
    select depth, path, max(parent) as parent, max(words) as words, min(w.conv_id) as conv_id, count(*) as n,
        sha256(coalesce(string_agg(w.conv_id::varchar, ',' order by w.conv_id) filter (l.length = depth), '')) as ends_sha256
    from walk w join lengths l on l.conv_id = w.conv_id group by depth, path
),
children as (select depth - 1 as depth, parent as path, count(*) as n_children from nodes where depth > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on c.depth = n.depth and c.path = n.path),
below as (select distinct a.depth, a.path, b.depth as to_depth, b.path as to_path from walk a join walk b on b.conv_id = a.conv_id and b.depth >= a.depth),
sums as (
    select b.depth, b.path, sum((n.n - 1) * n.words) as saved_tokens, count(*) filter (n.n_children = 0) as n_leaves
    from below b join full_nodes n on n.depth = b.to_depth and n.path = b.to_path group by 1, 2
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n::bigint as n_convs, n.n_children::bigint as n_children, n_leaves::bigint as n_leaves,
    saved_tokens::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums s on s.depth = n.depth and s.path = n.path left join nodes p on p.depth = n.depth - 1 and p.path = n.parent
"""
