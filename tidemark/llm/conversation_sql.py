"""DuckDB SQL of the queries on conversations: the prefix trie and the structure repair."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), {bits}), 4294967295)"


TRIE = f"""
with s as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as pos from s),
i as (select conv_id, conv_id - conv_id % 5 as base, {_crc32("conv_id::varchar")} % 9 as h from (select distinct conv_id from s)),
r as (select i.conv_id, 0 as part, pos, role, text from i join c on c.conv_id = base and pos <= h union all select conv_id, 1, pos, role, text from c join i using (conv_id) where pos > h),
w as (select *, row_number() over (partition by conv_id order by part, pos) as depth from r),
p as (select conv_id, depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (partition by conv_id order by depth)) as prefix from w union all select conv_id, 0, '', '' from i),
n as (select depth, prefix, min(conv_id) as node, count(*) as n_convs, max(strlen(text)) as bytes from p group by depth, prefix),
l as (select p.conv_id, p.depth, node from p join n using (depth, prefix)),
k as (select n.node, n.depth, n_convs, (n_convs - 1) * bytes as saved, l.node as parent from n left join l on l.conv_id = n.node and l.depth = n.depth - 1),
h as (select parent as node, depth - 1 as depth, count(*) as n_children from k where parent is not null group by all),
o as (select k.*, coalesce(n_children, 0) as n_children from k left join h using (node, depth)),
t as (select l.node, l.depth, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from o join l on l.conv_id = o.node and l.depth <= o.depth group by all),
e as (select node, depth, string_agg(conv_id::varchar, ',' order by conv_id) as ids from l join (select conv_id, max(depth) as depth from l group by conv_id) using (conv_id, depth) group by all)
select node as conv_id, depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256 from o join t using (node, depth) left join e using (node, depth)"""


def _repair() -> str:
    edit = lambda state, cost, letter, line: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}}"
    deleted = lambda s: edit(s, 2, "D", "''")
    kept = lambda s, c: f"case when initial = '{c}' and not gone then {edit(s, 'more', 'K', 'line')} end"
    rerole = lambda s, name: f"case when not gone then {edit(s, '1 + more', 'R', f"chr(10) || '{name}:' || text")} end"
    inserted = lambda s, name: edit(s, 5, "I", f"chr(10) || '{name}:'")
    to_user = ", ".join(f"{kept(s, 'u')}, {rerole(s, 'user')}" for s in ("e", "s", "a"))
    far, none = "{'c': 1000000, 'a': '', 'o': ''}", "{'c': 0, 'a': '', 'o': ''}"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive n as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as draw from conversations where conv_id is not null),
d as (select conv_id, turn, case draw when 4 then 'user' else role end as role, case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, sha256(length(role) || ':' || role || text) as place,
 unnest(case draw when 3 then [0, 1] else [0] end) as copy from n where draw <> 0),
q as (select *, row_number() over (partition by conv_id order by turn nulls first, place, copy) - 1 as i, rtrim(text, {white}) as body from d),
f as (select *, role[1:1] as initial, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when body[-1:] not in ('.', '!', '?') then 'truncated' end as fault,
 coalesce(lag(role) over (partition by conv_id order by i)[1:1] || role[1:1] not in ('su', 'ua', 'au'), false) and i > 0 as bad from q),
g as (select *, coalesce(fault in ('blank', 'duplicate'), false) as gone, case when fault = 'truncated' then 5 else 0 end as more, chr(10) || role || ':' || text as line from f),
dp as (select conv_id, 0::bigint as i, {none} as e, {far} as s, {{'c': 5, 'a': 'I', 'o': chr(10) || 'user:'}} as u, {{'c': 10, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} as a from (select distinct conv_id from n)
 union all select conv_id, i + 1, e, s, u, list_min([a, {inserted("u", "assistant")}]) as a from (
  select conv_id, i, e, s, list_min([u, {inserted("e", "user")}, {inserted("s", "user")}, {inserted("a", "user")}]) as u, a from (
   select dp.conv_id, i, {deleted("e")} as e, list_min([{deleted("s")}, {kept("e", "s")}]) as s, list_min([{deleted("u")}, {to_user}]) as u, list_min([{deleted("a")}, {kept("u", "a")}, {rerole("u", "assistant")}]) as a from dp join g using (conv_id, i)))),
z as (select conv_id, list_min([arg_max(e, i), arg_max(a, i)]) as best from dp group by conv_id),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (bad) as illegal from g group by conv_id)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c::bigint as cost, best.a as audit, sha256(best.o[2:]) as repaired_sha256
 from z left join c using (conv_id)"""


REPAIR = _repair()
