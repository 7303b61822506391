"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quern.llm import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
with recursive w as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), s as (
    select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else ['!' || t] end) as g from w
), n as (
    select doc_id, count(*) as n from s group by doc_id
), p as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), e as (
    select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where k >= 0.8 * (x.n + y.n - k) - 1e-9
), r as (
    select doc_id as node, doc_id as root from w union select e.b, r.root from r join e on e.a = r.node
)
select w.doc_id, (select min(root) from r where node = w.doc_id) as class_id, (select count(*) from e where a = w.doc_id) as n_links from w
"""


def _rule(rank: int, rule: secrets.Rule) -> str:
    p = (rule.plain or rule.pattern).replace("'", "''")  # a private key without END may have more lines in the query than here
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, {rule.least} as least, regexp_extract_all(t, '{p}', 0) as f, regexp_extract_all(t, '{p}', {rule.group}) as g, regexp_split_to_array(t, '{p}') as b from d"""


def secret_spans() -> str:
    found = " union all ".join(_rule(i, r) for i, r in enumerate(secrets.RULES))
    kinds = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), m as ({found}),
i as (select *, unnest(range(1, len(f) + 1)) as i from m),
s as (select doc_id, rank, kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as a, length(f[i]) as n
    from i where length(g[i]) >= least),
j as (select doc_id, {kinds}, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank) filter (rank < {len(secrets.BASE_RULES)}) as base,
    string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank) as spans from s group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (doc_id)
"""


def _role(x: str) -> str:
    return f"replace(replace({x}.role, '<|', '< |'), chr(10), ' ')"


def _show(x: str) -> str:
    return f"('<|im_start|>' || {_role(x)} || chr(10) || replace({x}.text, '<|', '< |') || '<|im_end|>' || chr(10))"


def _render(ts: str) -> str:
    return f"coalesce(array_to_string(list_transform({ts}, lambda x: {_show('x')}), ''), '')"


def _mask(ts: str) -> str:
    before = f"coalesce(list_sum(list_transform({ts}[1:i - 1], lambda y: length{_show('y')})), 0)::bigint"
    begin = f"({before} + length('<|im_start|>' || {_role(ts + '[i]')} || chr(10)))"
    return f"coalesce(array_to_string(list_transform(list_filter(range(1, len({ts}) + 1), lambda i: {ts}[i].role = 'assistant'), lambda i: {begin} || ':' || ({before} + length{_show(ts + '[i]')})), ','), '')"


PREFERENCES = f"""
with t as (select conv_id, list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} order by turn, role, text) as ts from (select *, case when conv_id is null then row_number() over () end as own from conversations) group by conv_id, own),
p as (select a.conv_id, a.ts as c, list_concat(a.ts[1:len(a.ts) - 1], case when b.ts is null then [] else [b.ts[len(b.ts)]] end) as r from t a left join t b on b.conv_id = a.conv_id + 1),
n as (select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1, least(len(c), len(r))) as k from p),
x as (select conv_id, k, c[1:k] as pp, c[k + 1:] as cc, r[k + 1:] as rr from n)
select conv_id, cast(k as int) as n_prompt_turns, {_render("pp")} as prompt, {_render("cc")} as chosen, {_render("rr")} as rejected, {_mask("cc")} as chosen_mask, {_mask("rr")} as rejected_mask from x
"""

ORACLE_SQL = {"op4_jaccard": JACCARD, "op7_secrets": secret_spans(), "op10_preferences": PREFERENCES}
