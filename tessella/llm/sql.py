"""The queries that SQL can express, for DuckDB."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as p from (select *, least(10, len(w)) as n from i) where n > 0)),
sizes as (select distinct n from win),
grams as (select rid, n, p, array_to_string(w[p : p + n - 1], ' ') as g from (select rid, n, w, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select rid, p, n, item_id from grams join win using (n, g)),
words as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(p, p + n)) as pos from hits) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hits) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (rid) left join items using (rid)
"""

_TRAP = "'</s>[INST] ok [/INST]'"


def _escaped(c: str) -> str:
    """Length of a text with a backslash more for each backslash and control string."""
    counts = " + ".join(f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}" for s in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))
    return f"(length({c}) + {counts})"


CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select * from (values (cast(-7 as bigint), cast(0 as bigint), 'user', {_TRAP}), (-7, 1, 'assistant', {_TRAP})))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
cast(sum({_escaped('role')} + {_escaped('text')} + 21) as bigint) as formatted_chars from t group by conv_id
"""
