"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
b as (select distinct item_id, {_WORDS.format("text")} as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as key
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
),
sizes as (select distinct n from windows),
places as (
  select doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') as key
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), sizes s where i + s.n - 1 <= len(w)
),
hits as (select doc_id, i, h.n, item_id from places h join windows using (n, key)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
own as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits where item_id is not null) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join own using (doc_id)
"""

OP7 = """
with c as (select distinct vec_id, embedding as e from embeddings where vec_id is not null and embedding is not null),
p as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: case when (a.e[i] > 0) <> (b.e[i] > 0) then 1 else 0 end)) as integer) as distance
  from c a join c b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
)
select query_id, vec_id, distance, cast(rank as integer) as rank
from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p) where rank <= 10
"""

OP5 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, h[2 * i + 1 : 2 * i + 200] as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from h)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from w) where n > 1),
runs as (
  select doc_id, min(i) as a, max(i) + 100 as b
  from (select *, sum(fresh) over (partition by doc_id order by i) as run
        from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from again))
  group by doc_id, run
),
pieces as (
  select doc_id, a, h[2 * coalesce(lag(b) over (partition by doc_id order by a), 0) + 1 : 2 * a] as piece from h join runs using (doc_id)
  union all
  select doc_id, 9223372036854775807, h[2 * coalesce(end_, 0) + 1 :] from h left join (select doc_id, max(b) as end_ from runs group by 1) using (doc_id)
),
kept as (select doc_id, string_agg(piece, '' order by a) as k from pieces group by 1)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(k)) as kept_sha256
from h join kept using (doc_id) left join (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from runs group by 1) using (doc_id)
"""

OP9 = r"""
with recursive lines as (
  select conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) as level, regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') as body
  from (select conv_id, turn, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from (select conv_id, turn, string_split_regex(coalesce(text, ''), '\r?\n') as l from conversations))
),
runs as (select *, sum(fresh) over (partition by conv_id, turn order by i) as g
  from (select *, case when level = lag(level) over (partition by conv_id, turn order by i) then 0 else 1 end as fresh from lines)),
passages as (select conv_id, turn, g, level, string_agg(body, chr(10) order by i) as body from runs group by 1, 2, 3, 4),
own as (select conv_id, turn, max(level) as quote_level,
  regexp_replace(coalesce(string_agg(body, chr(10) order by g) filter (level = 0), ''), '^\s+|\s+$', '', 'g') as own_text from passages group by 1, 2),
pieces as (
  select conv_id, turn, own_text as p from own union all select conv_id, turn, body from passages where level = 0
  union all select conv_id, turn, unnest(string_split_regex(own_text, '\n\s*\n')) from own union all select conv_id, turn, unnest(string_split(own_text, chr(10))) from own
),
origin as (select conv_id, k, min(turn) as from_turn from (select conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) as k from pieces) where k <> '' group by 1, 2),
quoted as (select distinct * from (select conv_id, turn, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) as k from passages where level > 0) where k <> ''),
linked as (select q.conv_id, q.turn, level, case when from_turn < q.turn then from_turn end as f from quoted q left join origin using (conv_id, k)),
parents as (select conv_id, turn, count(*) as n_quotes, count(f) as n_linked, arg_min(f, level * 1e9 - f) filter (f is not null) as parent_turn from linked group by 1, 2),
up as (
  select conv_id, turn, parent_turn as top, 1 as depth from parents where parent_turn is not null
  union all select u.conv_id, u.turn, p.parent_turn, u.depth + 1 from up u join parents p on p.conv_id = u.conv_id and p.turn = u.top and p.parent_turn is not null
),
tops as (select conv_id, turn, arg_max(top, depth) as top, max(depth) as depth from up group by 1, 2)
select c.conv_id, c.turn, c.role, own_text, quote_level, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, parent_turn,
  coalesce(top, c.turn) as thread_turn, cast(coalesce(depth, 0) as bigint) as depth
from conversations c join own using (conv_id, turn) left join parents using (conv_id, turn) left join tops using (conv_id, turn)
"""

OP10 = r"""
with recursive t as (select doc_id, regexp_extract_all(""" + _LOWER.format("text") + r""", '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as x from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (x) where a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
edges as (select a, b from links union all select b, a from links),
reach(d, c) as (select doc_id, doc_id from documents union select r.d, e.b from reach r join edges e on r.c = e.a),
least_ as (select d as doc_id, min(c) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents join least_ using (doc_id) left join n using (doc_id)
"""

ORACLES = {"op1_decontaminate": OP1, "op5_suffix_dedup": OP5, "op7_hamming_topk": OP7, "op9_quote_links": OP9, "op10_minhash": OP10}
