"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

OP4 = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as q,
         row_number() over (partition by vec_id order by embedding) as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, a.c, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a, v b where a.vec_id % 100 = 0 and (a.vec_id <> b.vec_id or a.c <> b.c)
), r as (
  select query_id, cast(row_number() over (partition by query_id, c order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

OP5 = r"""
with w as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i+7], ' ') as k from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from w)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from win) where c > 1
), cov as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by doc_id
), m as (
  select w.doc_id, w.source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
  from w left join cov using (doc_id)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 12 * n_words as soft
  from m
), h as (
  select source, count(*) as n, count(*) filter (where base_failed or soft) as failed from f group by source
), p as (
  select avg(failed / n) as mean, var_pop(failed / n) - avg(failed / n) * (1 - avg(failed / n)) * avg(1 / n) as v from h
), k as (
  select mean, case when v > 0 then least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) else 1e6 end as strength from p
), bad as (
  select source as s, (failed + mean * strength) / (n + strength) as rate, mean, n + strength + 1 as wide from h, k
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not (rate - 1.645 * sqrt(rate * (1 - rate) / wide) > 1.25 * mean and soft) as kept
from f join bad on f.source is not distinct from bad.s
"""

OP6 = r"""
with recursive c as (
  select case when source is null then '' else '=' || source end as key, 1 + coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as integer), 0) % 7 as weight from documents group by all
), m as (
  select key, cast(greatest(1, round(greatest(1000, 20 * (select count(*) from c)) * cast(weight as double) / (select sum(weight) from c))) as bigint) as m from c
), k as (
  select list(key order by key) as keys, list(m order by key) as ms, cast(sum(m) as bigint) as w from m
), edf as (
  select cast(0 as bigint) as t, cast(null as bigint) as pick, list_transform(ms, lambda x: cast(0 as bigint)) as nxt from k where w > 0
  union all
  select t + 1, pick.i, list_transform(nxt, lambda x, i: case when i = pick.i then x + 1 else x end)
  from (select t, nxt, list_min(list_filter(list_transform(ms, lambda x, i:
          case when nxt[i] < x and (nxt[i] * w) // x <= t then {'deadline': ((nxt[i] + 1) * w + x - 1) // x, 'i': i} end), lambda y: y is not null)) as pick
        from edf, k where t < w) s
), slots as (
  select keys[pick] as key, t - 1 as pos, row_number() over (partition by pick order by t) - 1 as idx from edf, k where t > 0
), d as (
  select doc_id, source, case when source is null then '' else '=' || source end as key,
         row_number() over (partition by source order by coalesce(md5(cast(doc_id as varchar)), ''), doc_id) - 1 as source_row
  from documents
)
select doc_id, source, source_row, source_row // 8 as block, (source_row // 8) // m.m * k.w + pos as slot, source_row % 8 as block_row
from d join m using (key) cross join k join slots on slots.key = d.key and slots.idx = (source_row // 8) % m.m
"""

OP10 = r"""
with t as (
  select conv_id, turn, role, text, 'c' || conv_id || '-' || turn as own, 'c' || conv_id || '-' || (turn - 1) as prior from conversations
), calls as (
  -- each call needs the one before it: its level is the number of earlier calls of its conversation
  select *, row_number() over (partition by conv_id order by call_turn) - 1 as level
  from (select conv_id, own, min(turn) as call_turn from t where role = 'user' and own is not null group by all) first_turns
), answered as (
  select distinct conv_id, prior from t where role = 'assistant' and prior is not null
), j as (
  select t.*, c.call_turn, c.level, c.own as called, a.prior is not null as answered
  from t left join calls c on c.conv_id = t.conv_id and c.own = case when t.role = 'user' then t.own when t.role = 'assistant' then t.prior end
  left join answered a on a.conv_id = t.conv_id and a.prior = t.own
), e as (
  select *, case when role = 'user' then concat_ws('; ', case when text is null then 'prompt: missing' end,
      case when length(text) < 1 then 'prompt: minLength' end, case when length(text) > 400 then 'prompt: maxLength' end,
      case when turn < 0 then 'turn: minimum' end) end as errors
  from j
)
select conv_id, turn, coalesce(call_turn, turn) as seq_turn, cast(coalesce(level, 0) as integer) as seq_level, coalesce(call_turn, turn) as seq_call, called as seq_id,
       cast(case when role = 'assistant' and call_turn is not null then 1 else 0 end as integer) as seq_kind,
       case when role = 'user' then answered when role = 'assistant' then call_turn is not null end as linked,
       case when role = 'user' then errors = '' end as valid, errors,
       '{' || concat_ws(',', '"content":' || cast(to_json(text) as varchar), '"role":' || cast(to_json(role) as varchar),
         case when role = 'user' then '"tool_call":{' || concat_ws(',',
           '"arguments":{' || concat_ws(',', '"prompt":' || cast(to_json(text) as varchar), '"turn":' || turn) || '}',
           '"id":' || cast(to_json(own) as varchar), '"name":"reply"') || '}' end,
         case when role = 'assistant' then '"tool_call_id":' || cast(to_json(prior) as varchar) end) || '}' as json
from e
"""

OP12 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), o as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, sha256(length(role) || ':' || role || text)) as ts from t group by conv_id
), h as (
  -- CRC-32 of the decimal id: 8 steps for each byte
  select conv_id, ts, (4294967295 - list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [cast(0 as bigint) for _ in range(8)]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))) % 4 as h
  from o
), r as (
  select h.conv_id, list_concat(coalesce(list_slice(b.ts, 1, h), []), coalesce(list_slice(h.ts, h + 1, len(h.ts)), [])) as ts
  from h left join o b on b.conv_id = h.conv_id - h.conv_id % 20
), p as (
  select conv_id, len(ts) as n, d, list_slice(ts, 1, d) as pre from (select conv_id, ts, unnest(range(0, len(ts) + 1)) as d from r)
), v as (
  select d, pre, min(conv_id) as conv_id, count(*) as n_convs, array_to_string(list(conv_id order by conv_id) filter (n = d), ',') as ends,
         max(n) = d as childless, case when d > 0 then len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) else 0 end as words
  from p group by d, pre
), below as (
  -- each node with all its ancestors, itself included
  select u.childless, (u.n_convs - 1) * u.words as saved, u.d as depth, a as d, list_slice(u.pre, 1, a) as pre
  from (select *, unnest(range(0, d + 1)) as a from v) u
), sums as (
  select d, pre, count(*) filter (childless) as n_leaves, count(*) filter (depth = d + 1) as n_children, sum(saved) as saved_tokens from below group by d, pre
)
select v.conv_id, cast(v.d as bigint) as depth, up.conv_id as parent_conv_id, v.n_convs, n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens,
       sha256(coalesce(v.ends, '')) as ends_sha256
from v join sums on sums.d = v.d and sums.pre = v.pre
left join v up on up.d = v.d - 1 and up.pre = list_slice(v.pre, 1, v.d - 1)
"""

ORACLE_SQL = {"op4_topk": OP4, "op5_quality_rules": OP5, "op6_mix_sources": OP6, "op10_chat_format": OP10, "op12_prefix_trie": OP12}
