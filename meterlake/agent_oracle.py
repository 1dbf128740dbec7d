"""DuckDB SQL with the same rows as the agent queries."""

from __future__ import annotations

from .oracle import K, SUMS, USAGE, _key, _priced
from .operators.simplify import KEPT_ATTRIBUTES

CUT = "cut as (select max(event_id) * 6 // 10 as c from events)"
UUID = "'00000000-0000-4000-8000-' || lpad(cast({} as varchar), 12, '0')"
FILE_COUNTERS = ("scanned", "unchanged", "ingested", "failed", "raw", "skipped", "duplicates", "deduped", "parse_errors", "monotonicity_errors", "delta_errors", "synthetic", "info_null")


def _counters(run: int, source: str, names: tuple[str, ...], **values: str) -> str:
    listed = ", ".join(f"cast(coalesce({values.get(n, 0)}, 0) as bigint)" for n in names)
    return f"select 'counter' as part, cast({run} as integer) as run, name, value, cast(null as bigint) as tokens from (select unnest({list(names)}) as name, unnest([{listed}]) as value from {source}) c{run}"


def _sessions(name: str, source: str) -> str:
    return f"select 'session', cast(0 as integer), {name}, count(*), cast(sum(tokens) as bigint) from {source} group by 1, 2, 3"


def _found(*parts: str) -> str:
    return " union all ".join(parts)


CLAUDE = f"""with {USAGE}, {CUT}, f as (
  select 1 as run, u.* from usage u, cut where model_code is not null and event_id < c
  union all select 3, u.* from usage u, cut where model_code is not null and event_id >= c - 200
), files as (
  select run, user_id, bool_or(user_id % 20 = 13 and event_id % 40 = 5) as bad from f group by all
), good as (
  select f.* from f join files using (run, user_id) where not bad
), cp as (
  select user_id, max((event_timestamp, message_id)) as m from good where run = 1 group by 1
), g as (
  select good.*, run = 1 or m is null or (event_timestamp, message_id) >= m as passes from good left join cp using (user_id)
), stored as (
  select distinct user_id, message_id, input_tokens + cache_read_tokens + output_tokens as tokens from g where passes
), n as (
  select count(*) filter (where run = 1) as u1, count(*) filter (where run = 3) as u3, count(*) filter (where run = 1 and bad) as b1, count(*) filter (where run = 3 and bad) as b3 from files
), r as (
  select count(*) filter (where run = 1) as r1, count(*) filter (where run = 1 and output_tokens = 0) as d1, count(*) filter (where run = 3) as r3,
         count(*) filter (where run = 3 and passes) as p3, count(*) filter (where run = 3 and passes and output_tokens = 0) as d3 from g
)"""
CLAUDE_INCREMENT = f"{CLAUDE} " + _found(
    _counters(1, "n, r", FILE_COUNTERS, scanned="u1 + 1", ingested="u1 - b1", failed="b1 + 1", raw="2 * r1", duplicates="d1", deduped="r1", parse_errors="b1 + 1"),
    _counters(2, "n, r", FILE_COUNTERS, scanned="u1 + 1", unchanged="u1 - b1", failed="b1 + 1", parse_errors="b1 + 1"),
    _counters(3, "n, r", FILE_COUNTERS, scanned="u1 + u3 + 1", unchanged="u1 - b1", ingested="u3 - b3", failed="b1 + b3 + 1", raw="2 * r3", skipped="2 * (r3 - p3)", duplicates="d3", deduped="p3", parse_errors="b1 + b3 + 1"),
    _sessions("'u' || user_id", "stored"),
)

#: Token counts of the Codex logs: increments, running totals and planted faults.
CODEX_EVENTS = f"""ce as (
  select *, case when event_id % 7 = 0 or event_type = 'signup' then 0 else {K} end as k from events
), cs as (
  select user_id, event_id, ts, event_type = 'signup' as is_turn, k, k + k % 7 + case when user_id % 20 = 7 and event_id % 50 = 3 then 1 else 0 end as last_total,
         case when user_id % 20 = 11 and event_id % 60 = 4 then -event_id else cast(sum(k + k % 7) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) end as total,
         last_value(case when event_type = 'signup' then 'gpt-' || event_id % 3 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as model
  from ce
)"""
CODEX = f"""{CODEX_EVENTS}, tok as (
  select *, row_number() over (partition by user_id, total order by event_id) as nth from cs where not is_turn
), kept as (
  select *, lag(total) over (partition by user_id order by event_id) as before from tok where nth = 1
), late as (
  select user_id, arg_min(case when total <= before then 'order' else 'delta' end, event_id) as late from kept where total <= before or total - before <> last_total group by 1
), logs as (
  select user_id, case when bool_or(user_id % 20 = 13 and event_id % 40 = 5) then 'parse' else any_value(late) end as error from cs left join late using (user_id) group by 1
), stored as (
  select kept.*, k + k % 5 + k % 7 + k % 3 as tokens from kept join logs using (user_id) where error is null
)"""
_CODEX_N = """(select count(*) as u, count(*) filter (where error is null) as ok, count(*) filter (where error = 'parse') as p, count(*) filter (where error = 'order') as o, count(*) filter (where error = 'delta') as d from logs) n,
  (select count(*) as raw from tok join logs using (user_id) where error is null) t, (select count(*) as s from stored) s"""
CODEX_INGEST = f"with {CODEX} " + _found(
    _counters(1, _CODEX_N, FILE_COUNTERS, scanned="u + 1", ingested="ok", failed="u - ok + 1", raw="raw", duplicates="raw - s", deduped="s", parse_errors="p + 1", monotonicity_errors="o", delta_errors="d"),
    _counters(2, _CODEX_N, FILE_COUNTERS, scanned="u + 1", unchanged="ok", failed="u - ok + 1", parse_errors="p + 1", monotonicity_errors="o", delta_errors="d"),
    _sessions(UUID.format("user_id"), "stored"),
)

PI = f"""{CUT}, f as (
  select 1 as run, u.* from usage u, cut where event_id < c union all select 2, u.* from usage u, cut where event_id >= c - 200
), bad1 as (
  select user_id from f where run = 1 and user_id % 20 in (7, 11) and event_id % 50 = 3 group by 1
), cp as (
  select user_id, max((event_timestamp, message_id)) as m from f where run = 1 and user_id not in (select user_id from bad1) group by 1
), p as (
  select f.*, run = 1 or m is null or (event_timestamp, message_id) > m as passes from f left join cp using (user_id)
), bad as (
  select distinct run, user_id from p where event_id % 50 = 3 and (user_id % 20 = 7 or (user_id % 20 = 11 and passes))
), good as (
  select p.* from p left join bad using (run, user_id) where bad.run is null
), stored as (
  select *, input_tokens + cache_read_tokens + cache_write_tokens + output_tokens as tokens from good where passes
)"""
_PI_N = """(select count(distinct user_id) as u from usage) u, (select count(*) filter (where run = 1) as b1, count(*) filter (where run = 2) as b2 from bad) b,
  (select count(*) filter (where run = 1) as r1, count(*) filter (where run = 2) as r2, count(*) filter (where run = 2 and passes) as p2 from good) g"""
PI_INGEST = f"with {USAGE}, {PI} " + _found(
    _counters(1, _PI_N, FILE_COUNTERS, scanned="u + 1", ingested="u - b1", failed="b1 + 1", raw="r1", deduped="r1", parse_errors="b1 + 1"),
    _counters(2, _PI_N, FILE_COUNTERS, scanned="2 * u + 1", unchanged="u - b1", ingested="u - b2", failed="b1 + b2 + 1", raw="r2", skipped="r2 - p2", deduped="p2", parse_errors="b1 + b2 + 1"),
    _sessions("'p' || user_id", "stored"),
)

GEMINI = f"""{CUT}, resp as (
  select usage.*, event_id < c as early, coalesce(model_code, 'gemini-x') as model from usage, cut where event_id % 4 <> 0
), cp as (
  select user_id, max((event_timestamp, model)) as m from resp where early group by 1
), stored as (
  select resp.*, m is null or (event_timestamp, model) >= m as passes, input_tokens + cache_read_tokens + output_tokens + reasoning_tokens as tokens from resp left join cp using (user_id)
)"""
_GEMINI_COUNTERS = ("files", "unchanged", "total", "attempted", "skipped")
_GEMINI_N = "(select count(distinct user_id) as u from usage) u, (select count(*) filter (where early) as e, count(*) as n, count(*) filter (where passes) as p from stored) s"
GEMINI_INGEST = f"with {USAGE}, {GEMINI} " + _found(
    _counters(1, _GEMINI_N, _GEMINI_COUNTERS, files="u", total="e", attempted="e"),
    _counters(2, _GEMINI_N, _GEMINI_COUNTERS, files="u", total="n", attempted="p", skipped="n - p"),
    _counters(3, _GEMINI_N, _GEMINI_COUNTERS, files="u", unchanged="u"),
    _sessions(UUID.format("user_id"), "stored"),
)

OPENCODE = f"""{CUT}, mess as (
  select usage.* replace (input_tokens + case when event_id < c and event_id % 10 = 4 then 1000 else 0 end as input_tokens),
         event_id < c as early, event_id < c and event_id % 10 = 4 as changed from usage, cut where event_id % 9 <> 0 and event_id % 11 <> 0
), stored as (
  select *, input_tokens + cache_read_tokens + cache_write_tokens + output_tokens + reasoning_tokens as tokens from mess
)"""
_OPENCODE_N = "(select count(*) filter (where early) as r1, count(distinct user_id % 50) filter (where early) as s1, count(*) filter (where changed or not early) as r2, count(distinct user_id % 50) filter (where changed or not early) as s2 from mess) n"
OPENCODE_INGEST = f"with {USAGE}, {OPENCODE} " + _found(
    _counters(1, _OPENCODE_N, ("fast_skip", "rows", "sessions"), rows="r1", sessions="s1"),
    _counters(2, _OPENCODE_N, ("fast_skip", "rows", "sessions"), rows="r2", sessions="s2"),
    _counters(3, _OPENCODE_N, ("fast_skip", "rows", "sessions"), fast_skip="1"),
    _sessions("'s' || user_id % 50", "stored"),
)


def _daily(agent: str, ctes: str, source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"select * replace (cast(day as varchar) as day) from ({_priced(agent, ctes, source)} select {k}, {SUMS} from priced group by {k}) dated"


CODEX_USAGE = f"""{CODEX}, seen as (
  select 'openai' as provider_code, coalesce(model, 'gpt-5') as model_code, k as input_tokens, k % 5 as cache_read_tokens, cast(0 as bigint) as cache_write_tokens, k % 7 as output_tokens, k % 3 as reasoning_tokens, ts as event_timestamp from stored
)"""
PI_USAGE = f"{PI}, seen as (select * replace (cast(0 as bigint) as reasoning_tokens) from good where passes)"
GEMINI_USAGE = f"{GEMINI}, seen as (select * replace (model as model_code, 'google' as provider_code, cast(0 as bigint) as cache_write_tokens) from stored)"

#: The Codex logs line by line, the session line of users 1 (mod 4) in the middle.
LINES = f"""{CODEX_EVENTS}, ln as (
  select user_id, case when user_id % 4 = 1 then m else -1 end as event_id, case when user_id % 4 = 1 then 2 else 0 end as n, 'meta' as kind, cast(null as bigint) as total, cast(null as varchar) as model
  from (select distinct user_id from events) u, (select max(event_id) // 2 as m from events) x
  union all select distinct user_id, -1, 1, 'turn', cast(null as bigint), 'gpt-5' from events
  union all select user_id, event_id, 0, case when is_turn then 'turn' else 'token' end, case when not is_turn then total end, case when is_turn then 'gpt-' || event_id % 3 end from cs
  union all select user_id, event_id, 1, 'broken', null, null from cs where user_id % 20 = 13 and event_id % 40 = 5
), num as (
  select *, row_number() over (partition by user_id order by event_id, n) as line from ln
), sg as (
  select *, cast(sum(case when kind = 'turn' then 1 else 0 end) over (partition by user_id order by line rows between unbounded preceding and current row) as bigint) as segment from num
)"""
CODEX_TURNS = f"""with {LINES}
select user_id, {UUID.format('user_id')} as session_id, max(model) as model_code, max(line) filter (where kind = 'turn') as turn_context_line, count(*) filter (where kind = 'token') as token_count_events_raw,
       count(*) filter (where kind = 'token') as token_count_events_with_info, count(distinct total) as token_count_events_deduped
from sg where segment > 0 and user_id % 28 + 1 >= 10 group by user_id, segment"""
CODEX_BOUNDARIES = f"""with {LINES}, tk as (
  select *, last_value(case when kind = 'token' then line end ignore nulls) over (partition by user_id order by line rows between unbounded preceding and 1 preceding) as prior,
         sum(case when kind = 'token' then 1 else 0 end) over (partition by user_id, segment order by line rows between unbounded preceding and current row) as nth
  from sg
), w as (
  select user_id, segment, max(line) filter (where kind = 'turn') as turn_context_line, max(model) as model_code, max(prior) filter (where kind = 'turn') as prev_token_line,
         max(line) filter (where kind = 'token' and nth = 1) as first_after_line, max(total) filter (where kind = 'token' and nth = 1) as first_after_total_tokens,
         max(line) filter (where kind = 'token' and nth = 2) as second_after_line, max(total) filter (where kind = 'token' and nth = 2) as second_after_total_tokens
  from tk where segment > 0 group by 1, 2
), meta as (select user_id, segment as at from sg where kind = 'meta')
select w.user_id, case when meta.at <= w.segment then {UUID.format('w.user_id')} else '<missing_session_id>' end as session_id, model_code, turn_context_line, p.total as prev_total_tokens, prev_token_line,
       first_after_total_tokens, first_after_line, second_after_total_tokens, second_after_line,
       cast(coalesce(first_after_total_tokens = p.total, false) as bigint) as first_matches_previous, cast(coalesce(second_after_total_tokens > first_after_total_tokens, false) as bigint) as second_is_new
from w join meta using (user_id) left join sg p on p.user_id = w.user_id and p.line = w.prev_token_line"""
CODEX_COUNTERS = f"""with {LINES} select count(distinct user_id) as files_scanned, count(*) filter (where kind = 'broken') as parse_errors, count(distinct user_id) as sessions_found,
  count(*) filter (where kind = 'token' and segment = 0) as orphan_token_count_events, cast(0 as bigint) as sessions_missing_metadata from sg"""

LENIENT = f"""with {USAGE}, l as (
  select *, event_id % 17 = 0 as bad, event_id % 17 <> 0 and event_id % 19 = 0 as odd, event_id % 17 <> 0 and event_id % 19 <> 0 and event_id % 23 = 0 as undated from usage where event_id % 17 = 0 or event_id % 4 <> 0
)
select case when not bad then coalesce(model_code, 'gemini-x') end as model_code, count(*) as n, count(*) filter (where bad) as bad, cast(sum(case when not bad then case when odd then 0 else input_tokens end end) as bigint) as input_tokens,
       cast(sum(case when not bad then output_tokens end) as bigint) as output_tokens, count(*) filter (where undated) as undated
from l group by 1"""

#: JSON texts of the telemetry attributes by name; a null is left out.
_ATTRIBUTES = {
    "cached_content_token_count": "k % 5", "duration_ms": "event_id % 500", "event.name": "'\"' || name || '\"'", "event.timestamp": "'\"' || stamp || '\"'", "extra": "'\"dropped\"'", "input_token_count": "k", "model": "'\"gemini-x\"'",
    "output_token_count": "k * 2", "session.id": "'\"s' || user_id || '\"'", "thoughts_token_count": "case when event_id % 7 <> 0 then k % 3 end", "tool_token_count": "0", "total_token_count": "k * 3",
}
_AS_WRITTEN = ("duration_ms", "event.name", "event.timestamp", "input_token_count", "model", "output_token_count", "cached_content_token_count", "session.id", "thoughts_token_count", "tool_token_count", "total_token_count", "extra")


def _json(names: tuple[str, ...]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{n}\":' || cast({_ATTRIBUTES[n]} as varchar)" for n in names) + ") || '}'"


TELEMETRY = f"""te as (
  select *, {K} as k, case event_id % 3 when 0 then 'gemini_cli.api_response' when 1 then 'gemini_cli.api_request' else 'gemini_cli.config' end as name, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp from events
), tj as (
  select event_id, name, stamp, {_json(_AS_WRITTEN)} as written, {_json(tuple(sorted(_ATTRIBUTES)))} as sorted, {_json(KEPT_ATTRIBUTES)} as kept, event_id % 7 <> 0 as complete,
         case when event_id % 5 <> 0 then '{{"text":"' || event_type || '"}}' end as body from te
)"""
SIMPLIFY = f"""with {TELEMETRY}, lv as (
  select 0 as level, '{{"attributes":' || written || case when body is not null then ',"_body":' || body else '' end || ',"resource":1}}' as v from tj
  union all select 1, '{{"attributes":' || written || case when body is not null then ',"_body":' || body else '' end || ',"resource":1}}' from tj where name <> 'gemini_cli.config'
  union all select 2, '{{"attributes":' || sorted || ',"_body":' || body || '}}' from tj where name <> 'gemini_cli.config' and body is not null
  union all select 3, '{{"attributes":' || kept || ',"_body":' || body || '}}' from tj where name = 'gemini_cli.api_response' and body is not null and complete
)
select cast(level as integer) as level, count(*) as n, count(distinct md5(v)) as distinct_records, cast(sum(length(v)) as bigint) as length, min(md5(v)) as least, max(md5(v)) as most from lv group by 1"""
CONVERSION = f"""with {TELEMETRY}, {CUT}, one as (
  select tj.*, event_id < c as early from tj, cut where name <> 'gemini_cli.config' and body is not null
), two as (
  select *, early or stamp > (select max(stamp) from one where early) as taken from one
), done as (
  select name, complete, '{{"_body":' || body || ',"attributes":' || sorted || '}}' as v, '{{"attributes":' || kept || ',"_body":' || body || '}}' as short from two where early or taken
)
select 'counter' as step, 'first run' as name, count(*) filter (where early) as n, cast(null as bigint) as length, cast(null as varchar) as least, cast(null as varchar) as most from two
union all select 'counter', 'second run', count(*) filter (where taken and not early), null, null, null from two
union all select 'counter', 'misplaced', 0, null, null, null
union all select 'counter', 'failed with metadata on line 1', 0, null, null, null
union all select 'counter', 'failed with metadata on line 2', 1, null, null, null
union all select 'converted', name, count(*), cast(sum(length(v)) as bigint), min(md5(v)), max(md5(v)) from done group by 2
union all select 'copy', name, count(*), cast(sum(length(short)) as bigint), min(md5(short)), max(md5(short)) from done where name = 'gemini_cli.api_response' and complete group by 2"""

PRICE_FILE = f"""with {USAGE.replace('prices as', 'other_prices as')}, p as (select min(p_retailprice) as low, max(p_retailprice) as high from part), listed as (
  select unnest(['anthropic/claude-opus-4-6', 'claude-sonnet-4-6']) as price_key, unnest([low, high]) / 1e6 as input, unnest([high, low]) / 1e6 as output, unnest([low, high]) / 1e7 as cache_read, unnest([low, high]) / 5e5 as input_200k from p
  union all select unnest(['openai/gpt-5', 'minimax/MiniMax-M2.1', 'openrouter/z-ai/glm-4.7', 'openrouter/glm-4.7', 'xai/grok-code-fast-1']), unnest([low, high, low, high, low * 2]) / 1e6, unnest([high, low, low, high, high * 2]) / 1e6, unnest([low, high, low, high, low * 2]) / 10 / 1e6, null from p
), named as (
  select 'claude' as agent, * replace ((['claude-opus-4-7', 'claude-opus-4-6', 'claude-sonnet-4-6', 'other'])[event_id % 4 + 1] as model_code) from usage
  union all select 'opencode', * replace ((['gpt-5-free', 'minimax-m2.1:free', 'glm-4.7', 'grok-code', 'other'])[event_id % 5 + 1] as model_code) from usage
), keyed as (
  select *, case when agent = 'opencode' then {_key('opencode')} when model_code like 'claude-opus%' then 'anthropic/claude-opus-4-6' else model_code end as k,
         case when agent = 'claude' then input_tokens + cache_read_tokens + cache_write_tokens > 200000 else input_tokens > 200000 end as over,
         case when agent = 'claude' then output_tokens else greatest(output_tokens - reasoning_tokens, 0) + reasoning_tokens end as billed from named
), costs as (
  select agent, provider_code, model_code, p.price_key is not null as priced, case when agent = 'opencode' and provider_code = 'lmstudio' then 0e0 else
    input_tokens * coalesce(case when over then p.input_200k end, p.input, 0e0) + billed * coalesce(p.output, 0e0) + cache_read_tokens * coalesce(p.cache_read, 0e0) + cache_write_tokens * coalesce(p.input, 0e0) end as cost
  from keyed left join listed p on p.price_key = k
)
select agent, provider_code, model_code, count(*) as n, count(*) filter (where priced) as priced, cast(sum(cast(cost as decimal(28,10))) as double) as cost from costs group by 1, 2, 3"""

BLOCKS = f"""with recursive {USAGE}, starts as (
  select user_id, date_trunc('hour', min(event_timestamp)) as block_start from usage group by 1
  union all
  select s.user_id, date_trunc('hour', min(u.event_timestamp)) from starts s join usage u on u.user_id = s.user_id and u.event_timestamp >= s.block_start + interval 5 hour group by s.user_id
), blocks as (
  select u.*, s.block_start from usage u asof join starts s on u.user_id = s.user_id and u.event_timestamp >= s.block_start
)"""
USAGE_BLOCKS = f"""{BLOCKS}, pauses as (
  select user_id, event_timestamp as now, lag(event_timestamp) over (partition by user_id order by event_timestamp) as before from usage
)
select user_id, strftime(block_start, '%Y-%m-%d %H:%M:%S') as block, count(*) as n, cast(sum(output_tokens) as bigint) as output_tokens, false as is_gap from blocks group by 1, block_start
union all select user_id, strftime(before + interval 5 hour, '%Y-%m-%d %H:%M:%S'), 0, 0, true from pauses where date_sub('second', before, now) > 18000"""
BURN = f"""{BLOCKS}, per as (
  select user_id, block_start, sum(input_tokens + output_tokens) as tokens, min(event_timestamp) as first, max(event_timestamp) as last from blocks group by 1, 2
), rates as (
  select *, date_sub('second', first, last) / 60.0e0 as minutes, greatest(date_sub('second', timestamp '2024-01-20 12:00:00', block_start + interval 5 hour) / 60.0e0, 0e0) as left_minutes from per
), r as (
  select *, date_sub('second', last, timestamp '2024-01-20 12:00:00') < 18000 and left_minutes > 0 as active, case when minutes > 0 then tokens / minutes end as rate from rates
)
select user_id, strftime(block_start, '%Y-%m-%d %H:%M:%S') as block_start, cast(tokens as bigint) as tokens, minutes, cast(rate as double) as tokens_per_minute, active, cast(case when active then tokens + coalesce(rate, 0) * left_minutes end as double) as projected_tokens from r"""

ORACLE_SQL: dict[str, str] = {
    "claude_increment": CLAUDE_INCREMENT,
    "codex_ingest": CODEX_INGEST,
    "codex_daily_usage": _daily("codex", CODEX_USAGE, "seen", "day", "model_code"),
    "pi_ingest": PI_INGEST,
    "pi_daily_usage": _daily("pi", PI_USAGE, "seen", "day", "provider_code", "model_code"),
    "gemini_ingest": GEMINI_INGEST,
    "gemini_daily_usage": _daily("gemini", GEMINI_USAGE, "seen", "day", "model_code"),
    "opencode_ingest": OPENCODE_INGEST,
    "opencode_daily_usage": _daily("opencode", f"{OPENCODE}, seen as (select * from mess)", "seen", "day", "provider_code", "model_code"),
    "codex_turns": CODEX_TURNS,
    "codex_boundaries": CODEX_BOUNDARIES,
    "codex_analysis_counters": CODEX_COUNTERS,
    "gemini_lenient": LENIENT,
    "telemetry_conversion": CONVERSION,
    "price_file": PRICE_FILE,
    "burn_rates": BURN,
    "simplify_levels": SIMPLIFY,
    "usage_blocks": USAGE_BLOCKS,
}
