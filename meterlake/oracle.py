"""DuckDB SQL with the same rows as the named queries."""

from __future__ import annotations

from .views import PRICE_ROWS

K = "cast(json_extract_string(props, '$.k') as bigint)"

USAGE = f"""usage as (
  select concat('s', cast(user_id % 50 as varchar)) as session_id, concat('m', cast(event_id as varchar)) as message_id, event_id, user_id, ts as event_timestamp,
         case user_id % 4 when 0 then 'opencode' when 1 then 'openrouter' when 2 then 'lmstudio' else 'anthropic' end as provider_code,
         case event_type when 'view' then 'claude-sonnet-4-6' when 'click' then 'gpt-5-free' when 'purchase' then 'glm-4.7:free' when 'signup' then 'grok-code' end as model_code,
         cast(round(value * 100) as bigint) * (k + 1) as input_tokens, cast(round(value * 100) as bigint) * (event_id % 3) as cache_read_tokens,
         k * (event_id % 4) as cache_write_tokens, k * 10 as output_tokens, k * (event_id % 13) as reasoning_tokens
  from (select *, {K} as k from events) t
), prices as (
  select price_key, input / 1000000e0 as input, output / 1000000e0 as output, cache_read / 1000000e0 as cache_read, cache_write / 1000000e0 as cache_write,
         input_200k / 1000000e0 as input_200k, output_200k / 1000000e0 as output_200k, cache_read_200k / 1000000e0 as cache_read_200k
  from (values {PRICE_ROWS}) as p(price_key, input, output, cache_read, cache_write, input_200k, output_200k, cache_read_200k)
)"""

STRIP_FREE = "regexp_replace(model_code, '(?:[:-]free)+$', '')"
STRIP_SUFFIXES = "regexp_replace(regexp_replace(model_code, '(?s):.*$', ''), '(?:-free)+$', '')"


def _key(agent: str) -> str:
    m = STRIP_FREE if agent == "opencode" else STRIP_SUFFIXES
    legacy = f"""when provider_code = 'opencode' and starts_with({m}, 'minimax-m2.1') then 'minimax/' || replace({m}, 'minimax-m', 'MiniMax-M')
      when provider_code = 'opencode' and starts_with({m}, 'glm-4.7') then 'openrouter/z-ai/' || {m}""" * (agent == "opencode")
    return f"""case when starts_with({m}, 'gpt') then 'openai/' || {m} when provider_code = 'openrouter' then 'openrouter/' || {m} {legacy}
      when provider_code = 'opencode' and {m} = 'grok-code' then 'xai/grok-code-fast-1' else provider_code || '/' || {m} end"""


def _priced(agent: str, ctes: str = "", source: str = "usage") -> str:
    """CTEs up to `priced`: usage (or what further CTEs make of it) with day, report counters and cost."""
    over = "u.input_tokens + u.cache_read_tokens + u.cache_write_tokens > 200000" if agent == "claude" else "u.input_tokens > 200000"
    t = lambda c: f"coalesce(case when {over} then p.{c}_200k end, p.{c}, 0e0)"
    i = "greatest(u.input_tokens - u.cache_read_tokens, 0)" if agent in ("codex", "gemini") else "u.input_tokens"
    o = "greatest(u.output_tokens - u.reasoning_tokens, 0)" if agent in ("codex", "opencode") else "u.output_tokens"
    billed = {"codex": f"({o} + u.reasoning_tokens)", "opencode": f"({o} + u.reasoning_tokens)", "gemini": "(greatest(u.output_tokens, 0) + greatest(u.reasoning_tokens, 0))"}.get(agent, "u.output_tokens")
    cost = f"{i} * {t('input')} + {billed} * {t('output')} + u.cache_read_tokens * {t('cache_read')}"
    if agent in ("claude", "opencode", "pi"):
        cost += " + u.cache_write_tokens * coalesce(p.cache_write, p.input, 0e0)"
    if agent in ("opencode", "pi"):
        cost = f"case when u.provider_code = 'lmstudio' then 0e0 else {cost} end"
        join = f"left join prices p on p.price_key = {_key(agent)}"
    else:
        prefix = {"claude": "anthropic/", "codex": "openai/", "gemini": "google/"}[agent]
        model = "case when u.model_code = 'claude-opus-4-7' then 'claude-opus-4-6' else u.model_code end" if agent == "claude" else "u.model_code"
        join = f"left join prices p on p.price_key = '{prefix}' || {model}"
    return f"""with {USAGE}, {ctes + ", " if ctes else ""}named as (
  select * replace (coalesce(provider_code, 'unknown') as provider_code, coalesce(model_code, 'unknown') as model_code) from {source}
), priced as (
  select u.*, cast(u.event_timestamp as date) as day, {i} as shown_input, {o} as shown_output, {cost} as cost from named u {join}
)"""


SUMS = """cast(sum(shown_input) as bigint) as input_tokens, cast(sum(cache_read_tokens) as bigint) as cached_tokens, cast(sum(cache_write_tokens) as bigint) as cache_write_tokens,
  cast(sum(shown_output) as bigint) as output_tokens, cast(sum(reasoning_tokens) as bigint) as reasoning_tokens, count(*) as events, cast(sum(cast(cost as decimal(28,10))) as double) as cost"""


def _by(agent: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"{_priced(agent)} select {k}{', ' * bool(k)}{SUMS} from priced {f'group by {k}' if k else ''}"


NAMED = f"""with {USAGE}, odd as (
  select event_id, provider_code, (['gpt-5', 'glm-4.7', 'minimax-m2.1', 'grok-code', 'qwen/qwen3'])[event_id % 5 + 1] || (['', ':free', '-free', ':free-free', ':beta:x', '-free:x'])[event_id % 6 + 1] as model_code from usage
)"""

CUMULATIVE = f"""cumulative as (
  select user_id, event_id, ts, event_type, inc + case when event_id % 97 = 1 then 1 else 0 end as last_tokens,
         cast(sum(inc) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) - case when event_id % 211 = 2 then 500 else 0 end as total_tokens
  from (select *, case when event_id % 7 = 0 then 0 else {K} + 1 end as inc from events) t
)"""

FIRST = f"""with {CUMULATIVE}, firsts as (
  select *, row_number() over (partition by user_id, total_tokens order by event_id) as n, count(*) over (partition by user_id, total_tokens) - 1 as repeats,
         first_value(last_tokens) over (partition by user_id, total_tokens order by event_id) as f from cumulative
), marked as (select *, max(case when last_tokens is distinct from f then 1 else 0 end) over (partition by user_id, total_tokens) = 1 as conflict from firsts)
, kept as (select *, lag(total_tokens) over (partition by user_id order by event_id) as before from marked where n = 1)"""

PARTIAL = f"""with {USAGE}, pf as (
  select message_id, 1 as line_number, output_tokens, cast(null as varchar) as stop_reason from usage
  union all select message_id, 2, output_tokens + event_id % 3, case when event_id % 2 = 0 then 'end_turn' end from usage
  union all select message_id, 3, output_tokens + event_id % 5, 'tool_use' from usage where event_id % 4 = 0
), c as (
  select *, row_number() over (partition by message_id order by line_number) as n, count(*) over (partition by message_id) as a from pf
), d as (
  select *, n = 1 or output_tokens is distinct from lag(output_tokens) over (partition by message_id order by n) as changed from c where n = 1 or stop_reason is not null
), e as (
  select *, row_number() over (partition by message_id order by n desc) as r, count(*) over (partition by message_id) as kept from d where changed
)
select message_id, line_number, output_tokens, stop_reason, a - kept as duplicates from e where r = 1"""

TURNS = f"""with {CUMULATIVE}, turns as (
  select user_id, event_id, event_type = 'signup' as is_turn, case when event_type = 'signup' and event_id % 10 <> 0 then concat('m', cast(event_id % 3 as varchar)) end as model,
         case when event_type <> 'signup' then total_tokens end as total_tokens from cumulative
), seg as (
  select *, cast(sum(cast(is_turn as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as segment from turns
)"""

PER_TURN = f"""{TURNS}, per as (
  select user_id, segment, min(event_id) filter (where is_turn) as turn_line, count(*) filter (where not is_turn) as token_rows,
         count(*) filter (where not is_turn and total_tokens is not null) as with_total, count(distinct total_tokens) filter (where not is_turn) as distinct_totals
  from seg group by user_id, segment
)"""

BOUNDARY = f"""{TURNS}, t as (
  select *, not is_turn and total_tokens is not null as token,
         last_value(case when not is_turn and total_tokens is not null then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prior,
         sum(case when not is_turn and total_tokens is not null then 1 else 0 end) over (partition by user_id, segment order by event_id rows between unbounded preceding and current row) as nth
  from seg
), w as (
  select user_id, segment, min(event_id) filter (where is_turn) as turn_line, max(prior) filter (where is_turn) as previous_line,
         max(event_id) filter (where token and nth = 1) as first_line, max(total_tokens) filter (where token and nth = 1) as first_total,
         max(event_id) filter (where token and nth = 2) as second_line, max(total_tokens) filter (where token and nth = 2) as second_total
  from t where segment > 0 group by user_id, segment
), b as (
  select w.user_id, segment, turn_line, c.total_tokens as previous_total, previous_line, first_total, first_line, second_total, second_line,
         first_total - c.total_tokens as first_delta, second_total - first_total as second_delta
  from w left join cumulative c on c.user_id = w.user_id and c.event_id = w.previous_line
)"""

HALVES = f"""with {USAGE}, u as (
  select *, case when user_id % 3 <> 0 then concat('a', cast(user_id % 2 as varchar)) end as agent_id from usage
), stored as (select * from u where event_id % 10 < 6 and user_id % 5 <> 0)"""

REGISTRY = """with registry as (
  select c_custkey as project_id, '/logs/' || cast(case when c_custkey % 6 = 1 then c_custkey + 1000000 else c_custkey end as varchar) as path, c_custkey % 5 <> 0 as active
  from customer where c_custkey % 4 <> 0
)"""

ODD = f"""with odd as (
  select event_id, event_id % 7 as kind, {K} as k from events
)"""


def _top(source: str, value: str, k: int) -> str:
    return f"""{source}, v as (select {value} as v, user_id, segment from {'per where segment > 0' if value == 'token_rows' else 'b'})
select v as {value}, n, 100.0 * n / total as share from (
  select v, count(*) as n, min((user_id, segment)) as f, (select count(v) from v) as total from v where v is not null group by v
) x order by n desc, f limit {k}"""


ORACLE_SQL: dict[str, str] = {
    "daily_usage_by_model": _by("claude", "day", "model_code"),
    "daily_usage_by_provider_model": _by("opencode", "day", "provider_code", "model_code"),
    "overall_usage_by_model": _by("opencode", "provider_code", "model_code"),
    "daily_totals": _by("opencode", "day"),
    "grand_total": f"select *, input_tokens + cached_tokens + cache_write_tokens + output_tokens + reasoning_tokens as total_tokens from ({_by('opencode')}) x",
    "usage_report_grouping_sets": f"""{_priced('opencode')} select day, provider_code, model_code, {SUMS},
      case grouping(day, provider_code, model_code) when 0 then 'day_model' when 4 then 'model' when 3 then 'day' else 'total' end as level
      from priced group by grouping sets ((day, provider_code, model_code), (provider_code, model_code), (day), ())""",
    **{f"event_cost_{a}": f"{_priced(a)} select event_id, cost from priced" for a in ("claude", "codex", "opencode", "pi", "gemini")},
    "price_key_rules_opencode": f"{NAMED} select event_id, {_key('opencode')} as price_key from odd",
    "price_key_rules_pi": f"{NAMED} select event_id, {_key('pi')} as price_key from odd",
    "strip_free": f"{NAMED} select {STRIP_FREE} as model, count(*) as n from odd group by 1",
    "strip_suffixes": f"{NAMED} select {STRIP_SUFFIXES} as model, count(*) as n from odd group by 1",
    "price_flatten": "select lower(p_brand) || '/m' || cast(p_partkey as varchar) as price_key, p_retailprice / 1000000e0 as input, (p_size * 2) / 1000000e0 as output, cast(null as double) as cache_read, cast(p_size * 1000 as bigint) as context_limit from part",
    "day_bucket_tz": f"with {USAGE} select cast(event_timestamp at time zone 'UTC' at time zone 'America/New_York' as date) as day, count(*) as n from usage group by 1",
    "since_until": f"with {USAGE} select * from (select cast(event_timestamp at time zone 'UTC' at time zone 'America/New_York' as date) as day, count(*) as n from usage group by 1) x where day >= date '2024-01-05' and day < date '2024-01-20'",
    "last_7_days": f"with {USAGE} select cast(event_timestamp as date) as day, count(*) as n from usage where cast(event_timestamp as date) >= date '2024-01-19' group by 1",
    "cwd_filter_join": f"with {USAGE} select user_id as session_id, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens from usage join customer on c_custkey = user_id where lower(c_mktsegment) = 'building' group by 1",
    "three_table_join": "select n_name, count(*) as messages, count(distinct c_custkey) as sessions from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "dedupe_final_wins": PARTIAL,
    "dedupe_first_cumulative": f"{FIRST} select user_id, event_id, total_tokens, repeats, conflict from kept",
    "monotonic_violations": f"{FIRST} select user_id, event_id, total_tokens, before from kept where total_tokens <= before",
    "delta_violations": f"{FIRST} select user_id, event_id, total_tokens <= before as falls from kept where total_tokens - before <> last_tokens",
    "asof_model_attribution": f"""{TURNS}, l as (select *, max(case when is_turn then event_id end) over (partition by user_id order by event_id) as turn from turns)
      select l.user_id, l.event_id, t.model as current_model from l left join turns t on t.user_id = l.user_id and t.event_id = l.turn where not l.is_turn""",
    "checkpoint_per_scope": f"""with {USAGE} select session_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') as last_at, message_id
      from (select *, row_number() over (partition by session_id order by event_timestamp desc, message_id desc) as n from usage) x where n = 1""",
    "checkpoint_null_safe": f"""{HALVES}, cp as (select session_id, agent_id, max(event_id) as m from stored group by all)
      select u.session_id, u.agent_id, event_id from u left join cp on cp.session_id = u.session_id and cp.agent_id is not distinct from u.agent_id where m is null or event_id >= m""",
    "tail_inclusive": f"""{HALVES}, cp as (select session_id, max((event_timestamp, event_id)) as m from stored group by 1)
      select u.session_id, event_id from u left join cp using (session_id) where m is null or (event_timestamp, event_id) >= m""",
    "tail_strict": f"""{HALVES}, cp as (select max((event_timestamp, event_id)) as m from stored where event_id % 1000 < 500)
      select session_id, event_id from u, cp where m is null or (event_timestamp, event_id) > m""",
    "file_rounds": "select o_custkey as session_id, lpad(cast(o_orderkey as varchar), 12, '0') as file_path, cast(row_number() over (partition by o_custkey order by lpad(cast(o_orderkey as varchar), 12, '0')) as integer) as round from orders",
    "file_gate": "select o_orderkey as file_path, cast(round(o_totalprice * 100) as bigint) as file_size from orders where o_orderkey % 4 = 0 or o_orderkey % 7 = 0",
    "insert_ignore": """with i as (select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey % 3 <> 0 union all select o_orderkey, -o_custkey, o_orderpriority from orders where o_orderkey % 5 = 0)
      select o_orderkey, o_custkey, o_orderpriority from (select *, row_number() over (partition by o_orderkey order by o_custkey desc) as n from i) x where n = 1 and o_orderkey % 2 <> 0""",
    "upsert_latest": """select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderkey % 2 = 0 then 'first' else 'second' end as ingested_at
      from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0""",
    "registry_reconcile": f"""{REGISTRY}, d as (select c_custkey as project_id, '/logs/' || cast(case when c_custkey % 11 = 0 then c_custkey + 1 else c_custkey end as varchar) as path, c_custkey % 13 = 0 as valid from customer)
      select d.project_id, d.path, r.path as old_path, case when o.project_id <> d.project_id then 'conflict_path' when r.path is null then 'new' when r.path <> d.path and valid then 'conflict_old_path'
        when not r.active then 'reactivate' when r.path <> d.path then 'moved' else 'same' end as action
      from d left join registry r on r.project_id = d.project_id left join registry o on o.path = d.path""",
    "registry_deactivate": f"""{REGISTRY} select project_id, active and not hit as active, active and hit as deactivated
      from (select *, project_id in (select o_custkey from orders where o_custkey % 2 = 1) as hit from registry) x""",
    "registry_missing": f"{REGISTRY} select project_id, path from registry where active and path not in (select '/logs/' || cast(c_custkey as varchar) from customer)",
    "source_max_gate": "select max(event_id) as source_max, max(event_id) filter (where event_id % 2 = 0) as cp, max(event_id) >= max(event_id) filter (where event_id % 2 = 0) as go_on from events",
    "active_collisions": "select o_custkey as project_id, count(*) as n from orders where o_orderstatus <> 'F' group by 1 having count(*) > 1",
    "infile_duplicates": "select l_orderkey, l_linenumber, count(*) as n, min(l_partkey) as first_line from lineitem group by 1, 2 having count(*) > 1",
    "turn_segments": f"{PER_TURN} select * from per",
    "boundary_windows": f"{BOUNDARY} select * from b",
    "turn_metrics": f"""{PER_TURN} select count(token_rows) as n, avg(token_rows) as mean, quantile_cont(token_rows, 0.5) as median, quantile_cont(token_rows, 0.9) as p90, quantile_cont(token_rows, 0.95) as p95,
      cast(max(token_rows) as double) as max from per where segment > 0""",
    "topk_frequencies": _top(PER_TURN, "token_rows", 5),
    "topk_deltas": _top(BOUNDARY, "first_delta", 8),
    "match_rates": f"""{BOUNDARY}, e as (select *, previous_total is not null and first_total is not null as eligible from b), f as (
      select count(*) as windows, count(*) filter (where eligible) as eligible, count(*) filter (where eligible and first_total = previous_total) as same, count(*) filter (where eligible and second_total > first_total) as rises from e)
      select *, 100.0 * same / eligible as same_percent, 100.0 * rises / eligible as rises_percent from f""",
    "boundary_mismatches": f"{BOUNDARY} select user_id, turn_line, previous_total, first_total from b where first_total <> previous_total order by user_id, turn_line limit 10",
    "session_backfill": """with f as (select user_id, min(event_id) as e from events where event_type = 'purchase' group by 1)
      select case when e is not null then concat('p', cast(e as varchar)) end as session_id, count(*) as n from events left join f using (user_id) group by 1""",
    "dq_duplicates": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "dq_missing_model": f"with {USAGE} select session_id, count(*) as n from usage where model_code is null group by 1",
    "dq_session_summary": f"with {USAGE} select session_id, count(*) as events, cast(sum(output_tokens) as bigint) as tokens from usage group by 1",
    "dq_null_counters": f"with {USAGE} select count(*) filter (where input_tokens is null) as null_input_tokens, count(*) filter (where output_tokens is null) as null_output_tokens, count(*) filter (where model_code is null) as null_model_code from usage",
    "dq_orphans": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 9 <> 0)",
    "dq_rows_and_sessions": f"with {USAGE} select count(*) as rows, count(distinct session_id) as sessions from usage",
    "dq_by_provider_model": f"""{_priced('opencode')} select provider_code, model_code, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
      cast(sum(cast(cost as decimal(28,10))) as double) as reported_cost from priced group by 1, 2""",
    "dq_not_rising": f"with {CUMULATIVE} select user_id, event_id, total_tokens, before from (select *, lag(total_tokens) over (partition by user_id order by event_id) as before from cumulative) x where total_tokens <= before",
    "dq_wrong_increment": f"with {CUMULATIVE} select user_id, event_id, total_tokens, before from (select *, lag(total_tokens) over (partition by user_id order by event_id) as before from cumulative) x where total_tokens - before <> last_tokens",
    "dq_checkpoint": f"with {USAGE} select event_id, message_id from usage order by event_id desc, message_id desc limit 1",
    "json_strict_extract": f"""{ODD} select event_id, case when kind = 0 then k end as n, case when kind <> 0 then 'n: expected a whole number' end as error,
      case when kind = 0 then k else 0 end as maybe, kind in (1, 2, 3, 5, 6) as wrong, 't' as s from odd""",
    "lenient_int": f"{ODD} select event_id, case when kind in (0, 1, 2) then k when kind = 3 then 1 else 0 end as n from odd",
    "weekly_usage": f"""with daily as ({_by('opencode', 'day')}) select cast(day - cast(dayofweek(day) as integer) as date) as week, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "events"))},
      cast(sum(cast(cost as decimal(28,10))) as double) as cost from daily group by 1""",
    "monthly_usage": f"""with daily as ({_by('opencode', 'day')}) select strftime(day, '%Y-%m') as month, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "events"))},
      cast(sum(cast(cost as decimal(28,10))) as double) as cost from daily group by 1""",
    "session_report": f"{_priced('opencode')} select session_id, {SUMS}, strftime(max(event_timestamp), '%Y-%m-%d %H:%M:%S') as last_activity, count(distinct model_code) as models, string_agg(distinct '1.' || event_id % 3, ',' order by '1.' || event_id % 3) as versions from priced group by 1",
    "cost_modes": f"""{_priced('opencode')}, r as (select event_id, cost, case when event_id % 3 <> 0 then cost + case when event_id % 5 = 0 then 0.5e0 else 0e0 end end as reported from priced)
      select event_id, coalesce(reported, cost) as auto, cost as calculate, coalesce(reported, 0e0) as display from r""",
    "raw_log_scan": f"select case event_id % 3 when 0 then 'gemini_cli.api_response' when 1 then 'gemini_cli.api_request' else 'gemini_cli.config' end as name, count(*) as n, cast(sum({K}) as bigint) as input_tokens from events group by 1",
    "jsonl_scan_quarantine": """with l as (select *, row_number() over (partition by user_id order by event_id) as line, user_id % 10 = 0 and event_id % 50 = 0 as broken from events)
      select user_id, count(*) as n, count(*) filter (where broken) as bad, min(line) filter (where broken) as first_bad from l group by 1""",
    "claude_ingest": f"with {USAGE} select concat('u', cast(user_id as varchar)) as session_id, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from usage where model_code is not null group by 1",
    "cost_mismatch": f"{_priced('opencode')} select event_id, round(cost + 0.5e0 - cost, 6) as difference from priced where event_id % 5 = 0",
}


def _as_text(sql: str, column: str) -> str:
    return f"select * replace (cast({column} as varchar) as {column}) from ({sql}) dated"


for _name, _column in {
    "daily_usage_by_model": "day", "daily_usage_by_provider_model": "day", "daily_totals": "day", "usage_report_grouping_sets": "day",
    "day_bucket_tz": "day", "since_until": "day", "last_7_days": "day", "weekly_usage": "week",
}.items():
    ORACLE_SQL[_name] = _as_text(ORACLE_SQL[_name], _column)
