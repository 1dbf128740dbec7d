"""DuckDB SQL with the same rows as the rule queries."""

from __future__ import annotations

from .agent_oracle import CODEX_EVENTS, CUT, FILE_COUNTERS, _counters, _found, _sessions
from .oracle import USAGE

CLAUDE_LINE_RULES = f"""with {USAGE}, l as (
  select case when user_id % 2 = 0 then 'log=u' || user_id end as project_name, event_id % 13 = 0 as synthetic, output_tokens,
         case when event_id % 13 = 0 then '<synthetic>' else model_code end || case when event_id % 6 = 1 then '-fast' else '' end as model_code
  from usage where model_code is not null
)
select project_name, model_code, 2 * count(*) filter (where not synthetic) as raw, 2 * count(*) filter (where synthetic) as synthetic,
       cast(sum(output_tokens) filter (where not synthetic) as bigint) as output_tokens
from l group by all"""

CODEX_LINE_RULES = f"""with {CODEX_EVENTS}, t as (
  select user_id, not is_turn and event_id % 5 = 0 as no_info, not is_turn and event_id % 5 <> 0 and event_id % 11 <> 0 as whole, event_id % 17 = 0 as odd from cs
)
select user_id, count(*) filter (where whole) as raw, count(*) filter (where no_info) as info_null, count(*) filter (where whole and odd) as errors from t group by 1"""

PI_SESSION_IDENTITY = f"""with {USAGE}
select 'p' || user_id as session_id, case user_id % 5 when 2 then '/work/u' || user_id when 4 then null else '/work' end as cwd, cast(3 as integer) as session_version,
       user_id % 5 in (1, 4) as rejected, count(*) as raw, count(*) filter (where user_id % 20 = 7 and event_id % 50 = 3) as error_always, count(*) filter (where user_id % 20 = 11 and event_id % 50 = 3) as error_if_new
from usage group by user_id"""

OPENCODE_SESSION_ROWS = f"""with {USAGE}, m as (select user_id % 50 as s from usage where event_id % 9 <> 0 and event_id % 11 <> 0)
select 's' || s as session_id, 'p' || s % 7 as project_id, case when s % 7 % 2 <> 0 then '/w' end as project_worktree, case when s % 3 <> 0 then 't' else 'None' end as session_title,
       'None' as session_directory, case when s % 2 <> 0 then '1' else 'None' end as session_version, count(*) as n
from m group by s"""

_OPENCODE_N = "(select count(*) as r1, count(distinct user_id % 50) as s1, count(*) filter (where early) as r2, count(distinct user_id % 50) filter (where early) as s2 from mess) n"
OPENCODE_FULL_REFRESH = f"""with {USAGE}, {CUT}, mess as (
  select usage.*, event_id < c as early, input_tokens + cache_read_tokens + cache_write_tokens + output_tokens + reasoning_tokens as tokens
  from usage, cut where event_id % 9 <> 0 and event_id % 11 <> 0
) """ + _found(
    _counters(1, _OPENCODE_N, ("fast_skip", "rows", "sessions"), rows="r1", sessions="s1"),
    _counters(2, _OPENCODE_N, ("fast_skip", "rows", "sessions"), rows="r2", sessions="s2"),
    _sessions("'s' || user_id % 50", "mess"),
)

_PI_N = "(select count(*) as u, count(*) filter (where bad) as b from files) u, (select count(*) as r from good) r"
PI_REFRESH = f"""with {USAGE}, files as (
  select user_id, bool_or(user_id % 20 in (7, 11) and event_id % 50 = 3) as bad from usage group by 1
), good as (
  select usage.*, input_tokens + cache_read_tokens + cache_write_tokens + output_tokens as tokens from usage join files using (user_id) where not bad
) """ + _found(
    _counters(1, _PI_N, FILE_COUNTERS, scanned="u", ingested="u - b", failed="b", raw="r", deduped="r", parse_errors="b"),
    _counters(2, _PI_N, FILE_COUNTERS, scanned="u", unchanged="u - b", failed="b", parse_errors="b"),
    _counters(3, _PI_N, FILE_COUNTERS, scanned="u", ingested="u - b", failed="b", raw="r", deduped="r", parse_errors="b"),
    _sessions("'p' || user_id", "good"),
    "select 'cwd', cast(2 as integer), '/work', count(*), cast(null as bigint) from files having count(*) > 0",
    "select 'compacted', cast(4 as integer), 'at most two files', cast(1 as bigint), cast(null as bigint)",
)

FAILED_RUNS = f"""with {USAGE}, {CUT}, resp as (
  select usage.*, event_id < c as early, coalesce(model_code, 'gemini-x') as model from usage, cut where event_id % 4 <> 0
), ends as (
  select user_id, max((event_timestamp, model)) as last, max((event_timestamp, model)) filter (where early) as last_early from resp group by 1
), n as (
  select (select count(*) from resp) as stored, (select count(*) from ends) as logs, (select count(*) from ends where last_early is null or last_early < last) as behind,
         (select count(*) from usage) as events, (select count(*) from usage, cut where event_id % 9 <> 0 and event_id % 11 <> 0 and (input_tokens + case when event_id < c and event_id % 10 = 4 then 1000 else 0 end) % 10 = 7) as odd
)
select step, cast(failed as integer) as failed, cast(kept as bigint) as stored from (
  select unnest(['all lines', 'earlier lines', 'text before the checkpoint', 'text at the checkpoint', 'schema version', 'message']) as step,
         unnest([0, least(behind, 1), 0, least(logs, 1), least(events, 1), least(odd, 1)]) as failed, unnest([stored, stored, stored, stored, stored, 0]) as kept
  from n
) x"""

ORACLE_SQL = {
    "claude_line_rules": CLAUDE_LINE_RULES, "codex_line_rules": CODEX_LINE_RULES, "pi_session_identity": PI_SESSION_IDENTITY, "opencode_session_rows": OPENCODE_SESSION_ROWS,
    "opencode_full_refresh": OPENCODE_FULL_REFRESH, "pi_refresh": PI_REFRESH, "failed_runs": FAILED_RUNS,
}
