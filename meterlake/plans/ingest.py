"""Incremental ingestion (INC-01): gate files, parse, validate, drop what is known, commit.

All functions return the run's counters, (counter, value), which are also appended to
`ingest_runs` (SNK-17, AGG-10).
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agents, dedupe, incremental
from ..operators.agents import CONFLICT, DELTA, ORDER, Parsed
from ..schemas import TABLES
from ..sources import lines as scan
from ..sources.scratch import written
from ..sources.warehouse import Warehouse

#: Event table, checkpoint scope, checkpoint key and whether the checkpoint's own row passes, by agent.
EVENTS = {
    "claude": ("claude_usage_events", ["session_id", "scope_agent"], ["event_timestamp", "message_id", "request_id"], True),
    "codex": ("codex_session_details", ["session_id"], ["event_timestamp", "total_tokens_cumulative"], True),
    "pi": ("pi_usage_events", ["session_id"], ["event_timestamp", "message_id"], False),
}
#: Changed files are read by their paths, in groups of up to so many files and about so many bytes.
MOST_PATHS, MOST_BYTES = 10_000, 1 << 40
#: Up to so many sessions of a batch are named in the scan of the stored events.
FEW_SESSIONS = 1_000
_EMPTY = {"scanned": 0, "unchanged": 0, "ingested": 0, "failed": 0, "raw": 0, "skipped": 0, "duplicates": 0, "deduped": 0, "parse_errors": 0, "monotonicity_errors": 0, "delta_errors": 0, "synthetic": 0, "info_null": 0}


def _now(now: datetime | None) -> Column:
    return F.lit(now or datetime.now(timezone.utc))


def _report(warehouse: Warehouse, agent: str, counters: dict[str, int], at: Column, extra: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None) -> DataFrame:
    out = warehouse.spark.createDataFrame(list(counters.items()), "counter string, value long")
    run = out.select(F.lit(agent).alias("agent"), at.alias("run_at"), "counter", "value")
    warehouse.commit({**(extra or {}), "ingest_runs": run}, changed=changed)
    return out


def _parse(agent: str, fields: DataFrame, roots: list[str], files: DataFrame | None = None) -> Parsed:
    """`files`: the paths that were read; those without any line have no session, which is an error of the file."""
    parsed = agents.claude(None, roots, fields=fields) if agent == "claude" else {"codex": agents.codex, "pi": agents.pi}[agent](None, fields=fields)
    if files is None:
        return parsed
    every = files.select("file_path").join(parsed.files, "file_path", "left")
    return Parsed(every.withColumn("identity_error", F.coalesce("identity_error", F.when(F.col("session_id").isNull(), F.lit(agents.IDENTITY)))), parsed.rows)


def read_groups(files: DataFrame, n: int) -> DataFrame:
    """Files (file_path, file_size, ...), n in all, with `read_group`: stretches in path order of at most MOST_PATHS files.

    A stretch ends with the file that takes the bytes before it past another MOST_BYTES. Ranges of
    paths are numbered by many tasks from one row per range.
    """
    if n <= MOST_PATHS:
        return files.withColumn("read_group", F.lit(0).cast("long"))
    ranges = files.repartitionByRange("file_path").withColumn("part__", F.spark_partition_id()).persist()
    above = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("part__").agg(F.count("*").alias("n__"), F.sum("file_size").alias("b__"))
    starts = sums.select("part__", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}at") for c in ("n__", "b__")])
    within = Window.partitionBy("part__").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.withColumns({"i__": F.count("*").over(within), "o__": F.coalesce(F.sum("file_size").over(within), F.lit(0))}).join(F.broadcast(starts), "part__")
    # both numbers only rise along the paths, so each sum of the two is one stretch
    by_count, by_bytes = F.floor((F.col("n__at") + F.col("i__")) / max(1, MOST_PATHS)), F.floor((F.col("b__at") + F.col("o__")) / MOST_BYTES)
    return counted.withColumn("read_group", (by_count + by_bytes).cast("long")).select(*files.columns, "read_group")


def _grouped(files: DataFrame, n: int) -> list[DataFrame]:
    """The files of each read group, in path order; what comes to the driver are the groups' numbers."""
    if n <= MOST_PATHS:
        return [files]
    grouped = read_groups(files, n).persist()
    found = sorted(r["read_group"] for r in grouped.select("read_group").distinct().collect())
    return [grouped.filter(F.col("read_group") == g).drop("read_group") for g in found]


def _fields_of(spark: SparkSession, agent: str, wanted: DataFrame, pattern: str) -> DataFrame:
    """Typed fields of the lines of one read group; no other file is opened.

    They are stored, as are the later steps of a run: a step that is only cached stands in the
    plan of each later one with all that led to it, and with many steps and files the driver
    spends its time and memory on these plans.
    """
    paths = sorted(scan.literal(r["file_path"]) for r in wanted.select("file_path").collect())
    return written(agents.FIELDS[agent](scan.json_lines(scan.lines(spark, paths, pattern=pattern))), f"{agent}-fields")


def _stored_of(warehouse: Warehouse, table: str, sessions: DataFrame) -> DataFrame:
    """Stored events of the given sessions; while these are few, their ids reach the Parquet scan."""
    stored, ids = warehouse.read(table), sessions.select("session_id").distinct()
    few = ids.limit(FEW_SESSIONS + 1).collect()
    if len(few) <= FEW_SESSIONS:
        return stored.filter(F.col("session_id").isin([r["session_id"] for r in few]))
    return stored.join(ids, "session_id", "left_semi")


def _checked(agent: str, rows: DataFrame) -> DataFrame:
    """New rows folded to one per key, with `late_error` (class) and `kept`; `n` counts the rows folded."""
    none = F.lit(None).cast("string")
    if agent == "claude":
        usage = F.struct("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
        return dedupe.fold_final(rows, ["file_path", "message_id", "request_id"], "line_number", usage, F.col("is_final")).withColumn("late_error", none)
    if agent == "codex":
        first = dedupe.first_per_cumulative(rows, ["file_path"], "total_tokens_cumulative", "line_number", F.col("total"))
        fields = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
        checked = dedupe.order_checks(first, ["file_path"], "line_number", "total_tokens_cumulative", [(F.col(f"total.{f}"), F.col(f"last.{f}")) for f in fields])
        late = F.when(F.col("conflict"), CONFLICT).when(F.col("falls"), ORDER).when(F.col("bad_delta"), DELTA)
        return checked.withColumns({"late_error": late, "duplicates": F.col("repeats")})
    return rows.withColumns({"late_error": none, "duplicates": F.lit(0).cast("long")})


def _file_errors(parsed: Parsed, passing: DataFrame, folded: DataFrame) -> DataFrame:
    """(file_path, error): the first error of each rejected file, by stage and line."""
    at = lambda stage, line, c: F.struct(F.lit(stage).alias("stage"), line.cast("long").alias("line"), c.alias("class"))
    zero, line = F.lit(0), F.col("line_number")
    found = parsed.files.filter("identity_error is not null").select("file_path", at(0, zero, F.col("identity_error")).alias("e"))
    found = found.unionByName(parsed.rows.filter("error_always is not null").select("file_path", at(1, line, F.col("error_always")).alias("e")))
    found = found.unionByName(passing.filter("error_if_new is not null").select("file_path", at(1, line, F.col("error_if_new")).alias("e")))
    # duplicates are settled before order is looked at
    stage = F.when(F.col("late_error") == CONFLICT, F.lit(2)).otherwise(F.lit(3))
    late = folded.filter("late_error is not null").select("file_path", F.struct(stage.alias("stage"), line.cast("long").alias("line"), F.col("late_error").alias("class")).alias("e"))
    return found.unionByName(late).groupBy("file_path").agg(F.min("e").alias("e")).select("file_path", F.col("e.class").alias("error"))


def ingest_sessions(warehouse: Warehouse, agent: str, roots: list[str], *, full_refresh: bool = False, refresh_metadata: bool = False, pattern: str = "*.jsonl", now: datetime | None = None) -> DataFrame:
    """Claude, Codex and Pi session logs into their tables.

    Files whose size and time are those of the last run are skipped; a file with a bad row is
    rejected as a whole and tried again next time. Changed files of one session are taken in
    path order, one round after another; usually one round does. Very many changed files are taken
    in groups, in path order, each stored before the next is read, so a run that dies has stored
    the groups before. A file without a session, a blank one too, is rejected. full_refresh ignores file states and checkpoints.
    refresh_metadata also derives session metadata of unchanged files anew.
    """
    spark, at = warehouse.spark, _now(now)
    states = scan.session_files(spark, roots, pattern)
    prior = warehouse.read(f"{agent}_ingestion_files").select(F.col("session_file_path").alias("file_path"), F.col("file_size_bytes").alias("file_size"), "file_mtime")
    changed = (states if full_refresh else incremental.changed_files(states, prior)).persist()
    counters = dict(_EMPTY, scanned=states.count())
    n_changed = changed.count()
    counters["unchanged"] = counters["scanned"] - n_changed
    if refresh_metadata and counters["unchanged"]:
        every = agents.FIELDS[agent](scan.json_lines(scan.lines(spark, roots, pattern=pattern)))
        _store_sessions(warehouse, agent, written(_parse(agent, every, roots).files.filter("identity_error is null"), f"{agent}-files"), at)
    if not n_changed:
        changed.unpersist()
        return _report(warehouse, agent, counters, at)
    for group in _grouped(changed, n_changed):
        for name, value in _ingest_group(warehouse, agent, group, roots, full_refresh, pattern, at).items():
            counters[name] += value
    changed.unpersist()
    return _report(warehouse, agent, counters, at)


def _ingest_group(warehouse: Warehouse, agent: str, changed: DataFrame, roots: list[str], full_refresh: bool, pattern: str, at: Column) -> dict[str, int]:
    """Counters of the files of one read group."""
    counters = dict.fromkeys(_EMPTY, 0)
    fields = _fields_of(warehouse.spark, agent, changed, pattern)
    files = written(_parse(agent, fields, roots, changed).files, f"{agent}-files")
    # a file without a session is a round of its own
    named = files.select("file_path", F.coalesce("session_id", "file_path").alias("session_id"))
    rounds = incremental.file_rounds(named, ["session_id"]).persist()
    last = rounds.agg(F.max("round")).first()[0]
    for n in range(1, last + 1):
        of_round = lambda df, n=n: df if last == 1 else df.join(rounds.filter(F.col("round") == n).select("file_path"), "file_path", "left_semi")
        for name, value in _ingest_round(warehouse, agent, of_round(fields), of_round(files), of_round(changed), roots, full_refresh, at).items():
            counters[name] += value
    rounds.unpersist()
    return counters


def _store_sessions(warehouse: Warehouse, agent: str, files: DataFrame, at: Column) -> None:
    warehouse.commit(changed={f"{agent}_session_metadata": _sessions(warehouse, agent, files, at)})


def _upserted(warehouse: Warehouse, name: str, rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """All rows of the buckets that the given rows fall in, with these in place of the stored ones of their keys."""
    table = TABLES[name]
    new = rows.select(*[f.name for f in table.schema])
    return incremental.upsert(warehouse.near(name, new), new, list(table.key), order, keep=table.keep)


def _sessions(warehouse: Warehouse, agent: str, files: DataFrame, at: Column) -> DataFrame:
    """Changed buckets of the session table after the given files; rows that didn't change keep their time."""
    name = f"{agent}_session_metadata"
    table = TABLES[name]
    values = [f.name for f in table.schema if f.name not in ("session_id", "ingested_at")]
    new = files.withColumn("session_file_path", F.col("file_path")).select("session_id", *values, at.alias("ingested_at"))
    return _upserted(warehouse, name, incremental.changed_rows(warehouse.near(name, new), new, ["session_id"], values), [F.desc("session_file_path")])


def _ingest_round(warehouse: Warehouse, agent: str, fields: DataFrame, files: DataFrame, states: DataFrame, roots: list[str], full_refresh: bool, at: Column) -> dict[str, int]:
    table, scope, key, inclusive = EVENTS[agent]
    # errors, counters and events are all read from the parsed rows
    parsed = Parsed(files, written(_parse(agent, fields, roots).rows, f"{agent}-rows"))
    identity = parsed.files.filter("identity_error is null")
    stored = _stored_of(warehouse, table, identity)
    rows = parsed.rows.filter("raw").join(identity.select("file_path", *scope), "file_path")
    known = stored.withColumnRenamed("agent_id", "scope_agent") if agent == "claude" else stored
    passing = rows if full_refresh else incremental.after_checkpoint(rows, incremental.checkpoints(known, scope, key), scope, key, inclusive=inclusive)
    passing = written(passing, f"{agent}-passing")
    folded = written(_checked(agent, passing), f"{agent}-folded")
    errors = written(_file_errors(parsed, passing, folded), f"{agent}-errors")
    good = folded.join(errors, "file_path", "left_anti")
    if agent == "codex":
        good = good.select("file_path", "line_number", "session_id", "event_timestamp", "model_code", "turn_id", "total_tokens_cumulative", "last.*", "duplicates")
    named = good.withColumns({"event_line_number": F.col("line_number"), "ingested_at": at})
    events = named.select(*[f.name for f in TABLES[table].schema], "file_path")
    fresh = incremental.insert_ignore(stored, events, list(TABLES[table].key), ["file_path"]).drop("file_path")
    done = identity.join(errors, "file_path", "left_anti")
    by_class = {r["error"]: r["n"] for r in errors.groupBy("error").agg(F.count("*").alias("n")).collect()}
    kept_files = done.select("file_path")
    raw_rows = parsed.rows.join(kept_files, "file_path", "left_semi")
    counted = raw_rows.agg(F.count_if("raw").alias("raw"), *[F.count_if(c).alias(c) for c in ("synthetic", "info_null") if c in raw_rows.columns]).first().asDict()
    new_rows = passing.join(kept_files, "file_path", "left_semi")
    folds = good.agg(F.count("*").alias("n"), F.sum("duplicates").alias("duplicates")).first()
    out = {
        "ingested": done.count(), "failed": sum(by_class.values()), "skipped": int(counted["raw"] or 0) - new_rows.count(), "duplicates": int(folds["duplicates"] or 0), "deduped": folds["n"],
        "monotonicity_errors": by_class.get(ORDER, 0), "delta_errors": by_class.get(DELTA, 0), **{k: int(v or 0) for k, v in counted.items()},
    }
    out["parse_errors"] = out["failed"] - out["monotonicity_errors"] - out["delta_errors"]
    seen = states.join(kept_files, "file_path", "left_semi").select(F.col("file_path").alias("session_file_path"), F.col("file_size").alias("file_size_bytes"), "file_mtime", at.alias("ingested_at"))
    warehouse.commit({table: fresh, f"{agent}_ingestion_files": seen}, changed={f"{agent}_session_metadata": _sessions(warehouse, agent, done, at)})
    return out


def ingest_opencode(warehouse: Warehouse, message: DataFrame, session: DataFrame, project: DataFrame, *, full_refresh: bool = False, now: datetime | None = None) -> DataFrame:
    """Messages newer than the last (time_updated, id) into the tables; changed ones replace stored rows.

    The run ends early if the source's latest time is behind the checkpoint, and fails before
    writing if a message is malformed.
    """
    at = _now(now)
    stored = warehouse.read("opencode_message_usage")
    # the largest time comes from file footers, and only row groups that hold it are read for the largest id
    latest = F.col("source_time_updated_ms") == F.lit(warehouse.largest("opencode_message_usage", "source_time_updated_ms"))
    cp = stored.filter(latest).agg(F.max(F.struct(F.col("source_time_updated_ms").alias("time_updated"), F.col("message_id").alias("id"))).alias("cp"))
    last = cp.first()["cp"]
    counters = {"fast_skip": 0, "rows": 0, "sessions": 0}
    assistant = F.get_json_object("data", "$.role") == "assistant"
    if not full_refresh and last is not None and message.filter(F.col("time_updated") >= last["time_updated"]).filter(assistant).isEmpty():
        return _report(warehouse, "opencode", dict(counters, fast_skip=1), at)
    new = message if full_refresh else incremental.after_checkpoint(message, cp, [], ["time_updated", "id"], inclusive=False)
    rows = agents.opencode(new, session, project).persist()
    if not (bad := rows.filter("error is not null")).isEmpty():
        raise ValueError(f"malformed message {bad.orderBy('message_id').first()['message_id']}")
    timed = rows.withColumns({"ingested_at": at, "updated_at": at})
    sessions = timed.dropDuplicates(["session_id"])
    changed = {
        "opencode_sessions": _upserted(warehouse, "opencode_sessions", sessions, ["project_id"]),
        "opencode_message_usage": _upserted(warehouse, "opencode_message_usage", timed, ["session_id"]),
    }
    counters |= {"rows": rows.count(), "sessions": sessions.count()}
    out = _report(warehouse, "opencode", counters, at, changed=changed)
    rows.unpersist()
    return out


def ingest_gemini(warehouse: Warehouse, paths: list[str], *, full_refresh: bool = False, pattern: str = "*", now: datetime | None = None) -> DataFrame:
    """Telemetry JSONL files, one per project, into events and the source registry. Any error fails the run before a write.

    The registry takes new projects, moved paths and inactive ones. A file whose largest
    (time, model) is behind its checkpoint was rewritten, which is an error.
    """
    from ..operators import registry

    spark, at = warehouse.spark, _now(now)
    sources = warehouse.read("gemini_ingestion_sources")
    states = scan.session_files(spark, paths, pattern).persist()
    # a file as it was at the last run still holds the project it is registered for: it isn't read
    gate = sources.select(F.col("jsonl_file_path").alias("file_path"), F.col("file_size_bytes").alias("file_size"), "file_mtime", "project_id")
    known = states.join(gate.filter("false") if full_refresh else gate, ["file_path", "file_size", "file_mtime"])
    wanted = states.join(known.select("file_path"), "file_path", "left_anti").persist()
    fields = reduce(DataFrame.unionByName, [_fields_of(spark, "gemini", g, pattern) for g in _grouped(wanted, wanted.count())])
    parsed = agents.gemini(None, fields=fields)
    read = wanted.join(parsed.files, "file_path", "left").withColumn("identity_error", F.when(F.col("project_id").isNull(), F.lit(agents.IDENTITY)))
    files = written(read.unionByName(known.withColumn("identity_error", F.lit(None).cast("string"))), "gemini-files")
    found = registry.reconcile(files.select("project_id", F.col("file_path").alias("path")), sources.select("project_id", F.col("jsonl_file_path").alias("path"), "active"))
    if not files.filter("identity_error is not null").isEmpty() or not found.filter(F.col("action").startswith("conflict")).isEmpty() or files.groupBy("project_id").count().filter("count > 1").count():
        raise ValueError("a file has no valid project line, or a path or project is registered elsewhere")
    was = sources.select("project_id", F.col("file_size_bytes").alias("was_size"), F.col("file_mtime").alias("was_mtime"), F.when(F.col("last_ingested_event_timestamp").isNotNull(), F.struct(F.col("last_ingested_event_timestamp").alias("event_timestamp"), F.col("last_ingested_model_code").alias("model_code"))).alias("cp"), "created_at")
    todo = files.join(was, "project_id", "left")
    same = (F.col("file_size") == F.col("was_size")) & (F.col("file_mtime") == F.col("was_mtime"))
    changed = todo if full_refresh else todo.filter(~F.coalesce(same, F.lit(False)))
    changed = written(changed, "gemini-changed")
    rows = written(parsed.rows.join(changed.select("file_path", "project_id", "cp"), "file_path"), "gemini-rows")
    passes = F.lit(True) if full_refresh else F.col("cp").isNull() | (F.struct("event_timestamp", "model_code") >= F.col("cp"))
    if not rows.filter(F.col("error_always").isNotNull() | (passes & F.col("error_if_new").isNotNull())).isEmpty():
        raise ValueError("malformed or duplicate usage event")
    largest = rows.filter("raw").groupBy("project_id").agg(F.max(F.struct("event_timestamp", "model_code")).alias("top"))
    progress = written(changed.join(largest, "project_id", "left"), "gemini-progress")
    if not full_refresh and not progress.filter("cp is not null and (top is null or top < cp)").isEmpty():
        raise ValueError("a log was rewritten: its last event is behind the checkpoint")
    stored = warehouse.read("gemini_usage_events")
    new = rows.filter(F.col("raw") & passes)
    events = new.withColumn("ingested_at", at).select(*[f.name for f in TABLES["gemini_usage_events"].schema])
    fresh = incremental.insert_ignore(stored, events, list(TABLES["gemini_usage_events"].key), ["total_tokens"])
    top = incremental.next_checkpoint(F.col("cp"), F.col("top"))
    state = progress.select("project_id", F.col("file_path").alias("jsonl_file_path"), F.lit(True).alias("active"), F.col("file_size").alias("file_size_bytes"), "file_mtime", top["event_timestamp"].alias("last_ingested_event_timestamp"), top["model_code"].alias("last_ingested_model_code"), at.alias("created_at"), at.alias("updated_at"))
    counters = {"files": files.count(), "unchanged": files.count() - changed.count(), "total": rows.filter("raw").count(), "attempted": new.count()}
    counters["skipped"] = counters["total"] - counters["attempted"]
    out = _report(warehouse, "gemini", counters, at, {"gemini_usage_events": fresh}, {"gemini_ingestion_sources": _upserted(warehouse, "gemini_ingestion_sources", state, ["jsonl_file_path"])})
    for df in (states, wanted):
        df.unpersist()
    return out
