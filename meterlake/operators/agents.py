"""Log lines of each agent to usage rows with their errors (FLT, PRJ, META, VAL, FN-07..11, JOIN-02/09).

Each parser takes `sources.lines.json_lines` and gives two tables. Files: file_path, session
columns, identity_error. Rows: file_path, line_number, event columns, counters, `raw` (the row
counts as a usage row) and two error classes: `error_always` rejects the file whether or not
the row is new, `error_if_new` only if it passes the checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.strict_json import given, opened, optional_number, optional_text, optional_whole, required_whole, text, whole
from ..functions.times import iso_instant

SYNTHETIC = "<synthetic>"
PARSE, IDENTITY, MODEL, CONFLICT, ORDER, DELTA = "parse", "identity", "model", "conflict", "monotonicity", "delta"


@dataclass
class Parsed:
    files: DataFrame
    rows: DataFrame


def _first(value: Column) -> Column:
    """First non-null value of a file."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_number")))


def _errors(*errors: Column, kind_of_error: str = PARSE) -> Column:
    wrong = reduce(lambda a, b: a | b, [e.isNotNull() for e in errors])
    return F.when(wrong, F.lit(kind_of_error))


#: Fields of the lines that the parsers look at, by agent.
_SNAPSHOT = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
_COSTS = ("input", "output", "cacheRead", "cacheWrite", "total")
_GEMINI_COUNTERS = {"input_tokens": "input_token_count", "cached_input_tokens": "cached_content_token_count", "output_tokens": "output_token_count", "thoughts_tokens": "thoughts_token_count", "total_tokens": "total_token_count"}


def _tree(*names: str, **opened_names: dict) -> dict:
    return dict.fromkeys(names) | opened_names


def claude_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of Claude lines, for `claude`; one pass over each line."""
    usage = _tree("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    tree = _tree("type", "sessionId", "agentId", "slug", "cwd", "version", "timestamp", "requestId", "speed", "isSidechain", message=_tree("id", "model", "stop_reason", usage=usage))
    rows = opened(lines.select("file_path", "line_number", "malformed", "v"), "v", tree)
    value = lambda c: text(F.col(c), "$")
    return rows.select(
        "file_path", "line_number", "malformed", value("type").alias("type"), F.nullif(value("sessionId"), F.lit("")).alias("session_id"), value("agentId").alias("agent_id"),
        *[value(c).alias(c) for c in ("slug", "cwd", "version", "speed")], value("timestamp").alias("stamp"), value("requestId").alias("request_id"), value("message.id").alias("message_id"),
        F.nullif(value("message.model"), F.lit("")).alias("model"), F.coalesce(F.try_variant_get("isSidechain", "$", "boolean"), F.lit(False)).alias("is_sidechain"),
        given(F.col("message.stop_reason"), "$").alias("is_final"), F.col("message.usage").isNotNull().alias("has_usage"), *[whole(F.col(f"message.usage.{c}"), "$", booleans=True).alias(c) for c in usage],
    )


def claude(lines: DataFrame | None, roots: list[str], *, fields: DataFrame | None = None) -> Parsed:
    """`fields`: what `claude_fields` gives for the lines, where it is stored already; so in all parsers."""
    lines = claude_fields(lines) if fields is None else fields
    session, model = F.col("session_id"), F.col("model")
    files = lines.groupBy("file_path").agg(
        _first(session).alias("session_id"), F.min_by("agent_id", F.when(session.isNotNull(), F.col("line_number"))).alias("scope_agent"),
        *[_first(F.col(c)).alias(c) for c in ("slug", "cwd", "version")],
    )
    files = files.withColumns({"project_name": names.project_name(F.col("file_path"), roots), "identity_error": F.when(F.col("session_id").isNull(), F.lit(IDENTITY))})
    candidate = (F.col("type") == "assistant") & F.col("has_usage") & model.isNotNull()
    synthetic = candidate & (model == SYNTHETIC)
    counted = candidate & (model != SYNTHETIC) & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    stamp = iso_instant(F.col("stamp"))
    zero = F.lit(0).cast("long")
    rows = lines.filter(F.col("malformed") | synthetic | counted).select(
        "file_path", "line_number", F.coalesce(synthetic, F.lit(False)).alias("synthetic"), F.coalesce(counted, F.lit(False)).alias("raw"),
        "message_id", "request_id", stamp.alias("event_timestamp"), names.with_speed(model, F.col("speed")).alias("model_code"), "is_sidechain", "agent_id", "input_tokens", "output_tokens",
        *[F.coalesce(c, zero).alias(c) for c in ("cache_creation_input_tokens", "cache_read_input_tokens")], "is_final",
        F.when(F.col("malformed"), F.lit(PARSE)).when(counted & (F.col("message_id").isNull() | F.col("request_id").isNull() | stamp.isNull()), F.lit(PARSE)).alias("error_always"),
        F.lit(None).cast("string").alias("error_if_new"),
    )
    return Parsed(files, rows)


def codex_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of Codex lines, for `codex`; of other lines than session, turn and token lines only what places them is left."""
    snapshots = {s: dict.fromkeys(_SNAPSHOT) for s in ("total_token_usage", "last_token_usage")}
    payload = _tree("type", "id", "timestamp", "cwd", "model", "turn_id", "info")
    rows = opened(lines.select("file_path", "line_number", "malformed", "v"), "v", _tree("type", "timestamp", payload=payload))
    # an info that is null or not there is told from one that is no object
    rows = opened(rows.withColumns({"info": F.col("payload.info"), "has_info": given(F.col("payload.info"), "$")}), "info", snapshots)
    value = lambda c: text(F.col(c), "$")
    all_of = lambda parts: reduce(lambda a, b: a & b, parts)
    snapshot = lambda s: F.struct(*[whole(F.col(f"{s}.{f}"), "$", booleans=True).alias(f) for f in _SNAPSHOT])
    there = all_of([F.col(f"{s}.{f}").isNotNull() for s in snapshots for f in _SNAPSHOT])
    bad = ~all_of([F.col(f"{s}.{f}").isNull() | whole(F.col(f"{s}.{f}"), "$", booleans=True).isNotNull() for s in snapshots for f in _SNAPSHOT])
    model, turn = F.col("payload.model"), F.col("payload.turn_id")
    return rows.select(
        "file_path", "line_number", "malformed", value("type").alias("type"), value("timestamp").alias("stamp"), F.col("payload").isNotNull().alias("has_payload"), value("payload.type").alias("payload_type"),
        value("payload.id").alias("id"), value("payload.timestamp").alias("payload_stamp"), value("payload.cwd").alias("cwd"), value("payload.model").alias("model"), model.isNotNull().alias("has_model"),
        F.coalesce(F.schema_of_variant(model).isin("STRING", "VOID"), F.lit(False)).alias("model_is_text"), value("payload.turn_id").alias("turn"), given(turn, "$").alias("has_turn"), "has_info",
        F.coalesce(F.col("total_token_usage").isNotNull() | F.col("last_token_usage").isNotNull() | F.schema_of_variant("payload.info").startswith("OBJECT"), F.lit(False)).alias("info_is_object"),
        F.coalesce(there, F.lit(False)).alias("complete"), F.coalesce(bad, F.lit(False)).alias("bad_counter"), snapshot("total_token_usage").alias("total"), snapshot("last_token_usage").alias("last"),
    )


def codex(lines: DataFrame | None, *, fields: DataFrame | None = None) -> Parsed:
    lines = codex_fields(lines) if fields is None else fields
    kind_of = F.col("type")
    is_meta, is_turn = F.coalesce(kind_of == "session_meta", F.lit(False)), F.coalesce(kind_of == "turn_context", F.lit(False))
    is_token = F.coalesce((kind_of == "event_msg") & (F.col("payload_type") == "token_count"), F.lit(False))
    meta = F.when(is_meta, F.struct(names.uuid_text(F.col("id")).alias("session_id"), iso_instant(F.coalesce("payload_stamp", "stamp")).alias("session_timestamp"), "cwd"))
    files = lines.groupBy("file_path").agg(F.min_by(meta, F.when(is_meta, F.col("line_number"))).alias("m"))
    files = files.select("file_path", "m.session_id", "m.session_timestamp", "m.cwd", F.when(F.col("m.session_id").isNull(), F.lit(IDENTITY)).alias("identity_error"))
    rows = lines.filter(F.col("malformed") | is_meta | is_turn | is_token)
    rows = rows.withColumns({"is_turn": is_turn, "is_token": is_token, "turn_uuid": F.when(is_turn, names.uuid_text(F.col("turn")))})
    above = Window.partitionBy("file_path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    sets_model = F.col("is_turn") & F.col("has_model")
    model = F.last(F.when(sets_model, F.struct(F.col("model").alias("x"))), ignorenulls=True).over(above)["x"]
    turn = F.last(F.when(F.col("is_turn"), F.struct(F.col("turn_uuid").alias("x"))), ignorenulls=True).over(above)["x"]
    rows = rows.withColumns({"model_code": model, "turn_id": turn})
    info_null = F.col("is_token") & ~F.col("has_info")
    stamp = iso_instant(F.col("stamp"))
    raw = F.col("is_token") & ~info_null & F.col("complete")
    bad_model = sets_model & ~F.col("model_is_text")
    bad_turn = F.col("is_turn") & F.col("has_turn") & F.col("turn_uuid").isNull()
    error = (
        F.when(F.col("malformed"), PARSE)
        .when(F.col("is_turn") & (~F.col("has_payload") | bad_model | bad_turn), PARSE)
        .when(F.col("is_token") & ~info_null & (~F.col("info_is_object") | F.col("bad_counter")), PARSE)
        .when(raw & F.col("model_code").isNull(), MODEL)
        .when(raw & stamp.isNull(), PARSE)
    )
    out = rows.select("file_path", "line_number", raw.alias("raw"), info_null.alias("info_null"), stamp.alias("event_timestamp"), "model_code", "turn_id", "total", "last", error.alias("error_always"), F.lit(None).cast("string").alias("error_if_new"))
    return Parsed(files, out.withColumn("total_tokens_cumulative", F.col("total.total_tokens")))


def pi_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of Pi lines, for `pi`."""
    usage = _tree("input", "output", "cacheRead", "cacheWrite", "totalTokens", "cost")
    rows = opened(lines.select("file_path", "line_number", "malformed", "v"), "v", _tree("type", "id", "version", "timestamp", "cwd", "parentId", message=_tree("role", "provider", "model", "stopReason", usage=usage)))
    # a cost that is null or not there is told from one that is no object
    cost = F.col("message.usage.cost")
    rows = opened(rows.withColumns({"cost": cost, "odd_cost": given(cost, "$") & ~F.schema_of_variant(cost).startswith("OBJECT")}), "cost", {c: None for c in _COSTS})
    value = lambda c: text(F.col(c), "$")
    u = lambda c: F.col(f"message.usage.{c}")
    i, e1 = required_whole(u("input"), "$", "input")
    o, e2 = required_whole(u("output"), "$", "output")
    r, e3 = optional_whole(u("cacheRead"), "$", "cacheRead", 0)
    w, e4 = optional_whole(u("cacheWrite"), "$", "cacheWrite", 0)
    t, e5 = optional_whole(u("totalTokens"), "$", "totalTokens")
    costs = {n: optional_number(F.col(k), "$", k) for n, k in zip(("input", "output", "cache_read", "cache_write", "total"), _COSTS, strict=True)}
    texts = {n: optional_text(F.col(c), "$", n) for n, c in (("parent_id", "parentId"), ("provider_code", "message.provider"), ("model_code", "message.model"), ("stop_reason", "message.stopReason"))}
    bad_cost = F.when(F.coalesce("odd_cost", F.lit(False)), F.lit("cost"))
    counted = (F.col("line_number") > 1) & (value("type") == "message") & (value("message.role") == "assistant") & F.col("message.usage").isNotNull() & u("input").isNotNull() & u("output").isNotNull()
    return rows.select(
        "file_path", "line_number", "malformed", value("type").alias("type"), F.nullif(value("id"), F.lit("")).alias("id"), value("timestamp").alias("stamp"), whole(F.col("version"), "$").alias("version"), F.nullif(value("cwd"), F.lit("")).alias("cwd"),
        F.coalesce(counted, F.lit(False)).alias("raw"), *[c.alias(n) for n, (c, _) in texts.items()], i.alias("input_tokens"), o.alias("output_tokens"), r.alias("cache_read_tokens"), w.alias("cache_write_tokens"), t.alias("total_tokens"),
        *[c.alias(f"pi_reported_cost_{n}_usd") for n, (c, _) in costs.items()], _errors(e1, e2, e3, e4, e5).alias("bad_counter"), _errors(bad_cost, *[e for _, e in (*costs.values(), *texts.values())]).alias("bad_field"),
    )


def pi(lines: DataFrame | None, *, fields: DataFrame | None = None) -> Parsed:
    lines, path = pi_fields(lines) if fields is None else fields, F.col("file_path")
    first = lines.groupBy("file_path").agg(F.min_by(F.struct("type", "id", "version", "stamp", "cwd", "malformed"), "line_number").alias("f"))
    session, started, version = F.col("f.id"), iso_instant(F.col("f.stamp")), F.col("f.version")
    named, cwd = names.session_id_from_file(path), F.coalesce("f.cwd", names.cwd_from_parent(path))
    good = ~F.col("f.malformed") & (F.col("f.type") == "session") & session.isNotNull() & version.isNotNull() & started.isNotNull() & cwd.isNotNull() & F.coalesce(named == session, F.lit(True))
    files = first.select("file_path", session.alias("session_id"), version.cast("int").alias("session_version"), cwd.alias("cwd"), started.alias("session_started_at"), F.when(~F.coalesce(good, F.lit(False)), F.lit(PARSE)).alias("identity_error"))
    stamp, counted = iso_instant(F.col("stamp")), F.col("raw")
    always = F.when(F.col("id").isNull() | stamp.isNull(), F.lit(PARSE)).otherwise(F.col("bad_counter"))
    rows = lines.filter(F.col("malformed") | counted).select(
        "file_path", "line_number", "raw", F.col("id").alias("message_id"), stamp.alias("event_timestamp"), "parent_id", "provider_code", "model_code", "stop_reason",
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", *[f"pi_reported_cost_{n}_usd" for n in ("input", "output", "cache_read", "cache_write", "total")],
        F.when(F.col("malformed"), F.lit(PARSE)).when(counted, always).alias("error_always"), F.when(counted, F.col("bad_field")).alias("error_if_new"),
    )
    twice = F.col("raw") & (F.row_number().over(Window.partitionBy("file_path", "message_id").orderBy("line_number")) > 1) & F.col("message_id").isNotNull()
    return Parsed(files, rows.withColumn("error_always", F.coalesce("error_always", F.when(twice, F.lit(PARSE)))))


def gemini_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of Gemini lines, for `gemini`."""
    rows = opened(lines.select("file_path", "line_number", "malformed", "v"), "v", _tree("project_id", "record_type", "schema_version", attributes=_tree("event.name", "event.timestamp", "model", *_GEMINI_COUNTERS.values())))
    a = lambda c: F.col(f"attributes.`{c}`")
    value = lambda c: text(F.col(c) if isinstance(c, str) else c, "$")
    counters = {n: required_whole(a(k), "$", k) for n, k in _GEMINI_COUNTERS.items()}
    counted = (F.col("line_number") > 1) & (value(a("event.name")) == "gemini_cli.api_response")
    return rows.select(
        "file_path", "line_number", "malformed", value("project_id").alias("project"), value("record_type").alias("record_type"), whole(F.col("schema_version"), "$").alias("schema_version"),
        F.coalesce(counted, F.lit(False)).alias("raw"), value(a("event.timestamp")).alias("stamp"), F.nullif(value(a("model")), F.lit("")).alias("model_code"), *[c.alias(n) for n, (c, _) in counters.items()], _errors(*[e for _, e in counters.values()]).alias("bad_counter"),
    )


def gemini(lines: DataFrame | None, *, fields: DataFrame | None = None) -> Parsed:
    """Line 1 holds the project; all else API responses. Any error is an error of the run."""
    lines = gemini_fields(lines) if fields is None else fields
    project = names.uuid_text(F.col("project"))
    good = (F.col("record_type") == "gemini_cli.project_metadata") & (F.col("schema_version") == 1) & project.isNotNull()
    files = lines.groupBy("file_path").agg(F.max(F.when((F.col("line_number") == 1) & good, project)).alias("project_id"))
    files = files.withColumn("identity_error", F.when(F.col("project_id").isNull(), F.lit(IDENTITY)))
    counted, stamp = F.col("raw"), iso_instant(F.col("stamp"))
    rows = lines.filter(((F.col("line_number") > 1) & F.col("malformed")) | counted).select(
        "file_path", "line_number", "raw", stamp.alias("event_timestamp"), "model_code", *_GEMINI_COUNTERS,
        F.when(F.col("malformed"), F.lit(PARSE)).when(counted & (stamp.isNull() | F.col("model_code").isNull()), F.lit(PARSE)).alias("error_always"), F.when(counted, F.col("bad_counter")).alias("error_if_new"),
    )
    again = F.col("raw") & (F.row_number().over(Window.partitionBy("file_path", "event_timestamp", "model_code").orderBy("line_number")) > 1)
    return Parsed(files, rows.withColumn("error_always", F.coalesce("error_always", F.when(again, F.lit(CONFLICT)))))


def opencode(message: DataFrame, session: DataFrame, project: DataFrame) -> DataFrame:
    """Assistant messages with their session and project, columns of both warehouse tables and `error`.

    A missing session title, directory or version becomes the text None, as in the store's exports.
    """
    v = F.try_parse_json(F.col("data"))
    s = session.select(F.col("id").alias("session_id"), "project_id", *[F.coalesce(F.col(c), F.lit("None")).alias(f"session_{c}") for c in ("title", "directory", "version")])
    p = project.select(F.col("id").alias("project_id"), F.col("worktree").alias("project_worktree"))
    rows = message.filter(F.get_json_object("data", "$.role") == "assistant").join(s, "session_id").join(p, "project_id")
    required = {n: required_whole(v, f"$.tokens.{k}", k) for n, k in (("input_tokens", "input"), ("output_tokens", "output"), ("reasoning_tokens", "reasoning"), ("cache_read_tokens", "cache.read"), ("cache_write_tokens", "cache.write"))}
    total, e_total = optional_whole(v, "$.tokens.total", "total")
    cost, e_cost = optional_number(v, "$.cost", "cost")
    done, e_done = optional_whole(v, "$.time.completed", "completed")
    texts = {n: optional_text(v, f"$.{k}", k) for n, k in (("provider_code", "providerID"), ("model_code", "modelID"), ("agent", "agent"), ("mode", "mode"), ("finish_reason", "finish"))}
    return rows.select(
        F.col("id").alias("message_id"), "session_id", "project_id", "project_worktree", "session_title", "session_directory", "session_version",
        F.timestamp_millis("time_created").alias("message_created_at"), F.timestamp_millis(done).alias("message_completed_at"), *[c.alias(n) for n, (c, _) in (*texts.items(), *required.items())],
        total.alias("total_tokens"), cost.alias("cost_usd"), F.col("time_updated").alias("source_time_updated_ms"),
        _errors(*[e for _, e in (*required.values(), *texts.values())], e_total, e_cost, e_done).alias("error"),
    )


#: What takes the fields of a parser from parsed lines, by agent.
FIELDS = {"claude": claude_fields, "codex": codex_fields, "pi": pi_fields, "gemini": gemini_fields}
