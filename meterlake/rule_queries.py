"""Queries that show single rules of the parsers and of runs: what is dropped, what fails, what a refresh does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures, views
from .agent_queries import _fails, _found, _union, _user_of_path
from .operators import agents
from .plans.ingest import ingest_gemini, ingest_opencode, ingest_sessions
from .sources import lines as scan
from .sources.scratch import scratch_folder
from .sources.warehouse import Warehouse

ORDER = ["event_id", "n"]


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    return fixtures.write_logs(rows, scratch_folder(spark, name), ORDER)


def claude_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claude lines of synthetic models (counted, no usage) and fast ones, by project; logs of odd users are under no known root."""
    event, user = F.col("event_id"), F.col("user_id")
    usage = views.usage(spark, sf_dir).filter("model_code is not null")
    lines = fixtures.claude_lines(usage.withColumn("model_code", F.when(event % 13 == 0, agents.SYNTHETIC).otherwise(F.col("model_code"))))
    lines = lines.withColumn("value", F.when(event % 6 == 1, F.regexp_replace("value", "^\\{", '{"speed":"fast",')).otherwise(F.col("value")))
    known, other = _written(spark, lines.filter(user % 2 == 0), "claude-known"), _written(spark, lines.filter(user % 2 == 1), "claude-other")
    parsed = agents.claude(scan.json_lines(scan.lines(spark, [known, other], pattern="*.txt")), [known])
    rows = parsed.rows.join(parsed.files.select("file_path", "project_name"), "file_path")
    return rows.groupBy("project_name", "model_code").agg(F.count_if("raw").alias("raw"), F.count_if("synthetic").alias("synthetic"), F.sum(F.when(F.col("raw"), F.col("output_tokens"))).alias("output_tokens"))


def codex_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codex token counts without info (counted), with a snapshot that lacks a counter (dropped), and with a counter that is text (an error)."""
    event, value = F.col("event_id"), F.col("value")
    lines = fixtures.codex_lines(spark, sf_dir).filter(value != "{broken")
    odd = (
        F.when(event % 5 == 0, F.regexp_replace(value, '"info":.*$', '"info":null}}'))
        .when(event % 11 == 0, F.regexp_replace(value, '"last_token_usage":\\{"input_tokens":[0-9]+,', '"last_token_usage":{'))
        .when(event % 17 == 0, F.regexp_replace(value, '"total_token_usage":\\{"input_tokens":[0-9]+', '"total_token_usage":{"input_tokens":"x"'))
        .otherwise(value)
    )
    path = _written(spark, lines.withColumn("value", odd), "codex-odd")
    rows = agents.codex(scan.json_lines(scan.lines(spark, [path], pattern="*.txt"))).rows
    return rows.groupBy(_user_of_path()).agg(F.count_if("raw").alias("raw"), F.count_if("info_null").alias("info_null"), F.count_if(F.col("error_always").isNotNull()).alias("errors"))


def pi_session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pi sessions by the names of file and directory, and errors that count before and after the checkpoint.

    Users 1 (mod 5): the file is named for another session; 2: no directory in the head, so
    that of the path; 3: a name without an id; 4: no directory anywhere.
    """
    user = F.col("user_id")
    lines = fixtures.pi_lines(spark, sf_dir)
    bare = (F.col("event_id") == -1) & (user % 5).isin(2, 4)
    path = _written(spark, lines.withColumn("value", F.when(bare, F.regexp_replace("value", ',"cwd":"/work"', "")).otherwise(F.col("value"))), "pi-names")
    read = scan.json_lines(scan.lines(spark, [path], pattern="*.txt"))
    kind, u = _user_of_path() % 5, _user_of_path().cast("string")
    parent = F.when(kind == 4, F.concat(F.lit("/logs/u"), u)).otherwise(F.concat(F.lit("/logs/--work-u"), u, F.lit("--")))
    file = F.when(kind == 1, F.concat(F.lit("/u"), u, F.lit("_other.jsonl"))).when(kind == 3, F.concat(F.lit("/u"), u, F.lit(".jsonl"))).otherwise(F.concat(F.lit("/u"), u, F.lit("_p"), u, F.lit(".jsonl")))
    parsed = agents.pi(read.withColumn("file_path", F.concat(parent, file)))
    rows = parsed.rows.groupBy("file_path").agg(F.count_if("raw").alias("raw"), F.count_if(F.col("error_always").isNotNull()).alias("error_always"), F.count_if(F.col("error_if_new").isNotNull()).alias("error_if_new"))
    named = parsed.files.select("file_path", "session_id", "cwd", "session_version", F.col("identity_error").isNotNull().alias("rejected"))
    return named.join(rows, "file_path").drop("file_path")


def opencode_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of OpenCode messages; a title, directory or version that is missing becomes the text None, a worktree stays null."""
    message, session, project = fixtures.opencode_tables(spark, sf_dir, late=True)
    s, p = F.substring("id", 2, 9).cast("long"), F.substring("id", 2, 9).cast("long")
    session = session.withColumns({"title": F.when(s % 3 != 0, F.col("title")), "version": F.when(s % 2 != 0, F.col("version"))})
    project = project.withColumn("worktree", F.when(p % 2 != 0, F.col("worktree")))
    columns = ("session_id", "project_id", "project_worktree", "session_title", "session_directory", "session_version")
    return agents.opencode(message, session, project).groupBy(*columns).agg(F.count("*").alias("n"))


def opencode_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh from an older store: its messages replace the stored ones, later messages stay."""
    warehouse = Warehouse(spark, scratch_folder(spark, "opencode"))
    runs = [ingest_opencode(warehouse, *fixtures.opencode_tables(spark, sf_dir, late=late), full_refresh=not late) for late in (True, False)]
    return _found("opencode", warehouse, runs)


def pi_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, a refresh of session metadata that had changed in the warehouse, a full refresh, and the events compacted."""
    warehouse, logs = Warehouse(spark, scratch_folder(spark, "pi")), _written(spark, fixtures.pi_lines(spark, sf_dir), "pi-logs")
    run = lambda **how: ingest_sessions(warehouse, "pi", [logs], pattern="*.txt", **how)
    runs = [run()]
    warehouse.commit(snapshots={"pi_session_metadata": warehouse.read("pi_session_metadata").withColumn("cwd", F.lit("/old"))})
    runs.append(run(refresh_metadata=True))
    cwd = warehouse.read("pi_session_metadata").groupBy("cwd").agg(F.count("*").alias("value"))
    runs.append(run(full_refresh=True))
    warehouse.compact("pi_usage_events", 2, ["event_timestamp"])
    few = spark.createDataFrame([(int(len(warehouse.read("pi_usage_events").inputFiles()) <= 2),)], "value long")
    none = F.lit(None).cast("long").alias("tokens")
    part = lambda name, n, df, label: df.select(F.lit(name).alias("part"), F.lit(n).alias("run"), label.alias("name"), "value", none)
    return _union([_found("pi", warehouse, runs), part("cwd", 2, cwd, F.col("cwd")), part("compacted", 4, few, F.lit("at most two files"))])


def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, failed, stored): runs that end in an error, and the events stored after each, which a failed run leaves alone.

    A Gemini log that ends before its checkpoint fails; a counter that is text fails if its
    event isn't behind the checkpoint; so does a project line of another schema version, and
    an OpenCode message with a malformed counter.
    """
    gemini, opencode = Warehouse(spark, scratch_folder(spark, "gemini")), Warehouse(spark, scratch_folder(spark, "opencode"))
    event, value = F.col("event_id"), F.col("value")
    lines = fixtures.gemini_lines(spark, sf_dir)
    cut = (lines.agg(F.max("event_id")).first()[0] or 0) * fixtures.EARLIER // 10
    top = F.max(F.when(value.contains("api_response"), F.struct(F.regexp_extract(value, '"event.timestamp":"([^"]*)"', 1), F.regexp_extract(value, '"model":"([^"]*)"', 1), event))).over(Window.partitionBy("user_id"))
    is_top = F.coalesce(top["event_id"] == event, F.lit(False))
    text = F.regexp_replace(value, '"input_token_count":[0-9]+', '"input_token_count":"x"')
    ranked = lines.withColumn("is_top", is_top)
    steps = {
        "all lines": lines,
        "earlier lines": lines.filter(event < cut),
        "text before the checkpoint": ranked.withColumn("value", F.when(~F.col("is_top") & (event % 50 == 3), text).otherwise(value)),
        "text at the checkpoint": ranked.withColumn("value", F.when(F.col("is_top"), text).otherwise(value)),
        "schema version": lines.withColumn("value", F.regexp_replace("value", '"schema_version":1', '"schema_version":2')),
    }
    errors = {"earlier lines": "a log was rewritten", "text at the checkpoint": "malformed or duplicate usage event", "schema version": "no valid project line"}
    found = []
    for step, rows in steps.items():
        path = _written(spark, rows.select("user_id", "event_id", "n", "value"), "gemini-logs")
        failed = _fails(lambda path=path: ingest_gemini(gemini, [path], pattern="*.txt"), errors.get(step, "no error is expected"))
        found.append((step, int(failed), gemini.read("gemini_usage_events").count()))
    message, session, project = fixtures.opencode_tables(spark, sf_dir, late=True)
    broken = message.withColumn("data", F.regexp_replace("data", '"input":[0-9]*7,', '"input":true,'))
    failed = _fails(lambda: ingest_opencode(opencode, broken, session, project), "malformed message")
    found.append(("message", int(failed), opencode.read("opencode_message_usage").count()))
    return spark.createDataFrame(found, "step string, failed int, stored long")


QUERIES = {f.__name__: f for f in (claude_line_rules, codex_line_rules, pi_session_identity, opencode_session_rows, opencode_full_refresh, pi_refresh, failed_runs)}
