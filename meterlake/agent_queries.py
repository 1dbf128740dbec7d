"""Queries that write logs and stores of each agent from the tables, ingest or scan them, and return what came of it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, views
from .functions.cost import event_cost
from .functions.prices import flatten_prices, load_price_text, with_prices
from .operators import simplify, sinks, stats
from .plans import analysis
from .plans.ingest import ingest_gemini, ingest_opencode, ingest_sessions
from .sources import lines as scan
from .sources.scratch import scratch_folder
from .sources.warehouse import Warehouse, usage_events
from .views import table

#: Events that a second log repeats of the first.
OVERLAP = 200
LEAST_DAY = date(2024, 1, 10)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _found(agent: str, warehouse: Warehouse, runs: list[DataFrame]) -> DataFrame:
    """(part, run, name, value, tokens): counters of each run, and per session the events and tokens that are stored."""
    none = F.lit(None).cast("long")
    counters = [r.select(F.lit("counter").alias("part"), F.lit(n).alias("run"), F.col("counter").alias("name"), "value", none.alias("tokens")) for n, r in enumerate(runs, 1)]
    total = sum((F.col(c) for c in ("cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")), F.col("input_tokens"))
    stored = usage_events(warehouse, agent).groupBy("session_id").agg(F.count("*").alias("value"), F.sum(total).alias("tokens"))
    return _union([*counters, stored.select(F.lit("session").alias("part"), F.lit(0).alias("run"), F.col("session_id").alias("name"), "value", "tokens")])


def _report(warehouse: Warehouse, agent: str, spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    return stats.usage_by(stats.priced_events(usage_events(warehouse, agent), views.prices(spark), agent, zone="UTC"), *keys)


def _claude(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, list[DataFrame]]:
    """Three runs over Claude logs: the earlier events, the same again, and new logs of the rest with some events repeated."""
    logs, warehouse = scratch_folder(spark, "claude-logs"), Warehouse(spark, scratch_folder(spark, "claude"))
    usage = views.usage(spark, sf_dir)
    top = usage.agg(F.max("event_id")).first()[0] or 0
    cut = top * fixtures.EARLIER // 10
    lines = fixtures.claude_lines(usage.filter("model_code is not null"))
    broken = lines.filter("n = 0 and user_id % 20 = 13 and event_id % 40 = 5").withColumns({"n": F.lit(2), "value": F.lit("{broken")})
    lines = lines.unionByName(broken)
    fixtures.blank_log(spark, logs)
    fixtures.write_logs(lines.filter(F.col("event_id") < cut), logs, ["event_id", "n"])
    runs = [ingest_sessions(warehouse, "claude", [logs], pattern="*.txt") for _ in range(2)]
    fixtures.write_logs(lines.filter(F.col("event_id") >= cut - OVERLAP), logs, ["event_id", "n"])
    return warehouse, [*runs, ingest_sessions(warehouse, "claude", [logs], pattern="*.txt")]


def claude_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found("claude", *_claude(spark, sf_dir))


def _codex(spark: SparkSession, sf_dir: str, runs: int = 2) -> tuple[Warehouse, list[DataFrame]]:
    logs, warehouse = scratch_folder(spark, "codex-logs"), Warehouse(spark, scratch_folder(spark, "codex"))
    fixtures.blank_log(spark, logs)
    fixtures.write_logs(fixtures.codex_lines(spark, sf_dir), logs, ["event_id", "n"])
    return warehouse, [ingest_sessions(warehouse, "codex", [logs], pattern="*.txt") for _ in range(runs)]


def codex_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with every class of error, ingested twice: rejected files are tried again."""
    return _found("codex", *_codex(spark, sf_dir))


def codex_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_codex(spark, sf_dir, 1)[0], "codex", spark, ("day", "model_code"))


def _pi(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, list[DataFrame]]:
    """Two runs over Pi logs: earlier events, then logs of the rest with some repeated.

    The later logs lie in a later folder: files of a session are taken in path order, and an earlier log that was rejected
    has to be tried again before the later one has moved the checkpoint over its fault.
    """
    logs, warehouse = scratch_folder(spark, "pi-logs"), Warehouse(spark, scratch_folder(spark, "pi"))
    lines = fixtures.pi_lines(spark, sf_dir)
    cut = (lines.agg(F.max("event_id")).first()[0] or 0) * fixtures.EARLIER // 10
    fixtures.blank_log(spark, logs)
    runs = []
    for n, part in enumerate((F.col("event_id") < cut, (F.col("event_id") >= cut - OVERLAP) | (F.col("event_id") == -1)), 1):
        fixtures.write_logs(lines.filter(part), f"{logs}/{n}", ["event_id", "n"])
        runs.append(ingest_sessions(warehouse, "pi", [logs], pattern="*.txt"))
    return warehouse, runs


def pi_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found("pi", *_pi(spark, sf_dir))


def pi_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_pi(spark, sf_dir)[0], "pi", spark, ("day", "provider_code", "model_code"))


def _gemini(spark: SparkSession, sf_dir: str, runs: int = 3) -> tuple[Warehouse, list[DataFrame]]:
    """Up to three runs over Gemini files: earlier events, all events in files that have moved, and the same again."""
    warehouse, lines = Warehouse(spark, scratch_folder(spark, "gemini")), fixtures.gemini_lines(spark, sf_dir)
    cut = (lines.agg(F.max("event_id")).first()[0] or 0) * fixtures.EARLIER // 10
    first = fixtures.write_logs(lines.filter(F.col("event_id") < cut), scratch_folder(spark, "gemini-logs"), ["event_id", "n"])
    moved = fixtures.write_logs(lines, scratch_folder(spark, "gemini-logs"), ["event_id", "n"])
    return warehouse, [ingest_gemini(warehouse, [path], pattern="*.txt") for path in (first, moved, moved)[:runs]]


def gemini_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found("gemini", *_gemini(spark, sf_dir))


def gemini_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_gemini(spark, sf_dir, 2)[0], "gemini", spark, ("day", "model_code"))


def _opencode(spark: SparkSession, sf_dir: str, runs: int = 3) -> tuple[Warehouse, list[DataFrame]]:
    """Up to three runs over OpenCode tables: the earlier messages, all with some updated, and a store that is behind."""
    warehouse = Warehouse(spark, scratch_folder(spark, "opencode"))
    return warehouse, [ingest_opencode(warehouse, *fixtures.opencode_tables(spark, sf_dir, late=late)) for late in (False, True, False)[:runs]]


def opencode_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found("opencode", *_opencode(spark, sf_dir))


def opencode_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_opencode(spark, sf_dir, 2)[0], "opencode", spark, ("day", "provider_code", "model_code"))


def _turn_rows(spark: SparkSession, sf_dir: str, least: date | None = None) -> tuple[DataFrame, DataFrame]:
    logs = fixtures.write_logs(fixtures.codex_lines(spark, sf_dir, late_meta=True), scratch_folder(spark, "turn-logs"), ["event_id", "n"])
    raw = scan.lines(spark, [logs], pattern="*.txt")
    return raw, analysis.turn_rows(raw, least)


def _through_csv(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a CSV of the rows holds."""
    path = scratch_folder(spark, "csv")
    sinks.write_csv(rows, path)
    return spark.read.option("header", "true").csv(path)


def _user_of_path() -> Column:
    return F.regexp_extract("file_path", "log=u([0-9]+)", 1).cast("long").alias("user_id")


def codex_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the logs that start on LEAST_DAY or later, through their CSV."""
    got = _through_csv(spark, analysis.turn_table(_turn_rows(spark, sf_dir, LEAST_DAY)[1]))
    whole = [F.col(c).cast("long").alias(c) for c in ("turn_context_line", "token_count_events_raw", "token_count_events_with_info", "token_count_events_deduped")]
    return got.select(_user_of_path(), "session_id", "model_code", *whole)


def codex_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn boundaries through their CSV. Turns that ended before the session line have no session."""
    got = _through_csv(spark, analysis.boundary_table(_turn_rows(spark, sf_dir)[1]))
    names = ("turn_context_line", "prev_total_tokens", "prev_token_line", "first_after_total_tokens", "first_after_line", "second_after_total_tokens", "second_after_line", "first_matches_previous", "second_is_new")
    return got.select(_user_of_path(), "session_id", "model_code", *[F.col(c).cast("long").alias(c) for c in names])


def codex_analysis_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analysis_counters(*_turn_rows(spark, sf_dir))


def gemini_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines with broken JSON, odd counters and odd times, read as far as they go."""
    lines = fixtures.gemini_lines(spark, sf_dir).filter("event_id >= 0")
    e = F.col("event_id")
    odd = (
        F.when(e % 17 == 0, F.lit("{broken"))
        .when(e % 19 == 0, F.regexp_replace("value", '"input_token_count":[0-9]+', '"input_token_count":"x"'))
        .when(e % 23 == 0, F.regexp_replace("value", '"event.timestamp":"[^"]*"', '"event.timestamp":"junk"'))
        .otherwise(F.col("value"))
    )
    path = fixtures.write_logs(lines.withColumn("value", odd), scratch_folder(spark, "gemini-odd"), ["event_id"])
    rows = scan.lenient_gemini(scan.lines(spark, [path], pattern="*.txt"))
    return rows.groupBy("model_code").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.year("event_timestamp") == 1).alias("undated"))


def _raw_log(spark: SparkSession, records: DataFrame, path: str) -> None:
    opened = F.regexp_replace(F.regexp_replace("value", "^\\{", "{\n  "), "\\}$", "\n}")
    records.select(opened.alias("value")).write.mode("append").text(path)


def _fails(run: Callable[[], None], message: str) -> bool:
    """Whether a run ends in an error with this message."""
    try:
        run()
    except Exception as e:  # noqa: BLE001
        if message not in str(e):
            raise
        return True
    return False


def telemetry_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw log converted twice, the second time with later records; then a simplified copy of the result."""
    raw, out, copy = (scratch_folder(spark, n) for n in ("raw", "converted", "copy"))
    events = table(spark, sf_dir, "events")
    records, before = simplify.telemetry_records(events), fixtures.earlier(events)
    added = []
    for part in (before, ~before):
        _raw_log(spark, records.filter(part), raw)
        added.append(analysis.convert_telemetry(spark, [raw], out, 2))
    done = scan.lines(spark, [out], pattern="*.txt")
    misplaced = simplify.misplaced_metadata(done).count()
    sinks.write_lines(simplify.simplified(done, 3), copy)
    metadata = F.to_json(F.struct(F.lit(simplify.METADATA).alias("record_type")))
    first, second = (done.withColumn("value", F.when(F.col("line_number") == n, metadata).otherwise(F.col("value"))) for n in (1, 2))
    failed = [int(_fails(lambda d=d: sinks.write_lines(simplify.simplified(d, 3), scratch_folder(spark, "copy")), simplify.MISPLACED)) for d in (first, second)]
    of = lambda df, step: df.groupBy(simplify.name_of(F.try_parse_json("value")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("length"), F.min(F.md5("value")).alias("least"), F.max(F.md5("value")).alias("most")).withColumn("step", F.lit(step))
    counted = spark.createDataFrame([("first run", added[0]), ("second run", added[1]), ("misplaced", misplaced), ("failed with metadata on line 1", failed[0]), ("failed with metadata on line 2", failed[1])], "name string, n long")
    counted = counted.select("name", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("length", "long"), ("least", "string"), ("most", "string"))], F.lit("counter").alias("step"))
    return _union([counted, of(done, "converted"), of(spark.read.text(copy), "copy")])


def _price_folder(spark: SparkSession, sf_dir: str) -> str:
    """A flat and a nested price file; the prices follow the least and largest price of a part."""
    path = scratch_folder(spark, "prices")
    p = table(spark, sf_dir, "part").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    low, high = F.col("low"), F.col("high")
    flat = lambda i, o: F.struct((i / 1e6).alias("input_cost_per_token"), (o / 1e6).alias("output_cost_per_token"), (i / 1e7).alias("cache_read_input_token_cost"), (i / 5e5).alias("input_cost_per_token_above_200k_tokens"))
    nested = lambda i, o: F.struct(F.struct(i.alias("input"), o.alias("output"), (i / 10).alias("cache_read")).alias("cost"), F.struct(F.lit(1000).alias("context")).alias("limit"))
    one = F.to_json(F.struct(flat(low, high).alias("anthropic/claude-opus-4-6"), flat(high, low).alias("claude-sonnet-4-6"), F.lit("no object").alias("note")))
    provider = lambda name, **models: F.struct(F.lit(name).alias("id"), F.struct(*[c.alias(k) for k, c in models.items()]).alias("models"))
    two = F.to_json(F.struct(
        provider("openai", **{"gpt-5": nested(low, high)}).alias("a"), provider("minimax", **{"MiniMax-M2.1": nested(high, low)}).alias("b"),
        provider("openrouter", **{"z-ai/glm-4.7": nested(low, low), "glm-4.7": nested(high, high)}).alias("c"), provider("xai", **{"grok-code-fast-1": nested(low * 2, high * 2)}).alias("d"),
    ))
    p.select(F.explode(F.array(one, two)).alias("value")).repartition(2, "value").write.text(path)
    return path


def price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs from price files: Claude events from the flat one, with an aliased and a bare name, and OpenCode events from the nested one."""
    prices = flatten_prices(load_price_text(spark, _price_folder(spark, sf_dir)))
    u = views.usage(spark, sf_dir)
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    sets = {
        "claude": u.withColumn("model_code", pick("claude-opus-4-7", "claude-opus-4-6", "claude-sonnet-4-6", "other")),
        "opencode": u.withColumn("model_code", pick("gpt-5-free", "minimax-m2.1:free", "glm-4.7", "grok-code", "other")),
    }
    cost = F.sum(F.col("cost").cast("decimal(28,10)")).cast("double").alias("cost")
    priced = [with_prices(rows, prices, agent).withColumn("cost", event_cost(agent)).groupBy(F.lit(agent).alias("agent"), "provider_code", "model_code").agg(F.count("*").alias("n"), F.count_if(F.col("price").isNotNull()).alias("priced"), cost) for agent, rows in sets.items()]
    return _union(priced)


def burn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of use with tokens a minute, seen at noon of 2024-01-20 (UTC)."""
    u = views.usage(spark, sf_dir)
    found = stats.burn_rate(stats.usage_blocks(u, "user_id"), "user_id", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return found.withColumn("block_start", F.date_format("block_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    f.__name__: f
    for f in (
        claude_increment, codex_ingest, codex_daily_usage, pi_ingest, pi_daily_usage, gemini_ingest, gemini_daily_usage, opencode_ingest, opencode_daily_usage,
        codex_turns, codex_boundaries, codex_analysis_counters, gemini_lenient, telemetry_conversion, price_file, burn_rates,
    )
}
