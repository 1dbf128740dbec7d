"""Logs and stores of each agent written from the `events` table, for the ingestion queries.

Each user's events become one log. Some users get planted faults: a line that isn't JSON, a
wrong increment, a falling total, a counter of the wrong type. A log of blank lines only
stands beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import views
from .views import table

#: Share of the event ids that an earlier run has seen, in tenths.
EARLIER = 6


def uuid_of(user: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(user.cast("string"), 12, "0"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def log_tasks(spark: SparkSession) -> int:
    """Tasks that write logs. What takes time is the number of logs, not their size, so the tasks aren't joined by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def write_logs(rows: DataFrame, path: str, order: list[str], name: Column | None = None) -> str:
    """Rows (user_id, value and order columns) as one log per user in a folder of its own."""
    folder = rows.withColumn("log", name if name is not None else F.concat(F.lit("u"), F.col("user_id").cast("string")))
    folder.repartition(log_tasks(rows.sparkSession), "log").sortWithinPartitions("log", *order).select("log", "value").write.mode("append").partitionBy("log").text(path)
    return path


def blank_log(spark: SparkSession, path: str) -> None:
    spark.range(1).select(F.lit(" ").alias("value")).coalesce(1).write.mode("append").text(f"{path}/log=blank")


def earlier(events: DataFrame) -> Column:
    """Whether an event belongs to the first tenths of the ids; the bound is one row."""
    top = events.agg(F.max("event_id")).first()[0] or 0
    return F.col("event_id") < top * EARLIER // 10


def claude_lines(usage: DataFrame) -> DataFrame:
    """(user_id, event_id, n, value): a partial and a final line of each usage event."""
    tokens = lambda n: F.struct("input_tokens", n.alias("output_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"))
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    line = lambda n, stop: F.to_json(F.struct(
        F.lit("assistant").alias("type"), name.alias("sessionId"), stamp(F.col("event_timestamp")).alias("timestamp"), F.col("message_id").alias("requestId"),
        F.struct(F.col("message_id").alias("id"), F.col("model_code").alias("model"), F.lit(stop).cast("string").alias("stop_reason"), tokens(n).alias("usage")).alias("message"),
    ))
    return usage.select("user_id", "event_id", F.posexplode(F.array(line(F.lit(0).cast("long"), None), line(F.col("output_tokens"), "end_turn"))).alias("n", "value"))


def _with_heads(events: DataFrame, head: Column, body: list[Column]) -> DataFrame:
    """(user_id, event_id, n, value): the lines of each event, and one head line per user before them."""
    lines = events.select("user_id", "event_id", F.posexplode(F.filter(F.array(*body), lambda x: x.isNotNull())).alias("n", "value"))
    heads = events.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("n"), head.alias("value"))
    return heads.unionByName(lines)


CODEX_FIELDS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def codex_lines(spark: SparkSession, sf_dir: str, *, late_meta: bool = False) -> DataFrame:
    """Session logs: sign-ups are turns, all else token counts with cumulative and last usage.

    Every seventh event repeats the totals. Users 7, 11 and 13 (mod 20) have wrong increments,
    falling totals and a broken line. A session starts on day 1 + user mod 28. late_meta: the
    session line of users 1 (mod 4) comes in the middle of the log.
    """
    e = table(spark, sf_dir, "events").withColumn("k", F.when((F.col("event_id") % 7 == 0) | (F.col("event_type") == "signup"), F.lit(0).cast("long")).otherwise(views.k_of_props()))
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")
    steps = dict(zip(CODEX_FIELDS, (k, k % 5, k % 7, k % 3, k + k % 7), strict=True))
    running = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select("*", *[c.alias(f"last_{f}") for f, c in steps.items()], *[F.sum(c).over(running).alias(f"sum_{f}") for f, c in steps.items()])
    wrong = (user % 20 == 7) & (event % 50 == 3)
    falls = (user % 20 == 11) & (event % 60 == 4)
    total = F.when(falls, -event).otherwise(F.col("sum_total_tokens"))
    snap = lambda p, t: F.struct(*[(t if f == "total_tokens" else F.col(f"{p}_{f}")).alias(f) for f in CODEX_FIELDS])
    info = F.struct(snap("sum", total).alias("total_token_usage"), snap("last", F.col("last_total_tokens") + F.when(wrong, 1).otherwise(0)).alias("last_token_usage"))
    is_turn = F.col("event_type") == "signup"
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), stamp(F.col("ts")).alias("timestamp"), F.struct(F.concat(F.lit("gpt-"), (event % 3).cast("string")).alias("model")).alias("payload")))
    token = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp(F.col("ts")).alias("timestamp"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    broken = F.when((user % 20 == 13) & (event % 40 == 5), F.lit("{broken"))
    day = F.concat(F.lit("2024-01-"), F.lpad((user % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), day.alias("timestamp"), F.struct(uuid_of(user).alias("id"), F.concat(F.lit("/work/"), user.cast("string")).alias("cwd")).alias("payload")))
    first_turn = F.lit('{"type":"turn_context","timestamp":"2024-01-01T00:00:00Z","payload":{"model":"gpt-5"}}')
    lines = _with_heads(e, head, [F.when(is_turn, turn).otherwise(token), broken])
    turns = lines.filter("event_id = -1").withColumns({"n": F.lit(1), "value": first_turn})
    if late_meta:
        middle = (e.agg(F.max("event_id")).first()[0] or 0) // 2
        late = (F.col("event_id") == -1) & (user % 4 == 1)
        lines = lines.withColumns({"n": F.when(late, 2).otherwise(F.col("n")), "event_id": F.when(late, middle).otherwise(event)})
    return lines.unionByName(turns)


def pi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs of messages with usage and reported cost; users 7 (mod 20) have a counter that is text, users 11 a cost that is no object."""
    u = views.usage(spark, sf_dir)
    user, event = F.col("user_id"), F.col("event_id")
    cost = F.struct((F.col("output_tokens") / 1000.0).alias("total"))
    usage = lambda i, c: F.struct(i.alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cacheRead"), F.col("cache_write_tokens").alias("cacheWrite"), c.alias("cost"))
    line = lambda x: F.to_json(F.struct(F.lit("message").alias("type"), F.col("message_id").alias("id"), stamp(F.col("event_timestamp")).alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.col("provider_code").alias("provider"), F.col("model_code").alias("model"), x.alias("usage")).alias("message")))
    body = (
        F.when((user % 20 == 7) & (event % 50 == 3), line(usage(F.lit("x"), cost)))
        .when((user % 20 == 11) & (event % 50 == 3), line(usage(F.col("input_tokens"), F.lit(3))))
        .otherwise(line(usage(F.col("input_tokens"), cost)))
    )
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("p"), user.cast("string")).alias("id"), F.lit(3).alias("version"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("/work").alias("cwd")))
    return _with_heads(u, head, [body])


def gemini_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry file per user as a project; every fourth event is a request without counters."""
    u = views.usage(spark, sf_dir).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"))
    user, event = F.col("user_id"), F.col("event_id")
    names = {"input_token_count": "input_tokens", "cached_content_token_count": "cache_read_tokens", "output_token_count": "output_tokens", "thoughts_token_count": "reasoning_tokens", "total_token_count": "total_tokens"}
    attributes = F.struct(F.when(event % 4 == 0, "gemini_cli.api_request").otherwise("gemini_cli.api_response").alias("event.name"), stamp(F.col("event_timestamp")).alias("event.timestamp"), F.coalesce("model_code", F.lit("gemini-x")).alias("model"), *[F.col(c).alias(k) for k, c in names.items()])
    head = F.to_json(F.struct(F.lit("gemini_cli.project_metadata").alias("record_type"), F.lit(1).alias("schema_version"), uuid_of(user).alias("project_id")))
    return _with_heads(u, head, [F.to_json(F.struct(attributes.alias("attributes")))])


def opencode_tables(spark: SparkSession, sf_dir: str, *, late: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(message, session, project) of a store. late: with all messages, some of the earlier ones updated; else the earlier ones only.

    Every ninth message is a user's, every eleventh belongs to a session that isn't there.
    """
    u = views.usage(spark, sf_dir)
    event, user = F.col("event_id"), F.col("user_id")
    before = earlier(u)
    changed = before & (event % 10 == 4)
    tokens = F.struct("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
    more = F.when(changed, 1000).otherwise(0) if late else F.lit(0)
    data = F.to_json(F.struct(
        F.when(event % 9 == 0, "user").otherwise("assistant").alias("role"), F.col("provider_code").alias("providerID"), F.col("model_code").alias("modelID"), F.lit(0.25).alias("cost"),
        F.struct((F.col("t.input_tokens") + more).alias("input"), F.col("t.output_tokens").alias("output"), F.col("t.reasoning_tokens").alias("reasoning"), F.struct(F.col("t.cache_read_tokens").alias("read"), F.col("t.cache_write_tokens").alias("write")).alias("cache")).alias("tokens"),
    ))
    updated = event * 10 + (F.when(changed, F.lit(100_000_000)).otherwise(F.lit(0)) if late else F.lit(0))
    rows = u.withColumn("t", tokens).select(
        F.concat(F.lit("m"), F.lpad(event.cast("string"), 12, "0")).alias("id"), F.when(event % 11 == 0, F.lit("gone")).otherwise(F.concat(F.lit("s"), (user % 50).cast("string"))).alias("session_id"),
        (F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("event_timestamp")) * 1000).alias("time_created"),
        updated.cast("long").alias("time_updated"), data.alias("data"), "event_id",
    )
    message = (rows if late else rows.filter(before)).drop("event_id")
    numbers = u.select((user % 50).alias("s")).distinct()
    session = numbers.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("s") % 7).cast("string")).alias("project_id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("directory"), F.lit("1").alias("version"))
    project = numbers.select(F.concat(F.lit("p"), (F.col("s") % 7).cast("string")).alias("id"), F.lit("/w").alias("worktree")).distinct()
    return message, session, project
