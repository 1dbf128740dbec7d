"""Usage tables derived from the `events` table, in the shape of the warehouse (for the named queries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.prices import price_table
from .operators import scans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage event per row of `events`; event_timestamp has no zone and counts as UTC."""
    e = table(spark, sf_dir, "events").withColumn("k", k_of_props())
    user, cents = F.col("user_id"), F.round(F.col("value") * 100).cast("bigint")
    provider = F.when(user % 4 == 0, "opencode").when(user % 4 == 1, "openrouter").when(user % 4 == 2, "lmstudio").otherwise("anthropic")
    model = F.when(F.col("event_type") == "view", "claude-sonnet-4-6").when(F.col("event_type") == "click", "gpt-5-free").when(F.col("event_type") == "purchase", "glm-4.7:free").when(F.col("event_type") == "signup", "grok-code")
    return e.select(
        F.concat(F.lit("s"), (user % 50).cast("string")).alias("session_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        "event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("event_timestamp"), provider.alias("provider_code"), model.alias("model_code"),
        (cents * (F.col("k") + 1)).alias("input_tokens"), (cents * (F.col("event_id") % 3)).alias("cache_read_tokens"), (F.col("k") * (F.col("event_id") % 4)).alias("cache_write_tokens"),
        (F.col("k") * 10).alias("output_tokens"), (F.col("k") * (F.col("event_id") % 13)).alias("reasoning_tokens"),
    )


#: Prices of the derived tables, USD per million tokens.
PRICE_ROWS = """
  ('openai/gpt-5', 1.25e0, 10e0, 0.125e0, cast(null as double), 2.5e0, 15e0, 0.25e0),
  ('anthropic/claude-sonnet-4-6', 3e0, 15e0, 0.3e0, 3.75e0, 6e0, 22.5e0, 0.6e0),
  ('xai/grok-code-fast-1', 0.2e0, 1.5e0, 0.02e0, null, null, null, null)
"""


def prices(spark: SparkSession) -> DataFrame:
    return price_table(spark.sql(f"select * from values {PRICE_ROWS} as p(price_key, input, output, cache_read, cache_write, input_200k, output_200k, cache_read_200k)"))


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals per user in event order, with planted repeats, wrong increments and falls."""
    e = table(spark, sf_dir, "events").withColumn("inc", F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("long")).otherwise(k_of_props() + 1))
    e = scans.running_sum(e, ["user_id"], "event_id", F.col("inc"), "running")
    total = F.col("running") - F.when(F.col("event_id") % 211 == 2, 500).otherwise(0)
    return e.select("user_id", "event_id", "ts", "event_type", (F.col("inc") + F.when(F.col("event_id") % 97 == 1, 1).otherwise(0)).cast("long").alias("last_tokens"), total.cast("long").alias("total_tokens"))


def partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message two or three times: a partial row first, then rows that may be final."""
    u = usage(spark, sf_dir).select("message_id", "event_id", "output_tokens")
    lines = F.filter(F.array(
        F.struct(F.lit(1).alias("line_number"), F.lit(0).cast("long").alias("more"), F.lit(None).cast("string").alias("stop_reason")),
        F.struct(F.lit(2).alias("line_number"), (F.col("event_id") % 3).alias("more"), F.when(F.col("event_id") % 2 == 0, "end_turn").alias("stop_reason")),
        F.when(F.col("event_id") % 4 == 0, F.struct(F.lit(3).alias("line_number"), (F.col("event_id") % 5).alias("more"), F.lit("tool_use").alias("stop_reason"))),
    ), lambda x: x.isNotNull())
    return u.select("message_id", "output_tokens", F.explode(lines).alias("l")).select("message_id", "l.line_number", (F.col("output_tokens") + F.col("l.more")).alias("output_tokens"), "l.stop_reason")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn and token rows per user: sign-ups start turns, with a model that is sometimes null."""
    c = cumulative(spark, sf_dir)
    is_turn = F.col("event_type") == "signup"
    model = F.when(is_turn & (F.col("event_id") % 10 != 0), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    return c.select("user_id", "event_id", is_turn.alias("is_turn"), model.alias("model"), F.when(~is_turn, F.col("total_tokens")).alias("total_tokens"))
