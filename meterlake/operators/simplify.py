"""Telemetry records: simplification levels and the conversion tail (FLT-20..24, AGG-12, SNK-13/14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import at, has, text

RESPONSE, REQUEST = "gemini_cli.api_response", "gemini_cli.api_request"
METADATA = "gemini_cli.project_metadata"
MISPLACED = "metadata record after the first line"
# Attributes that level 3 keeps; a record without one of them is dropped.
KEPT_ATTRIBUTES = (
    "event.timestamp",
    "duration_ms",
    "input_token_count",
    "output_token_count",
    "cached_content_token_count",
    "thoughts_token_count",
    "total_token_count",
    "tool_token_count",
    "model",
    "session.id",
    "event.name",
)


def name_of(v):
    return text(v, "$.attributes['event.name']")


def simplified(records: DataFrame, level: int) -> DataFrame:
    """Records (column value, JSON text) at a level.

    0: as they are. 1: API responses and requests only. 2: of those, attributes and _body only;
    a record without either is dropped. 3: API responses only, with the kept attributes.
    Where records have a line_number, a metadata record on another line than the first is an
    error when the result is read.
    """
    if level not in (0, 1, 2, 3):
        raise ValueError("level must be 0, 1, 2 or 3")
    if "line_number" in records.columns:
        records = records.withColumn("value", F.when(_misplaced(), F.raise_error(F.concat(F.lit(f"{MISPLACED} at line "), F.col("line_number").cast("string")))).otherwise(F.col("value")))
    if level == 0:
        return records
    v = F.try_parse_json(F.col("value"))
    named = name_of(v)
    metadata = F.coalesce(text(v, "$.record_type") == METADATA, F.lit(False))
    if level == 1:
        return records.filter(metadata | named.isin(RESPONSE, REQUEST))
    whole = has(v, "$.attributes") & has(v, "$._body")
    if level == 2:
        kept = records.filter(metadata | (named.isin(RESPONSE, REQUEST) & whole))
        attributes = F.to_json(at(v, "$.attributes"))
    else:
        complete = whole
        for a in KEPT_ATTRIBUTES:
            complete = complete & has(v, f"$.attributes['{a}']")
        kept = records.filter(metadata | ((named == RESPONSE) & complete))
        parts = [F.concat(F.lit(f'"{a}":'), F.to_json(at(v, f"$.attributes['{a}']"))) for a in KEPT_ATTRIBUTES]
        attributes = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    short = F.concat(F.lit('{"attributes":'), attributes, F.lit(',"_body":'), F.to_json(at(v, "$._body")), F.lit("}"))
    return kept.withColumn("value", F.when(metadata, F.col("value")).otherwise(short))


def _misplaced() -> Column:
    return (F.col("line_number") > 1) & F.coalesce(text(F.try_parse_json(F.col("value")), "$.record_type") == METADATA, F.lit(False))


def misplaced_metadata(lines: DataFrame) -> DataFrame:
    """Lines other than the first that hold a metadata record; there should be none."""
    return lines.filter(_misplaced())


def stamp() -> Column:
    """Text timestamp of a record in the column value."""
    return text(F.try_parse_json(F.col("value")), "$.attributes['event.timestamp']")


def largest_timestamp(records: DataFrame) -> DataFrame:
    """(last): largest text timestamp of a folder to which records were added in the order of their times."""
    return records.agg(F.max(stamp()).alias("last"))


def tail_of(records: DataFrame, last: str | None) -> DataFrame:
    """Records whose timestamp text is greater than `last`; all if there is none."""
    return records if last is None else records.filter(stamp() > F.lit(last))


def telemetry_records(events: DataFrame) -> DataFrame:
    """(event_id, value): events as telemetry records, some without body or with attributes missing."""
    e = F.col("event_id")
    name = F.when(e % 3 == 0, RESPONSE).when(e % 3 == 1, REQUEST).otherwise("gemini_cli.config")
    k = F.get_json_object("props", "$.k").cast("bigint")
    attributes = F.struct(
        (e % 500).alias("duration_ms"), name.alias("event.name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event.timestamp"), k.alias("input_token_count"), F.lit("gemini-x").alias("model"),
        (k * 2).alias("output_token_count"), (k % 5).alias("cached_content_token_count"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session.id"),
        F.when(e % 7 != 0, k % 3).alias("thoughts_token_count"), F.lit(0).alias("tool_token_count"), (k * 3).alias("total_token_count"), F.lit("dropped").alias("extra"),
    )
    body = F.when(e % 5 != 0, F.struct(F.col("event_type").alias("text")))
    return events.select("event_id", F.to_json(F.struct(attributes.alias("attributes"), body.alias("_body"), F.lit(1).alias("resource"))).alias("value"))
