"""Turn and boundary analysis of Codex logs, and conversion of raw telemetry logs."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict_json import kind, text, whole
from ..operators import incremental, simplify, sinks, turns
from ..sources import lines as scan

MISSING = "<missing_session_id>"
#: Folder in that of the converted lines, hidden from readers, with the largest time stamp of each file.
MARKS = "_marks"


def turn_rows(raw: DataFrame, least: date | None = None) -> DataFrame:
    """Turn and token rows of log lines, with session_id, segment and the turn's own fields.

    session_segment is the turn in which the session line came. Malformed lines are left out,
    not errors. Totals that are absent, boolean or no whole number are null.
    """
    dated = raw if least is None else scan.from_date(raw, least)
    rows = scan.json_lines(dated).filter(~F.col("malformed"))
    v = F.col("v")
    kind_of = text(v, "$.type")
    session = F.when(kind_of.isin("session_meta", "session_metadata"), text(v, "$.payload.id"))
    rows = turns.one_id_per_file(rows, ["file_path"], "line_number", session)
    is_turn = F.coalesce(kind_of == "turn_context", F.lit(False))
    is_token = F.coalesce((kind_of == "event_msg") & (text(v, "$.payload.type") == "token_count"), F.lit(False))
    rows = turns.segments(rows, ["file_path"], "line_number", is_turn)
    rows = turns.one_id_per_file(rows, ["file_path"], "line_number", F.when(session.isNotNull(), F.col("segment")), "session_segment")
    return rows.filter(is_turn | is_token).select(
        "segment", "session_segment", "file_path", "line_number", F.coalesce("session_id", F.lit(MISSING)).alias("session_id"), is_turn.alias("is_turn"),
        F.when(is_turn, text(v, "$.timestamp")).alias("stamp"), F.when(is_turn, F.nullif(text(v, "$.payload.model"), F.lit(""))).alias("model"),
        (is_token & F.coalesce(kind(F.try_variant_get(v, "$.payload.info", "variant")) == "OBJECT", F.lit(False))).alias("has_info"),
        F.when(is_token, whole(v, "$.payload.info.total_token_usage.total_tokens")).alias("total"),
    )


def _turn_fields() -> list:
    own = lambda c: F.max(F.when(F.col("is_turn"), F.col(c)))
    return [own("line_number").alias("turn_context_line"), own("stamp").alias("turn_context_timestamp"), own("model").alias("model_code")]


def turn_table(rows: DataFrame) -> DataFrame:
    """One row per turn: session, file, line, time, model, token rows, those with info, distinct totals."""
    token = ~F.col("is_turn")
    return rows.filter("segment > 0").groupBy("session_id", "file_path", "segment").agg(
        *_turn_fields(), F.count_if(token).alias("token_count_events_raw"), F.count_if(token & F.col("has_info")).alias("token_count_events_with_info"),
        F.countDistinct(F.when(token, F.col("total"))).alias("token_count_events_deduped"),
    ).drop("segment")


def boundary_table(rows: DataFrame) -> DataFrame:
    """One row per turn with the totals around its start and whether they match or rise.

    A turn that has ended before the session line keeps the name MISSING (JOIN-10).
    """
    found = turns.boundaries(rows, ["file_path"], "line_number", F.col("is_turn"), "total")
    known = F.max("session_segment") <= F.col("segment")
    fields = rows.filter("segment > 0").groupBy("file_path", "segment").agg(*_turn_fields(), F.when(known, F.max("session_id")).otherwise(MISSING).alias("session_id"))
    previous, first, second = F.col("previous_total"), F.col("first_total"), F.col("second_total")
    return found.join(fields, ["file_path", "segment"]).select(
        "session_id", "file_path", "turn_context_line", "turn_context_timestamp", "model_code", previous.alias("prev_total_tokens"), F.col("previous_line").alias("prev_token_line"),
        first.alias("first_after_total_tokens"), F.col("first_line").alias("first_after_line"), second.alias("second_after_total_tokens"), F.col("second_line").alias("second_after_line"),
        F.coalesce(first == previous, F.lit(False)).alias("first_matches_previous"), F.coalesce(second > first, F.lit(False)).alias("second_is_new"),
    )


def analysis_counters(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files, sessions, orphan token rows, malformed lines, files without a session."""
    lines = scan.json_lines(raw).agg(F.countDistinct("file_path").alias("files_scanned"), F.count_if(F.col("v").isNull()).alias("parse_errors"))
    named = F.col("session_id") != MISSING
    found = rows.agg(F.countDistinct(F.when(named, F.col("session_id"))).alias("sessions_found"), F.count_if((F.col("segment") == 0) & ~F.col("is_turn")).alias("orphan_token_count_events"), F.countDistinct(F.when(~named, F.col("file_path"))).alias("sessions_missing_metadata"))
    return lines.join(found)


def _marks(spark: SparkSession, out: str) -> DataFrame:
    """(file_path, file_size, file_mtime, last): the largest time stamp of each file of `out` that was looked into."""
    schema = "file_path string, file_size long, file_mtime timestamp, last string"
    try:
        return spark.read.schema(schema).parquet(f"{out}/{MARKS}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def last_converted(spark: SparkSession, out: str) -> str | None:
    """The largest time stamp of the lines in `out`; None if there are none.

    A file is read once: its largest time stamp is kept beside the lines, with the size and time
    of the file. Files that a run left without one, or that were written over, are read again, and
    files that are gone no longer count.
    """
    try:
        files = scan.session_files(spark, [out], "*")
    except AnalysisException:
        return None
    fresh = incremental.changed_files(files, _marks(spark, out)).persist()
    paths = sorted(scan.literal(r["file_path"]) for r in fresh.select("file_path").collect())
    if paths:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), simplify.stamp().alias("stamp"))
        found = lines.groupBy("file_path").agg(F.max("stamp").alias("last"))
        fresh.join(found, "file_path", "left").coalesce(1).write.mode("append").parquet(f"{out}/{MARKS}")
    fresh.unpersist()
    return files.join(_marks(spark, out), ["file_path", "file_size", "file_mtime"]).agg(F.max("last").alias("last")).first()["last"]


def convert_telemetry(spark: SparkSession, raw: list[str], out: str, level: int = 0) -> int:
    """Append the records of raw telemetry logs that are later than the last one in `out`; returns how many.

    Records need a text time stamp. They are added in the order of their times. Lines of earlier
    runs aren't read (`last_converted`).
    """
    last, stamp = last_converted(spark, out), simplify.stamp()
    records = scan.concatenated_objects(spark, raw).filter(stamp.isNotNull() & (stamp != ""))
    fresh = simplify.simplified(simplify.tail_of(records, last), level).withColumn("value", F.to_json(F.try_parse_json("value"))).withColumn("at", stamp).persist()
    n = fresh.count()
    if n:
        sinks.append_lines(fresh.repartitionByRange("at").sortWithinPartitions("at"), out)
        last_converted(spark, out)
    fresh.unpersist()
    return n
