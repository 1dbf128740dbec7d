"""Line scans of log files (SRC-01..06, SRC-15, SRC-16, SRC-18, SRC-19)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strict_json import at, lenient_whole, text
from ..functions.times import iso_instant_or_oldest
from ..operators import scans

#: File state of a row, as SQL over the hidden metadata column.
STATE = ("_metadata.file_path as file_path", "_metadata.file_size as file_size", "_metadata.file_modification_time as file_mtime")


#: Tasks that list the folders and paths of a scan, at most. Each of them unpacks the settings of the file system, which takes far longer than a path.
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """A scan that is made in here is listed by LISTING_TASKS tasks at most (else by one a path, up to 10,000)."""
    was = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(LISTING_TASKS, int(was))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, was)


def session_files(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file_path, file_size, file_mtime) of the files under all roots, found recursively; contents aren't read.

    Files of no bytes are not listed, as in every scan.
    """
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    return files.selectExpr(*STATE).coalesce(LISTING_TASKS)


def literal(file_path: str) -> str:
    """A path for a reader from the metadata column, which is URL-encoded; pattern characters stand for themselves."""
    return re.sub(r"([][{}*?\\])", r"\\\1", unquote(file_path))


def _numbered(read: DataFrame) -> DataFrame:
    """(file_path, file_size, file_mtime, n, value): rows of a text scan numbered from 1 in each file, in order.

    A split numbers its own rows; the rows of the blocks before it are added from one small row
    per block, so a file of any size is numbered by many tasks and its text isn't shuffled
    unless the blocks are too many to broadcast.
    """
    part = read.selectExpr(*STATE, "_metadata.file_block_start as block__", "monotonically_increasing_id() as place__", "value")
    blocks = part.groupBy("file_path", "block__").agg(F.min("place__").alias("first__"), F.count("*").alias("n__"))
    above = Window.partitionBy("file_path").orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file_path", "block__", (F.coalesce(F.sum("n__").over(above), F.lit(0)) + 1 - F.col("first__")).alias("shift__"))
    return part.join(offsets, ["file_path", "block__"]).select("file_path", "file_size", "file_mtime", (F.col("place__") + F.col("shift__")).alias("n"), "value")


def lines(spark: SparkSession, paths: list[str], *, pattern: str = "*.jsonl", whole_files: bool = False) -> DataFrame:
    """(file_path, file_size, file_mtime, line_number, value): every line, blank ones too, numbered from 1.

    Files are read in splits. whole_files reads each file as one value and once only, for trees
    of files that are known to be small.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    with listing(spark):
        read = reader.text(paths, wholetext=True) if whole_files else reader.option("lineSep", "\n").text(paths)
    if whole_files:
        files = read.selectExpr(*STATE, "value")
        numbered = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n", "value")
        return files.select("file_path", "file_size", "file_mtime", numbered).select("file_path", "file_size", "file_mtime", (F.col("n") + 1).cast("long").alias("line_number"), "value")
    return _numbered(read).withColumnRenamed("n", "line_number")


def json_lines(raw: DataFrame) -> DataFrame:
    """Adds v (VARIANT, null if malformed) and malformed (not a JSON object); blank lines are left out."""
    parsed = raw.filter(F.col("value").rlike(r"[^ \t\r]")).withColumn("v", F.try_parse_json("value"))
    # a JSON text that parses is an object if it starts as one
    return parsed.withColumn("malformed", F.col("v").isNull() | ~F.col("value").rlike(r"^[ \t\r\n]*\{"))


#: A step down that takes any depth to the outside.
_OUT = -(1 << 31)


def _depth_step(value: Column) -> Column:
    """How much deeper in objects and arrays the end of a text is than its start, which lies outside strings."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\\.", ""), r'"[^"\n]*"', "")
    left = lambda c: F.length(F.translate(bare, c, ""))
    return left("}]") - left("{[")


def concatenated_objects(spark: SparkSession, paths: list[str], pattern: str = "*", width: int = scans.WIDTH) -> DataFrame:
    """(file_path, value): the JSON objects of raw telemetry logs, in which a line `}` closes an object.

    Files are cut at every such line, and a piece that parses is an object. Where an object has
    such a line of its own, its pieces are found by depth: braces and brackets outside strings,
    added up along the pieces (`scans.floored_sum`, in ranges of `width`), are back at 0 with the
    object's last piece. As no string goes over the end of a line, a piece starts outside strings.
    A piece that parses is outside of all before it, so an object that was never finished takes
    with it only the pieces up to the next one that parses; they and an unfinished rest are
    dropped before their texts are moved.
    """
    with listing(spark):
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n}\n").text(paths)
    part = _numbered(read)
    # every piece was followed by the separator if sizes add up; else the last one is open unless it ends with a brace
    sizes = part.groupBy("file_path").agg((F.sum(F.octet_length("value") + 3) == F.max("file_size")).alias("closed__"), F.max("n").alias("last__"))
    part = part.join(sizes, "file_path")
    cut_off = ~F.col("closed__") & (F.col("n") == F.col("last__"))
    whole_text = F.when(~cut_off, F.concat("value", F.lit("\n}"))).when(F.col("value").rlike("(?s)\n}\\s*$"), F.col("value"))
    # two closing lines on end share their line break, so a piece may start with the closing line of the object before
    pieces = F.posexplode(F.split(F.col("value"), r"(?<=^\})\n")).alias("i__", "value")
    part = part.withColumn("value", whole_text).filter("value is not null").select("file_path", "n", pieces)
    part = part.select("file_path", (2 * F.col("n") + F.col("i__")).alias("n"), "value", F.try_parse_json("value").isNotNull().alias("ok__"))
    whole = part.filter("ok__").select("file_path", "value")
    steps = part.select("file_path", "n", "ok__", F.when(F.col("ok__"), F.lit(_OUT)).otherwise(_depth_step(F.col("value"))).alias("step__")).persist()
    deep = scans.floored_sum(steps, ["file_path"], "n", F.col("step__"), "depth__", width=width).persist()
    deep = scans.last_set(deep, ["file_path"], "n", F.when(F.col("depth__") == 0, F.col("n")), "after__", inclusive=False, width=width)
    deep = deep.filter(~F.col("ok__")).select("file_path", "n", F.coalesce("after__", F.lit(0).cast("long")).alias("after__"), (F.col("depth__") == 0).alias("ends__"))
    finished = deep.groupBy("file_path", "after__").agg(F.max("ends__").alias("ends__"), F.count("*").alias("k__")).filter("ends__ and k__ > 1").select("file_path", "after__")
    joined = part.filter(~F.col("ok__")).select("file_path", "n", "value").join(deep.join(finished, ["file_path", "after__"]), ["file_path", "n"])
    texts = joined.groupBy("file_path", "after__").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("pieces"))
    found = texts.select("file_path", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(found.filter(F.try_parse_json("value").isNotNull()))


def from_date(raw: DataFrame, least: date) -> DataFrame:
    """Lines of files whose first dated session event isn't before `least`; files without one stay (SRC-18).

    The date is the text date of the event's own time stamp.
    """
    v = F.try_parse_json("value")
    stamp = F.coalesce(text(v, "$.payload.timestamp"), text(v, "$.timestamp"))
    day = F.try_to_date(F.when(text(v, "$.type").isin("session_meta", "session_metadata"), F.substring(stamp, 1, 10)))
    first = raw.groupBy("file_path").agg(F.min_by(day, F.when(day.isNotNull(), F.col("line_number"))).alias("day"))
    kept = first.filter(F.col("day").isNull() | (F.col("day") >= F.lit(least))).select("file_path")
    return raw.join(kept, "file_path", "left_semi")


def lenient_gemini(raw: DataFrame) -> DataFrame:
    """(event_timestamp, model_code, counters, bad): API responses of a log as far as they can be read (SRC-15).

    Defaults: model `unknown`, counters 0, time the first instant of year 1. Malformed lines
    come out with bad = true and nulls; lines that hold no object are left out.
    """
    parsed = json_lines(raw)
    a = at(F.col("v"), "$.attributes")
    count = lambda name: lenient_whole(a, f"$.{name}")
    rows = parsed.filter(F.col("v").isNull() | (text(a, "$['event.name']") == "gemini_cli.api_response"))
    fields = {
        "event_timestamp": iso_instant_or_oldest(text(a, "$['event.timestamp']")), "model_code": F.coalesce(text(a, "$.model"), F.lit("unknown")),
        "input_tokens": count("input_token_count"), "cache_read_tokens": count("cached_content_token_count"), "output_tokens": count("output_token_count"), "reasoning_tokens": count("thoughts_token_count"),
    }
    bad = F.col("v").isNull()
    return rows.select(*[F.when(~bad, c).alias(k) for k, c in fields.items()], bad.alias("bad"))
