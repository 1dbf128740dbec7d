"""Warehouse of Parquet snapshots with one commit per run (SNK-01..12, SNK-18).

A run writes new folders, then one manifest that names the folders of every table. Readers
see the last manifest only, so events and file states of a run appear together or not at all.
A manifest is written whole under a hidden name and then renamed to its number, which fails
if that number is taken: a run that dies leaves nothing that readers or later runs look at,
and of two runs at once the second one gets an error and changes nothing.

A table whose rows are replaced ("update") lies in hash buckets of its key, one folder each:
a run writes the buckets again that its rows fall in, and the manifest keeps the folders of
all others. File states ("latest") are only added to; readers take the last row of each key.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path of a file, and its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    at, files = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(at) or [])


def _rename_new(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file; a file of the new name is an error and stays as it is."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    at = fs.Path(old)
    context = fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at, fs.Path(new), gateway.new_array(getattr(fs, "Options$Rename"), 0))


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


_BUCKET = re.compile(r"/bucket_of_([0-9]+)=([0-9]+)/?$")


class Warehouse:
    """`buckets`: the number for tables that have no rows yet; stored tables keep theirs until they are compacted.

    A bucket is written by one task, so the number should grow with the tables: at 128 MB a
    bucket, 1,000 buckets hold 128 GB of sessions or messages.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self, n: int) -> str:
        return f"{self.path}/_commits/{n:08d}.json"

    def _last(self) -> tuple[int, dict[str, list[str]]]:
        """Number and folders of the last commit: names are listed, and only the last manifest is read."""
        found = _glob(self.spark, f"{self.path}/_commits/[0-9]*.json")
        if not found:
            return 0, {}
        row = self.spark.read.schema("n long, folders string").json(max(found)).first()
        return row["n"], json.loads(row["folders"])

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        schema = TABLES[table].schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        """Rows of the last commit; an empty table if there is none."""
        rows = self._rows(table, self._last()[1].get(table, []))
        if TABLES[table].on_conflict != "latest":
            return rows
        key = TABLES[table].key
        values = [c for c in rows.columns if c not in key]
        last = F.max(F.struct(F.col("ingested_at").alias("at"), F.struct(*values).alias("values"))).alias("last")
        return rows.groupBy(*key).agg(last).select(*key, "last.values.*")

    def footer_largest(self, table: str, column: str) -> DataFrame:
        """(largest): of a whole-number column over all stored rows, which Parquet answers from the footers of its files.

        The scan has a session of its own, as the reader that does so is chosen by settings.
        """
        folders, side = self._last()[1].get(table, []), self.spark.newSession()
        side.conf.set("spark.sql.sources.useV1SourceList", "")
        side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        schema = TABLES[table].schema
        rows = side.read.schema(schema).parquet(*folders) if folders else side.createDataFrame([], schema)
        return rows.agg(F.max(column).alias("largest"))

    def largest(self, table: str, column: str) -> int | None:
        """The largest value of a whole-number column that is never null in a file; None if there are no rows."""
        return self.footer_largest(table, column).first()["largest"]

    def _bucket(self, table: str, folders: list[str]) -> tuple[str, Column]:
        """Name of the bucket column of a stored table, and a row's bucket."""
        found = [m for f in folders if (m := _BUCKET.search(f))]
        n = int(found[0][1]) if found else self.buckets
        return f"bucket_of_{n}", F.pmod(F.xxhash64(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].schema if f.name in TABLES[table].key]), F.lit(n)).cast("int")

    def near(self, table: str, rows: DataFrame) -> DataFrame:
        """Stored rows of the buckets that `rows` fall in; no other bucket is read. What comes to the driver are bucket numbers."""
        folders = self._last()[1].get(table, [])
        _, bucket = self._bucket(table, folders)
        hit = {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}
        return self._rows(table, [f for f in folders if int(_BUCKET.search(f)[2]) in hit])

    def _write(self, table: str, rows: DataFrame, folder: str, folders: list[str], sort: list[str]) -> list[str]:
        """Write rows, and give the folders that hold them: one, or one a bucket."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].schema])
        if TABLES[table].on_conflict != "update":
            named.write.parquet(folder)
            return [folder]
        name, bucket = self._bucket(table, folders)
        dealt = named.withColumn(name, bucket).repartition(name).sortWithinPartitions(name, *sort)
        dealt.write.partitionBy(name).parquet(folder)
        return _glob(self.spark, f"{folder}/{name}=*")

    def commit(self, appends: dict[str, DataFrame] | None = None, snapshots: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None, sort: list[str] | None = None) -> None:
        """Write rows to add, whole new tables and changed buckets, then make them the current state in one step.

        `changed` has all rows, old and new, of each bucket that it has a row of (see `near`);
        the other buckets stay as they are. A commit that another run has made since is an
        error; that run's rows stay, and this one can be made again.
        """
        n, folders = self._last()
        run = uuid.uuid4().hex[:8]
        for changes, kind in ((appends or {}, "add"), (snapshots or {}, "replace"), (changed or {}, "change")):
            for table, rows in changes.items():
                if kind != "replace" and (kind == "change") != (TABLES[table].on_conflict == "update"):
                    raise ValueError(f"{table} can't take rows to {kind}")
                old = folders.get(table, [])
                new = self._write(table, rows, f"{self.path}/{table}/{n + 1:08d}-{run}", old if kind == "change" else [], sort or [])
                if kind == "change":
                    rewritten = {_BUCKET.search(f)[0] for f in new}
                    old = [f for f in old if _BUCKET.search(f)[0] not in rewritten]
                folders[table] = new if kind == "replace" else [*old, *new]
        self._publish(n + 1, folders, run)

    def _publish(self, n: int, folders: dict[str, list[str]], run: str) -> None:
        """Make a manifest the last one, unless another run has made one of that number."""
        hidden = f"{self.path}/_commits/.new-{n:08d}-{run}"
        line = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(json.dumps(folders)).alias("folders"))
        line.coalesce(1).write.json(hidden)
        try:
            _rename_new(self.spark, _glob(self.spark, f"{hidden}/part-*")[0], self._manifest(n))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise RuntimeError(f"commit {n} of {self.path} exists: another run has made it since this one began; nothing of this run is stored") from None
            raise
        finally:
            _delete(self.spark, hidden)

    def compact(self, table: str, files: int, sort: list[str]) -> None:
        """Rewrite a table as fewer files, sorted within each by columns that readers filter on.

        A table of buckets gets one file for each of this warehouse's number of buckets.
        """
        rows = self.read(table)
        if TABLES[table].on_conflict != "update":
            rows = rows.repartitionByRange(files, *sort).sortWithinPartitions(*sort)
        self.commit(snapshots={table: rows}, sort=sort)


def usage_events(warehouse: Warehouse, agent: str) -> DataFrame:
    """Canonical usage events of an agent's table (SRC-10..14): counters under common names, `unknown` for missing names."""
    unknown = F.lit("unknown")
    named = lambda c: F.coalesce(c, unknown)
    zero = F.lit(0).cast("long")
    if agent == "claude":
        t = warehouse.read("claude_usage_events")
        columns = [F.lit("anthropic"), named(F.col("model_code")), "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", zero, "session_id", "event_timestamp"]
    elif agent == "codex":
        t = warehouse.read("codex_session_details")
        columns = [F.lit("openai"), named(F.col("model_code")), "input_tokens", "cached_input_tokens", zero, "output_tokens", "reasoning_output_tokens", "session_id", "event_timestamp"]
    elif agent == "opencode":
        t = warehouse.read("opencode_message_usage")
        columns = [named(F.col("provider_code")), named(F.col("model_code")), "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "session_id", F.coalesce("message_completed_at", "message_created_at")]
    elif agent == "pi":
        t = warehouse.read("pi_usage_events")
        columns = [named(F.col("provider_code")), named(F.col("model_code")), "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", zero, "session_id", "event_timestamp"]
    else:
        t = warehouse.read("gemini_usage_events")
        columns = [F.lit("google"), named(F.col("model_code")), "input_tokens", "cached_input_tokens", zero, "output_tokens", "thoughts_tokens", "project_id", "event_timestamp"]
    names = ("provider_code", "model_code", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "session_id", "event_timestamp")
    return t.select(F.lit(agent).alias("agent"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names, strict=True)])
