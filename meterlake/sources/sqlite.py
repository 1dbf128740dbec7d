"""Python data source `sqlite`: a table of a SQLite file in rowid ranges (SRC-07).

Options: path (a file that all executors can open), dbtable, partitions (default 4), columns
(comma-separated name:type, types string, long, double).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.path, self.table = schema.names, options["path"], options["dbtable"]
        self.parts = int(options.get("partitions", "4"))

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as c:
            low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        with self._connect() as c:
            yield from c.execute(f"select {columns} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in (c.split(":") for c in self.options["columns"].split(",")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, columns: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, dbtable=table, columns=columns, partitions=str(partitions)).load()


def opencode_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(message, session, project) of an OpenCode store."""
    return (
        read_sqlite(spark, path, "message", "id:string,session_id:string,time_created:long,time_updated:long,data:string"),
        read_sqlite(spark, path, "session", "id:string,project_id:string,title:string,directory:string,version:string"),
        read_sqlite(spark, path, "project", "id:string,worktree:string"),
    )
