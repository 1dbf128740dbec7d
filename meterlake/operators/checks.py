"""Data-quality checks over warehouse tables (DQ-01..10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .incremental import checkpoints


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_by(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, n): rows without a value."""
    return rows.filter(F.col(column).isNull()).groupBy(by).agg(F.count("*").alias("n"))


def _with_before(rows: DataFrame, scope: list[str], order: str, total: str, width: int) -> DataFrame:
    """Adds `before`, the total on the row before in the scope."""
    found = scans.last_set(rows, scope, order, F.struct(F.col(total).alias("v")), "before", inclusive=False, width=width)
    return found.withColumn("before", F.col("before.v"))


def not_rising(rows: DataFrame, scope: list[str], order: str, total: str, *, width: int = scans.WIDTH) -> DataFrame:
    return _with_before(rows, scope, order, total, width).filter(F.col(total) <= F.col("before"))


def wrong_increment(rows: DataFrame, scope: list[str], order: str, total: str, increment: str, *, width: int = scans.WIDTH) -> DataFrame:
    return _with_before(rows, scope, order, total, width).filter(F.col(total) - F.col("before") != F.col(increment))


def rows_and_sessions(rows: DataFrame, session: str = "session_id") -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(session).alias("sessions"))


def session_summary(rows: DataFrame, session: str, tokens: str) -> DataFrame:
    """Sessions by tokens, largest first."""
    return rows.groupBy(session).agg(F.count("*").alias("events"), F.sum(tokens).alias("tokens")).orderBy(F.desc("tokens"), session)


def null_counters(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows with a null in each column; all should be 0."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def by_provider_model(rows: DataFrame, cost: str | None = None) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens")]
    extra = [F.sum(F.col(cost).cast("decimal(28,10)")).cast("double").alias("reported_cost")] if cost else []
    return rows.groupBy("provider_code", "model_code").agg(F.count("*").alias("n"), *sums, *extra)


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def current_checkpoint(rows: DataFrame, key: list[str]) -> DataFrame:
    return checkpoints(rows, [], key).select(*[F.col(f"cp.{c}").alias(c) for c in key])
