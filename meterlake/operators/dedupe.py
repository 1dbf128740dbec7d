"""Duplicate folding and validation in file order (WIN-01..05, AGG-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def fold_final(rows: DataFrame, keys: list[str], order: str, usage: Column, is_final: Column) -> DataFrame:
    """One row per key: the first, replaced by each later *final* row whose usage differs from the kept one.

    Closed form of the fold: among the first row and the final ones, keep the last whose usage
    differs from its predecessor's. Adds `duplicates`, the rows that were dropped without
    replacing anything.
    """
    by = Window.partitionBy(*keys)
    ranked = rows.withColumns({"n__": F.row_number().over(by.orderBy(order)), "all__": F.count("*").over(by), "u__": usage})
    candidates = ranked.filter((F.col("n__") == 1) | is_final)
    ahead = by.orderBy("n__")
    changed = candidates.withColumn("changed__", (F.col("n__") == 1) | ~F.col("u__").eqNullSafe(F.lag("u__").over(ahead))).filter("changed__")
    last = changed.withColumns({"left__": F.row_number().over(by.orderBy(F.desc("n__"))), "kept__": F.count("*").over(by)}).filter("left__ = 1")
    return last.withColumn("duplicates", F.col("all__") - F.col("kept__")).drop("n__", "all__", "u__", "changed__", "left__", "kept__")


def first_per_cumulative(rows: DataFrame, scope: list[str], total: str, order: str, snapshot: Column | None = None) -> DataFrame:
    """First row of each cumulative total, with `repeats` and `conflict` (a repeat had another snapshot)."""
    same = Window.partitionBy(*scope, total)
    snap = snapshot if snapshot is not None else F.col(total)
    marked = rows.withColumns({"s__": snap, "first__": F.row_number().over(same.orderBy(order)), "repeats": F.count("*").over(same) - 1})
    first = F.first_value("s__").over(same.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumn("differs__", ~F.col("s__").eqNullSafe(first))
    marked = marked.withColumn("conflict", F.max("differs__").over(same))
    return marked.filter("first__ = 1").drop("s__", "first__", "differs__")


def order_checks(rows: DataFrame, scope: list[str], order: str, total: str, pairs: list[tuple[Column, Column]], *, width: int = scans.WIDTH) -> DataFrame:
    """Adds `falls` (the total doesn't rise on the row before) and `bad_delta` (a total less the one
    before isn't the reported increment). pairs: (total, increment). The first row is exempt."""
    totals = F.struct(F.col(total).alias("t"), *[now.alias(f"t{k}") for k, (now, _) in enumerate(pairs)])
    rows = scans.last_set(rows, scope, order, totals, "before__", inclusive=False, width=width)
    bad = F.lit(False)
    for k, (now, step) in enumerate(pairs):
        bad = bad | F.coalesce(now - F.col(f"before__.t{k}") != step, F.lit(False))
    return rows.withColumns({"falls": F.coalesce(F.col(total) <= F.col("before__.t"), F.lit(False)), "bad_delta": bad}).drop("before__")


def repeated_keys(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, n, first_line): keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(line).alias("first_line")).filter("n > 1")
