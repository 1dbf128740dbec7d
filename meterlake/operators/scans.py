"""Ordered scans over logs, in ranges: what a row needs from above reaches it from one summary row per range.

A log is cut into ranges of order values (lines, event ids). Each range is summed up in one
row by a plain aggregation; a window over those rows alone carries state into the next range;
and the carried row is put ahead of its range's own rows, where a window within the range
finishes the scan. So a log with most of all rows is read by many tasks, and the one task
that sees a whole log sees a row per `width` lines. Order values are whole numbers, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values of a range.
WIDTH = 65_536
RANGE = "range__"


def ranged(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Adds the number of the range that a row is in."""
    return rows.withColumn(RANGE, F.floor(F.col(order) / width))


def _above(scope: list[str]) -> Window:
    return Window.partitionBy(*scope).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows of the ranges and, ahead of them, what is carried into each."""
    return rows.withColumn("row__", F.lit(1)).unionByName(carried.withColumn("row__", F.lit(0)), allowMissingColumns=True)


def _within(scope: list[str], order: str, last: int) -> Window:
    return Window.partitionBy(*scope, RANGE).orderBy("row__", order).rowsBetween(Window.unboundedPreceding, last)


def last_set(rows: DataFrame, scope: list[str], order: str, value: Column, name: str, *, inclusive: bool, width: int = WIDTH, keep_range: bool = False) -> DataFrame:
    """Adds `name`: the last value above the row (or on it, if inclusive) that isn't null.

    Wrap a value in a struct to tell a null that was set from one that was not.
    """
    marked = ranged(rows, order, width).withColumn("set__", value)
    summary = marked.groupBy(*scope, RANGE).agg(F.max_by("set__", F.when(F.col("set__").isNotNull(), F.col(order))).alias("set__"))
    carried = summary.withColumn("set__", F.last("set__", ignorenulls=True).over(_above(scope))).filter(F.col("set__").isNotNull())
    found = _with_carried(marked, carried).withColumn(name, F.last("set__", ignorenulls=True).over(_within(scope, order, 0 if inclusive else -1)))
    return found.filter("row__ = 1").drop("row__", "set__", *[] if keep_range else [RANGE])


def running_sum(rows: DataFrame, scope: list[str], order: str, value: Column, name: str, *, width: int = WIDTH) -> DataFrame:
    """Adds `name`: the sum of the values above the row and on it; nulls count as nothing."""
    marked = ranged(rows, order, width).withColumn("add__", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    summary = marked.groupBy(*scope, RANGE).agg(F.sum("add__").alias("add__"))
    carried = summary.withColumn("add__", F.sum("add__").over(_above(scope))).filter("add__ <> 0")
    found = _with_carried(marked, carried).withColumn(name, F.sum("add__").over(_within(scope, order, 0)))
    return found.filter("row__ = 1").drop("row__", "add__", RANGE)


def floored_sum(rows: DataFrame, scope: list[str], order: str, value: Column, name: str, *, width: int = WIDTH) -> DataFrame:
    """Adds `name`: a sum along the rows, the row's own value in it, that never falls below 0; nulls count as nothing.

    It is the plain running sum less its lowest point so far, where that is below 0. A range is
    summed up by its sum and its lowest point, so these two carry it into the next range.
    """
    here = Window.partitionBy(*scope, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = ranged(rows, order, width).withColumn("sum__", F.sum(F.coalesce(value.cast("long"), F.lit(0).cast("long"))).over(here))
    summary = marked.groupBy(*scope, RANGE).agg(F.max_by("sum__", order).alias("all__"), F.min("sum__").alias("low__"))
    above = summary.withColumn("before__", F.coalesce(F.sum("all__").over(_above(scope)), F.lit(0)))
    above = above.withColumn("lowest__", F.coalesce(F.min(F.col("before__") + F.col("low__")).over(_above(scope)), F.lit(0))).drop("all__", "low__")
    lowest = F.least(F.lit(0), F.col("lowest__"), F.col("before__") + F.min("sum__").over(here))
    found = marked.join(above, [*scope, RANGE]).withColumn(name, F.col("before__") + F.col("sum__") - lowest)
    return found.drop("sum__", "before__", "lowest__", RANGE)


def first_in_scope(rows: DataFrame, scope: list[str], order: str, value: Column, name: str, *, width: int = WIDTH) -> DataFrame:
    """Adds `name` to every row of a scope: its first value that isn't null, also on rows above that one."""
    marked = ranged(rows, order, width).withColumn("set__", value)
    first = F.when(F.col("set__").isNotNull(), F.struct(F.col(order).alias("at"), F.col("set__").alias("v")))
    summary = marked.groupBy(*scope, RANGE).agg(F.min(first).alias("first__"))
    carried = summary.withColumn("first__", F.min("first__").over(Window.partitionBy(*scope))).filter(F.col("first__").isNotNull())
    found = _with_carried(marked, carried).withColumn(name, F.max("first__").over(Window.partitionBy(*scope, RANGE))["v"])
    return found.filter("row__ = 1").drop("row__", "set__", "first__", RANGE)


def first_few(rows: DataFrame, scope: list[str], order: str, k: int, *, width: int = WIDTH) -> DataFrame:
    """The first k rows of each scope with their number, `nth`: at most k rows of a range go on to where the scope meets."""
    marked = rows if RANGE in rows.columns else ranged(rows, order, width)
    here = marked.withColumn("nth", F.row_number().over(Window.partitionBy(*scope, RANGE).orderBy(order))).filter(F.col("nth") <= k)
    return here.withColumn("nth", F.row_number().over(Window.partitionBy(*scope).orderBy(order))).filter(F.col("nth") <= k).drop(RANGE)
