"""Turns and their boundaries (WIN-06..08, JOIN-09/10, AGG-17..21, ORD-06..08)."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import scans


def attributed(rows: DataFrame, file: list[str], line: str, sets: Column, value: Column, name: str, *, width: int = scans.WIDTH) -> DataFrame:
    """As-of value: that of the last row at or above where `sets` holds; a null that was set stays null (JOIN-09)."""
    found = scans.last_set(rows, file, line, F.when(sets, F.struct(value.alias("v"))), name, inclusive=True, width=width)
    return found.withColumn(name, F.col(f"{name}.v"))


def segments(rows: DataFrame, file: list[str], line: str, is_turn: Column, *, width: int = scans.WIDTH) -> DataFrame:
    """Adds `segment`: number of turn starts at or above the row, 0 before the first."""
    return scans.running_sum(rows, file, line, is_turn, "segment", width=width)


def per_turn(segmented: DataFrame, file: list[str], line: str, is_turn: Column, total: str) -> DataFrame:
    """Per turn: its line, token rows, token rows with a total, distinct totals; segment 0 holds the orphans."""
    token = ~is_turn
    return segmented.groupBy(*file, "segment").agg(
        F.min(F.when(is_turn, F.col(line))).alias("turn_line"), F.count_if(token).alias("token_rows"),
        F.count_if(token & F.col(total).isNotNull()).alias("with_total"), F.countDistinct(F.when(token, F.col(total))).alias("distinct_totals"),
    )


def boundaries(segmented: DataFrame, file: list[str], line: str, is_turn: Column, total: str, *, width: int = scans.WIDTH) -> DataFrame:
    """Per turn: the last total above it, and the first and second total inside it, with their lines.

    The last total travels down between ranges of lines; of each range and turn at most two
    totals travel to where the turn meets, however many ranges it spans.
    """
    seen = F.when(~is_turn & F.col(total).isNotNull(), F.struct(F.col(total).alias("total"), F.col(line).alias("line")))
    rows = segmented.select(*file, "segment", line, is_turn.alias("turn__"), seen.alias("seen__"))
    rows = scans.last_set(rows, file, line, F.col("seen__"), "prior__", inclusive=False, width=width, keep_range=True).filter("segment > 0")
    starts = rows.filter("turn__").select(*file, "segment", F.col(line).alias("turn_line"), F.col("prior__").alias("p"))
    few = scans.first_few(rows.filter(F.col("seen__").isNotNull()), [*file, "segment"], line, 2).select(*file, "segment", "seen__", "nth")
    nth = lambda n: F.max(F.when(F.col("nth") == n, F.col("seen__")))
    both = starts.unionByName(few, allowMissingColumns=True)
    out = both.groupBy(*file, "segment").agg(F.min("turn_line").alias("turn_line"), F.max("p").alias("p"), nth(1).alias("a"), nth(2).alias("b"))
    return out.select(
        *file, "segment", "turn_line", F.col("p.total").alias("previous_total"), F.col("p.line").alias("previous_line"), F.col("a.total").alias("first_total"), F.col("a.line").alias("first_line"),
        F.col("b.total").alias("second_total"), F.col("b.line").alias("second_line"), (F.col("a.total") - F.col("p.total")).alias("first_delta"), (F.col("b.total") - F.col("a.total")).alias("second_delta"),
    )


#: Bins of the value range that a round of selection counts.
BINS = 1024


def order_statistics(values: DataFrame, value: str, ranks: set[int], low: float, high: float) -> dict[int, float]:
    """The values at ranks (from 0) in ascending order, by rounds of counting.

    A round cuts the ranges that hold wanted ranks into BINS bins and counts the rows of each,
    with the least and largest value found; a bin of one value answers its ranks, others are
    the next round's ranges. No task or the driver holds more than BINS rows per wanted rank,
    and a range shrinks to a BINS-th of its width at least. Values must be finite.
    """
    found: dict[int, float] = {}
    spans = [(low, high, 0, sorted(ranks))]  # ends, rows below, wanted ranks
    while spans:
        v = F.col(value).cast("double")
        at = F.lit(None).cast("int")
        for k, (a, b, _, _) in enumerate(spans):
            at = F.when((v >= a) & (v <= b), F.lit(k)).otherwise(at)
        ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _, _ in spans])
        placed = values.select(v.alias("v"), at.alias("span")).filter(F.col("span").isNotNull()).withColumn("ends", F.get(ends, F.col("span")))
        share = F.try_divide(F.col("v") - F.col("ends.a"), F.col("ends.b") - F.col("ends.a"))
        place = F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)).cast("int").alias("bin")
        counted = placed.groupBy("span", place).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("span", "bin").collect()
        following = []
        for k, (_, _, below, wanted) in enumerate(spans):
            for row in (r for r in counted if r["span"] == k):
                mine = [r for r in wanted if below <= r < below + row["n"]]
                if mine and row["least"] == row["most"]:
                    found.update(dict.fromkeys(mine, row["least"]))
                elif mine:
                    following.append((row["least"], row["most"], below, mine))
                below += row["n"]
        spans = following
    return found


def metric_summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, median, p90, p95, max with linear interpolation; zeros if there is no value."""
    values = written(rows.select(value).filter(F.col(value).isNotNull()), "values")
    n, mean, low, high = values.agg(F.count("*"), F.avg(value), F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))).first()
    places = {name: (n - 1) * q for name, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))}
    at = order_statistics(values, value, {r for p in places.values() for r in (floor(p), ceil(p))}, low, high) if n else {}
    between = lambda p: at[floor(p)] + (p - floor(p)) * (at[ceil(p)] - at[floor(p)]) if n else 0.0
    out = {"n": n, "mean": float(mean or 0.0), **{k: float(between(p)) for k, p in places.items()}, "max": float(high or 0.0)}
    return rows.sparkSession.createDataFrame([tuple(out.values())], "n long, mean double, median double, p90 double, p95 double, max double")


def top_frequencies(rows: DataFrame, value: str, k: int, seen: list[str]) -> DataFrame:
    """The k most frequent values with their share in percent; ties in order of first appearance."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(F.struct(*seen)).alias("first__"))
    total = rows.agg(F.count(value).alias("total__"))
    best = counted.orderBy(F.desc("n"), "first__").limit(k)
    return best.join(F.broadcast(total)).select(value, "n", (100.0 * F.col("n") / F.col("total__")).alias("share"))


def match_rates(windows: DataFrame) -> DataFrame:
    """One row: windows with both totals, those whose first equals the previous, those whose second exceeds the first, in percent."""
    eligible = F.col("previous_total").isNotNull() & F.col("first_total").isNotNull()
    same = eligible & (F.col("first_total") == F.col("previous_total"))
    rises = eligible & F.coalesce(F.col("second_total") > F.col("first_total"), F.lit(False))
    n = F.count_if(eligible)
    percent = lambda c: F.coalesce(F.try_divide(100.0 * F.count_if(c), n), F.lit(0.0))
    return windows.agg(F.count("*").alias("windows"), n.alias("eligible"), F.count_if(same).alias("same"), percent(same).alias("same_percent"), F.count_if(rises).alias("rises"), percent(rises).alias("rises_percent"))


def mismatches(windows: DataFrame, file: list[str], k: int) -> DataFrame:
    """The first k windows whose first total isn't the previous one, in scan order."""
    return windows.filter(F.col("first_total") != F.col("previous_total")).orderBy(*file, "turn_line").limit(k)


def one_id_per_file(rows: DataFrame, file: list[str], line: str, session: Column, name: str = "session_id", *, width: int = scans.WIDTH) -> DataFrame:
    """Adds session_id: the first one in the file, on every row of it, also earlier ones (JOIN-10)."""
    return scans.first_in_scope(rows, file, line, session, name, width=width)
