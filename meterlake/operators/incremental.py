"""Incremental batches: file gate, checkpoints, insert-ignore, upsert (FLT-08..16, JOIN-05..08, AGG-11/13/14, WIN-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(rows: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """(scope, cp): the largest key, as a struct, of each scope; no scope gives one row."""
    largest = F.max(F.struct(*key)).alias("cp")
    return rows.groupBy(*scope).agg(largest) if scope else rows.agg(largest)


def after_checkpoint(rows: DataFrame, cps: DataFrame, scope: list[str], key: list[str], *, inclusive: bool) -> DataFrame:
    """Rows at or after (inclusive) or after (strict) the checkpoint of their scope; all where there is none.

    Scope columns are compared null-safely.
    """
    there = cps.select(*[F.col(c).alias(f"cp__{c}") for c in scope], F.col("cp").alias("cp__"))
    if scope:
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"cp__{c}")) for c in scope])
        joined = rows.join(there, on, "left")
    else:
        joined = rows.join(F.broadcast(there))  # one row
    here = F.struct(*key)
    passes = here >= F.col("cp__") if inclusive else here > F.col("cp__")
    return joined.filter(F.col("cp__").isNull() | passes).select(*rows.columns)


def next_checkpoint(old: Column, found: Column) -> Column:
    """Larger of both; a null gives the other."""
    return F.greatest(old, found)


def changed_files(current: DataFrame, prior: DataFrame, path: str = "file_path", state: tuple[str, ...] = ("file_size", "file_mtime")) -> DataFrame:
    """Files whose size or modification time isn't what it was at the last run, and new ones."""
    return current.join(prior.select(path, *state), [path, *state], "left_anti")


def source_is_newer(source_max: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(source_max, cp, go_on): whether there may be something to read; equal goes on, for rows of the same instant."""
    return source_max.join(checkpoint).withColumn("go_on", F.col("cp").isNull() | (F.col("source_max") >= F.col("cp")))


def file_rounds(files: DataFrame, session: list[str], path: str = "file_path") -> DataFrame:
    """Files with `round`: those of one session come in path order, one per round; rounds run one after another."""
    return files.withColumn("round", F.row_number().over(Window.partitionBy(*session).orderBy(path)))


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Rows to append: the first of each new key; keys that the target has are left alone."""
    first = incoming.withColumn("n__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n__ = 1").drop("n__")
    return first.join(target.select(*key), key, "left_anti").select(*incoming.columns)


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], order: list[Column | str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The new snapshot: incoming rows (the last of each key) replace those of the target.

    Columns in `keep` keep the target's value where it has the key.
    """
    columns = target.columns
    both = target.withColumn("new__", F.lit(0)).unionByName(incoming.select(*columns, *[c for c in incoming.columns if c not in columns]).withColumn("new__", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(*key)
    ranked = both.withColumn("n__", F.row_number().over(by.orderBy(F.desc("new__"), *order)))
    for c in keep:
        ranked = ranked.withColumn(c, F.coalesce(F.max(F.when(F.col("new__") == 0, F.struct(c))).over(by)[c], F.col(c)))
    return ranked.filter("n__ = 1").select(*columns)


def changed_rows(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of `new` that are absent from `old` or differ in a value (SNK-08)."""
    was = old.select(*key, F.struct(*values).alias("was__"))
    joined = new.join(was, key, "left")
    return joined.filter(~F.struct(*values).eqNullSafe(F.col("was__"))).select(*new.columns)
