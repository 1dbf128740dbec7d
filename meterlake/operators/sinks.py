"""Text and CSV outputs (SNK-13..16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(records: DataFrame, path: str) -> None:
    """Add JSON texts (column value) as lines to a folder of part files."""
    records.select("value").write.mode("append").text(path)


def write_lines(records: DataFrame, path: str) -> None:
    """Write JSON texts to a new folder."""
    records.select("value").write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; booleans as 0 and 1, nulls as empty fields."""
    flags = {c: F.col(c).cast("int") for c, kind in rows.dtypes if kind == "boolean"}
    rows.withColumns(flags).write.option("header", "true").option("emptyValue", "").csv(path)
