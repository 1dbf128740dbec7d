"""Strict and lenient reads of VARIANT values (VAL-04, FN-28).

`try_variant_get(x, '$', 'bigint')` turns true into 1 and 1.5 into 1, so the type is looked at
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null if malformed."""
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID; null if the value is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def at(value: Column, path: str) -> Column:
    """Part of a VARIANT as a VARIANT; path as in `$.a['b.c']`."""
    return value if path == "$" else F.try_variant_get(value, path, "variant")


def _shape(tree: dict | None) -> str:
    return "variant" if tree is None else f"struct<{', '.join(f'`{k}`: {_shape(t)}' for k, t in tree.items())}>"


def opened(rows: DataFrame, column: str, tree: dict) -> DataFrame:
    """The fields of the objects in a VARIANT column, as columns of their own in place of it; null where absent.

    tree: names of fields; None keeps the value as a VARIANT, a dict opens the object in it, which
    gives a null struct where the value is no object. An object is gone through once for all its
    fields: they are generated as a row, so what is made of them doesn't look them up again.
    """
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.inline(F.array(F.try_variant_get(column, "$", _shape(tree)))))


def has(value: Column, path: str) -> Column:
    """Whether the key is there, with null or another value."""
    return at(value, path).isNotNull()


def text(value: Column, path: str) -> Column:
    """String at the path; null if absent or of another type."""
    part = at(value, path)
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))


def whole(value: Column, path: str, booleans: bool = False) -> Column:
    """64-bit whole number at the path; null if absent or of another type. booleans: true counts as 1."""
    part = at(value, path)
    of = F.schema_of_variant(part)
    good = of.isin("BIGINT", "BOOLEAN") if booleans else of == "BIGINT"
    return F.when(good, F.try_variant_get(part, "$", "bigint"))


def number(value: Column, path: str) -> Column:
    """Number at the path as double; null if absent or of another type."""
    part = at(value, path)
    return F.when(kind(part).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(part, "$", "double"))


def given(value: Column, path: str) -> Column:
    """Whether there is a value other than null."""
    part = at(value, path)
    return part.isNotNull() & ~F.is_variant_null(part)


def required_whole(value: Column, path: str, name: str) -> tuple[Column, Column]:
    """(value, error): error where the number is absent, null, boolean or no whole number."""
    got = whole(value, path)
    return got, F.when(got.isNull(), F.lit(f"{name}: expected a whole number"))


def optional_whole(value: Column, path: str, name: str, default: int | None = None) -> tuple[Column, Column]:
    """(value, error): absent and null give the default."""
    got = whole(value, path)
    error = F.when(given(value, path) & got.isNull(), F.lit(f"{name}: expected a whole number or null"))
    return (got if default is None else F.coalesce(got, F.lit(default).cast("long"))), error


def optional_text(value: Column, path: str, name: str) -> tuple[Column, Column]:
    got = text(value, path)
    return got, F.when(given(value, path) & got.isNull(), F.lit(f"{name}: expected a string or null"))


def optional_number(value: Column, path: str, name: str) -> tuple[Column, Column]:
    got = number(value, path)
    return got, F.when(given(value, path) & got.isNull(), F.lit(f"{name}: expected a number or null"))


def lenient_whole(value: Column, path: str = "$") -> Column:
    """Whole number of whatever is there: numbers are cut, digits in text are read, everything else is 0."""
    part = at(value, path)
    k = kind(part)
    cut = F.try_variant_get(part, "$", "double").cast("decimal(38,6)")
    return F.coalesce(
        F.when(k == "BIGINT", F.try_variant_get(part, "$", "bigint"))
        .when(k.isin("DOUBLE", "DECIMAL", "FLOAT"), (F.signum(cut) * F.floor(F.abs(cut))).try_cast("bigint"))
        .when(k == "BOOLEAN", F.try_variant_get(part, "$", "boolean").cast("long"))
        .when(k == "STRING", F.when(F.trim(F.try_variant_get(part, "$", "string")).rlike("^[+-]?[0-9]+$"), F.trim(F.try_variant_get(part, "$", "string")).try_cast("bigint"))),
        F.lit(0).cast("long"),
    )
