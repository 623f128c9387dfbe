"""Projection, renaming, computed columns and type coercion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import INTEGERS, as_float, as_int, column, display, family, quoted

DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")


def select_columns(df: DataFrame, at: Sequence[int | str]) -> DataFrame:
    """Columns in the given order, repeats allowed; a position out of range gives nulls under the name ''."""
    out = []
    for c in at:
        if isinstance(c, int) and not 0 <= c < len(df.columns):
            out.append(F.lit(None).cast("string").alias(""))
        else:
            name, col, _ = column(df, c)
            out.append(col.alias(name))
    return df.select(*out)


reorder_columns = select_columns


def rename_columns(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The first matching pair names a column; names are compared with case."""
    first: dict[str, str] = {}
    for old, new in pairs:
        first.setdefault(old, new)
    return df.toDF(*[first.get(c, c) for c in df.columns])


def add_column(df: DataFrame, name: str, value: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """A computed column, appended last."""
    return df.select("*", (value(df) if callable(value) and not isinstance(value, Column) else value).alias(name))


def coerced(c: Column, kind: T.DataType, target: str, text: Callable[[Column, T.DataType], Column] = display) -> Column:
    """A column as ``target`` (string, int, float, bool, date or datetime; strings by ``text``); what can't be read gives null."""
    source = family(kind)
    if target == "string":
        return text(c, kind)
    if target == "int":
        if source == "string":
            return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))
        return as_int(c, kind)
    if target == "float":
        if source == "string":
            return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
        return as_float(c, kind)
    if target == "bool":
        if source == "bool":
            return c
        if isinstance(kind, INTEGERS):
            return c != 0
        return F.lower(c).isin("true", "yes", "1") if source == "string" else F.lit(None).cast("boolean")
    if target == "date":
        if source == "date":
            return c
        if source == "time":
            return c.cast("date")
        if source == "string":
            shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$")
            return F.coalesce(*[F.when(c.rlike(s), F.try_to_timestamp(c, F.lit(f.replace("MM", "M").replace("dd", "d"))).cast("date")) for s, f in zip(shapes, DATE_FORMATS, strict=True)])
        return F.lit(None).cast("date")
    if target == "datetime":
        if source in ("date", "time"):
            return c.cast("timestamp_ntz")
        if source == "string":
            # With an offset the moment is taken to UTC; without one the text is naive already.
            offset = F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.to_utc_timestamp(F.try_to_timestamp(F.upper(c)), F.current_timezone()).cast("timestamp_ntz"))
            naive = F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), c.try_cast("timestamp_ntz"))
            return F.coalesce(offset, naive)
        return F.lit(None).cast("timestamp_ntz")
    return c


def coerce_column(df: DataFrame, at: str | int, target: str) -> DataFrame:
    name, c, kind = column(df, at)
    return df.select(*[coerced(c, kind, target).alias(name) if x == name else quoted(x) for x in df.columns])
