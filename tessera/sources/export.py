"""Tables as plain Python, JSON and grid objects, for results of a size that fits the caller."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import FLOATS, INTEGERS, display, quoted


def _names(df: DataFrame) -> list[str]:
    return [c or f"col_{i}" for i, c in enumerate(df.columns)]


def _value(c: Column, kind: T.DataType) -> Column:
    """Booleans and numbers as they are, anything else as it is shown; null stays null."""
    if isinstance(kind, (T.BooleanType, *INTEGERS)):
        return c
    if isinstance(kind, FLOATS):
        return c.cast("double")
    return F.when(c.isNotNull(), display(c, kind))


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[_value(F.col(f"c{i}"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)])


def iter_dicts(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, fetched partition by partition."""
    names = _names(df)
    for r in plain(df).toLocalIterator():
        yield dict(zip(names, r, strict=True))


def to_dicts(df: DataFrame) -> list[dict]:
    return list(iter_dicts(df))


def to_column_dict(df: DataFrame) -> dict[str, list]:
    rows = plain(df).collect()
    return {n: [r[i] for r in rows] for i, n in enumerate(_names(df))} if rows else {}


def to_polars(df: DataFrame):
    """A Polars frame, where Polars is installed."""
    import polars

    return polars.from_arrow(df.toArrow())


def json_objects(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, made on the executors: column ``value``. Nulls are kept; what JSON can't hold is 0."""
    fields = []
    for f in df.schema:
        v = _value(quoted(f.name), f.dataType)
        fields.append((F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v) if isinstance(f.dataType, FLOATS) else v).alias(f.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def to_grid(df: DataFrame) -> dict:
    """Column definitions and rows for a grid on a page."""
    return {"columnDefs": [{"headerName": c, "field": c, "sortable": True, "filter": True} for c in _names(df)], "rowData": to_dicts(df)}
