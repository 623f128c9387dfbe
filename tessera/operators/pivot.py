"""Pivot tables: one row key, one column key, a sum or a count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.values import as_float, column, display
from .filters import ColumnFilter, filter_rows

#: Distinct column keys that a pivot without declared values may find.
MAX_COLUMNS = 10_000


def pivot(df: DataFrame, row: str | int, col: str | int, value: str | int, op: str = "sum", filters: Sequence[ColumnFilter] = (), values: Sequence[str] | None = None) -> DataFrame:
    """Rows sorted by key, columns by their key's text. Rows with a null key are left out, a value that
    isn't a number counts as 0, a cell without rows is null. ``count`` counts rows."""
    if op not in ("sum", "count"):
        raise ConfigError(f"unknown pivot aggregate {op!r}")
    df = filter_rows(df, filters)
    (rn, r, rk), (_, c, ck), (_, v, vk) = column(df, row), column(df, col), column(df, value)
    cells = df.filter(r.isNotNull() & c.isNotNull()).select(display(r, rk).alias("__row"), display(c, ck).alias("__col"), F.coalesce(as_float(v, vk), F.lit(0.0)).alias("__v"))
    # Sums by both keys come first, so the wide step sees one row for each cell of the result.
    sums = cells.groupBy("__row", "__col").agg((F.sum("__v") if op == "sum" else F.count(F.lit(1)).cast("double")).alias("__v"))
    if values is None:
        found = [x[0] for x in cells.select("__col").distinct().orderBy("__col").limit(MAX_COLUMNS + 1).collect()]
        if len(found) > MAX_COLUMNS:
            raise ConfigError(f"more than {MAX_COLUMNS} column keys")
        values = found
    if not values:
        return cells.select(F.col("__row").alias(rn)).distinct()
    wide = sums.groupBy("__row").pivot("__col", list(values)).agg(F.first("__v"))
    return wide.orderBy("__row").withColumnRenamed("__row", rn)


def pivot_declared(df: DataFrame, row: str, col: str, value: str, values: Sequence[str], op: str = "sum") -> DataFrame:
    """The same as conditional sums over declared column keys; works on streams too."""
    (rn, r, rk), (_, c, ck), (_, v, vk) = column(df, row), column(df, col), column(df, value)
    number = F.coalesce(as_float(v, vk), F.lit(0.0)) if op == "sum" else F.lit(1.0)
    cells = df.filter(r.isNotNull() & c.isNotNull())
    return cells.groupBy(display(r, rk).alias(rn)).agg(*[F.sum(F.when(display(c, ck) == x, number)).alias(x) for x in values])
