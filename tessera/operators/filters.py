"""Row filters with two-valued logic: a condition is true or false, never unknown."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.values import both, column, equals, family, matches, orders

COMPARISONS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass(frozen=True)
class ColumnFilter:
    """One condition. ``op``: eq, not_eq, gt, gte, lt, lte, contains, starts_with, ends_with, is_null, is_not_null, regex."""

    at: str | int
    op: str
    value: object = None

    def condition(self, df: DataFrame) -> Column:
        if isinstance(self.at, int) and self.at >= len(df.columns):
            # A cell that isn't there is null.
            return F.lit(self.op == "is_null" or (self.op == "eq" and self.value is None) or (self.op == "not_eq" and self.value is not None))
        _, c, kind = column(df, self.at)
        if self.op == "eq":
            return equals(c, kind, self.value)
        if self.op == "not_eq":
            return ~equals(c, kind, self.value)
        if self.op in COMPARISONS:
            return orders(c, kind, COMPARISONS[self.op], self.value)
        if self.op in ("contains", "starts_with", "ends_with"):
            if family(kind) != "string" or not isinstance(self.value, str):
                return F.lit(False)
            return F.coalesce({"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[self.op](self.value), F.lit(False))
        if self.op == "is_null":
            return c.isNull()
        if self.op == "is_not_null":
            return c.isNotNull()
        if self.op == "regex":
            return matches(c, kind, str(self.value))
        raise ConfigError(f"unknown operator {self.op!r}")


def filter_rows(df: DataFrame, filters: Sequence[ColumnFilter | Column | Callable[[DataFrame], Column]]) -> DataFrame:
    """Rows for which all conditions hold."""
    conditions = [f.condition(df) if isinstance(f, ColumnFilter) else f if isinstance(f, Column) else f(df) for f in filters]
    return df.filter(both(conditions)) if conditions else df
