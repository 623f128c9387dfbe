"""Aggregates over a whole table (or groups, which the engine gives for free)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.values import as_float, column, display


@dataclass(frozen=True)
class AggregateSpec:
    """``op``: sum, count, avg, min, max, count_distinct, approx_distinct, variance or stddev."""

    at: str | int
    op: str
    alias: str | None = None

    def expression(self, df: DataFrame) -> Column:
        name, c, kind = column(df, self.at)
        number = as_float(c, kind)
        real = F.nanvl(number, F.lit(None).cast("double"))
        found = {
            "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
            "count": lambda: F.count(c),
            "avg": lambda: F.avg(number),
            "min": lambda: F.min(real),
            "max": lambda: F.max(real),
            "count_distinct": lambda: F.countDistinct(F.when(c.isNotNull(), display(c, kind))),
            "approx_distinct": lambda: F.approx_count_distinct(F.when(c.isNotNull(), display(c, kind))),
            "variance": lambda: F.var_pop(number),
            "stddev": lambda: F.stddev_pop(number),
        }
        if self.op not in found:
            raise ConfigError(f"unknown aggregate {self.op!r}")
        return found[self.op]().alias(self.alias or f"{self.op}_{name}")


def aggregate(df: DataFrame, specs: Sequence[AggregateSpec], by: Sequence[str] = ()) -> DataFrame:
    """One row of aggregates, or one per group. An empty table sums to 0 and counts 0; the rest is null."""
    out = [s.expression(df) for s in specs]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)
