"""Sorting, limits and offsets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions.values import column


@dataclass(frozen=True)
class SortKey:
    """Descending order turns the whole order round, nulls included: with ``nulls_first`` they come last."""

    at: str | int
    descending: bool = False
    nulls_first: bool = False

    def order(self, df: DataFrame) -> Column:
        _, c, _ = column(df, self.at)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_first else c.desc_nulls_first()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def sort_rows(df: DataFrame, keys: Sequence[SortKey], tie: Sequence[str] = ()) -> DataFrame:
    """A total sort; ``tie`` names columns (a row index) that make it stable."""
    return df.orderBy(*[k.order(df) for k in keys], *tie)


def sort_within(df: DataFrame, keys: Sequence[SortKey], tie: Sequence[str] = ()) -> DataFrame:
    """Sorts each partition, without an exchange."""
    return df.sortWithinPartitions(*[k.order(df) for k in keys], *tie)


def top(df: DataFrame, keys: Sequence[SortKey], n: int, tie: Sequence[str] = ()) -> DataFrame:
    return sort_rows(df, keys, tie).limit(n)


def page(df: DataFrame, keys: Sequence[SortKey], skip: int = 0, take: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Rows from ``skip`` on, ``take`` of them."""
    out = sort_rows(df, keys, tie)
    out = out.offset(skip) if skip else out
    return out if take is None else out.limit(take)
