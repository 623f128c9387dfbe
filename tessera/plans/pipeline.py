"""A pipeline of steps with one fixed order, whatever the order of the calls:
filter, coerce, mask, computed columns, select, rename, sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from ..operators.filters import ColumnFilter, filter_rows
from ..operators.mask import mask_column
from ..operators.project import add_column, coerce_column, rename_columns, select_columns
from ..operators.sort import SortKey, sort_rows

Condition = ColumnFilter | Column | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Pipeline:
    filters: tuple[Condition, ...] = ()
    coercions: tuple[tuple[str | int, str], ...] = ()
    masks: tuple[tuple[str | int, str, dict], ...] = ()
    computed: tuple[tuple[str, Column | Callable[[DataFrame], Column]], ...] = ()
    selected: tuple[int | str, ...] | None = None
    renames: tuple[tuple[str, str], ...] = ()
    keys: tuple[SortKey, ...] = field(default=())

    def filter(self, at: str | int, op: str, value: object = None) -> Pipeline:
        return replace(self, filters=(*self.filters, ColumnFilter(at, op, value)))

    def where(self, condition: Column | Callable[[DataFrame], Column]) -> Pipeline:
        return replace(self, filters=(*self.filters, condition))

    def coerce(self, at: str | int, target: str) -> Pipeline:
        return replace(self, coercions=(*self.coercions, (at, target)))

    def mask(self, at: str | int, how: str, **options) -> Pipeline:
        return replace(self, masks=(*self.masks, (at, how, options)))

    def add_column(self, name: str, value: Column | Callable[[DataFrame], Column]) -> Pipeline:
        return replace(self, computed=(*self.computed, (name, value)))

    def select(self, *at: int | str) -> Pipeline:
        return replace(self, selected=at)

    def rename(self, old: str, new: str) -> Pipeline:
        return replace(self, renames=(*self.renames, (old, new)))

    def sort_by(self, at: str | int, descending: bool = False, nulls_first: bool = False) -> Pipeline:
        return replace(self, keys=(*self.keys, SortKey(at, descending, nulls_first)))

    def apply(self, df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
        """All steps as one plan. Without rows the result is an empty table."""
        df = filter_rows(df, self.filters)
        for at, target in self.coercions:
            df = coerce_column(df, at, target)
        for at, how, options in self.masks:
            df = mask_column(df, at, how, **options)
        for name, value in self.computed:
            df = add_column(df, name, value)
        if self.selected is not None:
            df = select_columns(df, self.selected)
        df = rename_columns(df, self.renames) if self.renames else df
        return sort_rows(df, self.keys, tie) if self.keys else df
