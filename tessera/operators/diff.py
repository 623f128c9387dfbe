"""Differences of two versions of a table, down to the cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import column, display


def _cells(df: DataFrame, names: Sequence[str], side: str) -> DataFrame:
    """Cells renamed by position and side, so equal names of both tables never clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"__{side}{i}") for i, c in enumerate(names)], F.lit(True).alias(f"__{side}"))


def _report(joined: DataFrame, left: DataFrame, right: DataFrame, left_names: Sequence[str], right_names: Sequence[str], li: Column, ri: Column) -> DataFrame:
    n = min(len(left_names), len(right_names))
    changes = []
    for i in range(max(len(left_names), len(right_names))):
        a = F.col(f"__l{i}") if i < len(left_names) else F.lit(None)
        b = F.col(f"__r{i}") if i < len(right_names) else F.lit(None)
        old = F.when(a.isNotNull(), display(a, left.schema[left_names[i]].dataType)) if i < len(left_names) else F.lit(None).cast("string")
        new = F.when(b.isNotNull(), display(b, right.schema[right_names[i]].dataType)) if i < len(right_names) else F.lit(None).cast("string")
        same = a.eqNullSafe(b) if i < n and left.schema[left_names[i]].dataType == right.schema[right_names[i]].dataType else F.coalesce(a.isNull() & b.isNull(), F.lit(False))
        changes.append(F.when(~same, F.struct(F.lit(i).alias("column_index"), old.alias("old"), new.alias("new"))))
    cells = F.filter(F.array(*changes), lambda x: x.isNotNull())
    kind = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "deleted").when(F.size(cells) > 0, "modified").otherwise("unchanged")
    index = F.when(F.col("__l").isNull(), ri).otherwise(li)
    return joined.select(kind.alias("kind"), index.alias("row_index"), F.when(kind == "modified", cells).otherwise(F.array().cast(cells_type())).alias("cells"))


def cells_type() -> str:
    return "array<struct<column_index:int,old:string,new:string>>"


def diff_keyed(left: DataFrame, right: DataFrame, key: str | int, index: str) -> DataFrame:
    """Rows matched by key: kind (added, deleted, modified, unchanged), row_index and changed cells.

    Of left rows with equal keys the last one (by ``index``) counts; every right row is looked up; null
    keys match each other. Added rows carry the right index, the others the left one. ``index`` is left
    out of the comparison.
    """
    ln, rn = [c for c in left.columns if c != index], [c for c in right.columns if c != index]
    key_name = column(left, key)[0]
    lk, rk = ln.index(key_name), rn.index(column(right, key)[0])
    last = left.groupBy(F.col(f"`{key_name}`").alias("__k")).agg(F.max(F.struct(F.col(f"`{index}`").alias("i"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))).alias("m")).select("m.row.*")
    a = _cells(last, [*ln, index], "l")
    b = _cells(right, [*rn, index], "r")
    joined = a.join(b, F.col(f"__l{lk}").eqNullSafe(F.col(f"__r{rk}")), "full")
    return _report(joined, left, right, ln, rn, F.col(f"__l{len(ln)}"), F.col(f"__r{len(rn)}"))


def diff_positional(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Rows matched by their index column."""
    ln, rn = [c for c in left.columns if c != index], [c for c in right.columns if c != index]
    a, b = _cells(left, [*ln, index], "l"), _cells(right, [*rn, index], "r")
    joined = a.join(b, F.col(f"__l{len(ln)}") == F.col(f"__r{len(rn)}"), "full")
    return _report(joined, left, right, ln, rn, F.col(f"__l{len(ln)}"), F.col(f"__r{len(rn)}"))


def diff_totals(left: DataFrame, right: DataFrame, report: DataFrame) -> DataFrame:
    """One row: left_rows, right_rows, added, deleted, modified, unchanged."""
    kinds = report.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "deleted", "modified", "unchanged")])
    sizes = left.agg(F.count("*").alias("left_rows")).join(right.agg(F.count("*").alias("right_rows")))
    return sizes.join(kinds)
