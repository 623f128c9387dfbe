"""User functions: numeric plugins as Arrow functions, and rows as dataclasses."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Any, get_type_hints

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import INTEGERS, as_float, column, family, quoted


def numeric_plugin(function: Callable[[pd.Series], pd.Series]) -> Callable[[Column, T.DataType], Column]:
    """A function over batches of doubles. Integer columns get integers back, cut off; others are left alone."""
    udf = F.pandas_udf(lambda s: function(s).astype("float64"), "double")

    def apply(c: Column, kind: T.DataType) -> Column:
        if family(kind) != "number":
            return c
        out = udf(as_float(c, kind))
        return out.try_cast("bigint") if isinstance(kind, INTEGERS) else out

    return apply


def transform_column(df: DataFrame, at: str | int, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    name, c, kind = column(df, at)
    plugin = numeric_plugin(function)
    return df.select(*[plugin(c, kind).alias(name) if x == name else quoted(x) for x in df.columns])


_TYPES: dict[type, T.DataType] = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def row_schema(record: type) -> T.StructType:
    """The schema of a dataclass."""
    hints = get_type_hints(record)
    return T.StructType([T.StructField(f.name, _TYPES[next((a for a in getattr(hints[f.name], "__args__", ()) if a is not type(None)), hints[f.name])]) for f in dataclasses.fields(record)])


def to_table(spark: SparkSession, records: list[Any], record: type) -> DataFrame:
    return spark.createDataFrame([dataclasses.astuple(r) for r in records], row_schema(record))


def from_table(df: DataFrame, record: type) -> Iterator[Any]:
    """Records of a table, streamed partition by partition."""
    names = [f.name for f in dataclasses.fields(record)]
    for row in df.select(*names).toLocalIterator():
        yield record(*row)
