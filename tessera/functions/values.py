"""How values are shown, compared and converted. Every operator takes its null logic from here."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound

EPSILON = 2.220446049250313e-16
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGERS + FLOATS


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(df: DataFrame, at: str | int) -> tuple[str, Column, T.DataType]:
    """Name, column and type of a column given by name or position."""
    if isinstance(at, int):
        if not 0 <= at < len(df.columns):
            raise ColumnNotFound(f"column {at} of {len(df.columns)}")
        at = df.columns[at]
    if at not in df.columns:
        raise ColumnNotFound(f"no column {at!r} among {df.columns}")
    return at, quoted(at), df.schema[at].dataType


def display(c: Column, kind: T.DataType) -> Column:
    """The text of a value: TRUE/FALSE, floats with up to ten decimals, null as ''."""
    if isinstance(kind, T.BooleanType):
        text = F.upper(c.cast("string"))
    elif isinstance(kind, FLOATS):
        d = c.cast("double")
        fixed = F.regexp_replace(F.regexp_replace(F.printf(F.lit("%.10f"), d), "0+$", ""), r"\.$", "")
        text = F.when(F.isnan(d) | (F.abs(d) == float("inf")), d.cast("string")).when(d.isNotNull(), fixed)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, T.DayTimeIntervalType):
        text = F.concat(display(c.cast("interval second").cast("decimal(18,6)"), T.DoubleType()), F.lit("s"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def sql_text(c: Column, kind: T.DataType) -> Column:
    """The text that a cast in SQL gives: null stays null, floats keep all their digits, whole ones read like integers.

    Java 17 doesn't always find the shortest text of a float, so other floats go through Python, in Arrow batches.
    """
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    d = c if isinstance(kind, T.DoubleType) else c.cast("string").cast("double")
    shortest = F.pandas_udf(lambda s: pd.Series([repr(x) for x in s.tolist()], dtype=object), "string")
    whole = d.try_cast("bigint")
    return F.when((whole.cast("double") == d) & (d < 2.0**63), whole.cast("string")).when(d.isNotNull(), shortest(d))


def as_float(c: Column, kind: T.DataType) -> Column:
    """Numbers as doubles; text and booleans are not numeric and give null."""
    return c.cast("double") if isinstance(kind, NUMERIC) else F.lit(None).cast("double")


def as_int(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, INTEGERS):
        return c.cast("bigint")
    return c.try_cast("bigint") if isinstance(kind, FLOATS) else F.lit(None).cast("bigint")


def family(kind: T.DataType) -> str:
    for name, types in (("bool", (T.BooleanType,)), ("number", NUMERIC), ("string", (T.StringType,)), ("date", (T.DateType,)), ("time", (T.TimestampType, T.TimestampNTZType))):
        if isinstance(kind, types):
            return name
    return "other"


def literal_family(value: object) -> str:
    for name, types in (("bool", bool), ("number", (int, float)), ("string", str), ("time", dt.datetime), ("date", dt.date)):
        if isinstance(value, types):
            return name
    return "null" if value is None else "other"


def literal(value: object) -> Column:
    if isinstance(value, dt.datetime):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(value)


def equals(c: Column, kind: T.DataType, value: object) -> Column:
    """Two-valued equality with a literal: null equals null, kinds never equal each other but for numbers."""
    if value is None:
        return c.isNull()
    if family(kind) != literal_family(value):
        return F.lit(False)
    if isinstance(value, float) or isinstance(kind, FLOATS) and family(kind) == "number":
        return F.coalesce(F.abs(c.cast("double") - F.lit(float(value))) < EPSILON, F.lit(False))
    return c.eqNullSafe(literal(value))


def orders(c: Column, kind: T.DataType, op: str, value: object, booleans: bool = False) -> Column:
    """Comparison with a literal; null, unlike kinds and (unless asked for) booleans give false."""
    if value is None or family(kind) != literal_family(value) or family(kind) == "other" or (family(kind) == "bool" and not booleans):
        return F.lit(False)
    v = literal(value)
    found = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    return F.coalesce(found, F.lit(False))


def safe_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def matches(c: Column, kind: T.DataType, pattern: str) -> Column:
    """Unanchored match of string values; an invalid pattern matches nothing."""
    if family(kind) != "string" or not safe_pattern(pattern):
        return F.lit(False)
    return F.coalesce(c.rlike(pattern), F.lit(False))


def trimmed(c: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
