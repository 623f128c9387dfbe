"""SQL load scripts: INSERT statements and COPY payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.values import FLOATS, INTEGERS, display, quoted
from ..operators.mask import plain_float


def _hex(c: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def insert_value(c: Column, kind: T.DataType) -> Column:
    """A value as an SQL literal."""
    if isinstance(kind, T.BooleanType):
        text = F.upper(c.cast("string"))
    elif isinstance(kind, INTEGERS):
        text = c.cast("string")
    elif isinstance(kind, FLOATS):
        text = plain_float(c)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("'"), _hex(c), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(display(c, kind), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def insert_rows(df: DataFrame) -> DataFrame:
    """Each row as a tuple of literals, in the column ``value``."""
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *[insert_value(quoted(f.name), f.dataType) for f in df.schema]), F.lit(")")).alias("value"))


def insert_head(df: DataFrame, table: str) -> str:
    if not df.columns:
        raise ConfigError("a table without columns has no INSERT statement")
    return f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES\n"


def insert_statement(df: DataFrame, table: str, order: Sequence[str]) -> DataFrame:
    """One statement with all rows, in the order of the given columns: a table of one text, empty without rows.

    It is one value, so it suits tables that fit into one; :func:`write_inserts` has no such bound.
    """
    key = F.struct(*[quoted(c) for c in order])
    rows = df.select(key.alias("k"), F.concat(F.lit("("), F.concat_ws(", ", *[insert_value(quoted(f.name), f.dataType) for f in df.schema]), F.lit(")")).alias("value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), ",\n")
    return rows.agg(F.when(F.count("*") == 0, "").otherwise(F.concat(F.lit(insert_head(df, table)), joined, F.lit(";\n"))).alias("value"))


def write_inserts(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """One statement per row, written in parallel."""
    head = insert_head(df, table).rstrip("\n")
    insert_rows(df).select(F.concat(F.lit(head + " "), "value", F.lit(";")).alias("value")).write.mode(mode).text(path)


def copy_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, INTEGERS):
        text = c.cast("string")
    elif isinstance(kind, FLOATS):
        text = plain_float(c)
    elif isinstance(kind, T.BinaryType):
        text = _hex(c)
    else:
        plain = display(c, kind)
        needs = plain.contains(",") | plain.contains('"') | plain.contains("\n") | plain.contains("\r")
        text = F.when(needs, F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)
    return F.when(c.isNull(), "NULL").otherwise(text)


def copy_head(df: DataFrame, table: str) -> str:
    return f"COPY {table} ({', '.join(df.columns)}) FROM STDIN WITH (FORMAT csv, HEADER false, NULL 'NULL');"


def copy_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of a COPY payload."""
    return df.select(F.concat_ws(",", *[copy_value(quoted(f.name), f.dataType) for f in df.schema]).alias("value"))


def copy_script(df: DataFrame, table: str) -> str:
    """Statement, payload and end mark as one text on the driver."""
    return copy_head(df, table) + "\n" + "".join(r[0] + "\n" for r in copy_lines(df).toLocalIterator()) + "\\.\n"


def write_copy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Payload files, written in parallel; each can be sent after the statement of :func:`copy_head`."""
    copy_lines(df).write.mode(mode).text(path)
