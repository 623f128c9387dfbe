"""Workbooks as tables, in both formats."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FileFormat, ReaderConfig, WriterConfig
from ..errors import WorkbookError
from ..functions.values import quoted
from ..operators.schema import promote
from . import ods, xlsx
from .crypto import decrypt_ods, decrypt_workbook, is_encrypted, ods_is_encrypted
from .storage import read_object, write_object

_RAW = "path string, sheet string, sheet_index int, row bigint, kinds array<string>, cells array<string>"
#: Kinds of cells by the column kind that they vote for.
_VOTE = {"bool": "bool", "int": "int", "float": "float", "string": "string", "error": "string", "time": "string", "date": "date", "datetime": "datetime"}


def _open(path: str, data: bytes):
    if FileFormat.from_path(path) is FileFormat.ODS:
        return ods.Workbook(data)
    return xlsx.Workbook(data)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Names and positions of the sheets, without reading cells."""
    book = _open(path, read_object(spark, path))
    return spark.createDataFrame([(i, n) for i, (n, _) in enumerate(book.sheets)], "position int, name string")


def _wanted(config: ReaderConfig) -> Callable[[int, str], bool]:
    if config.all_sheets:
        return lambda i, name: True
    if isinstance(config.sheet, str):
        return lambda i, name: name == config.sheet
    return lambda i, name: i == (config.sheet or 0)


def raw_cells(spark: SparkSession, path: str, config: ReaderConfig) -> DataFrame:
    """Rows of the wanted sheets as kinds and texts; the header is row -1.

    Files are read by the engine and parsed in the executors: a task for each sheet of each file, so a
    workbook with many sheets is read in parallel. Rows are skipped before the header.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path", "content").first()
    if first is None:
        raise WorkbookError(f"nothing at {path}")
    data = bytes(first["content"])
    key = config.password
    own = FileFormat.from_path(path) is FileFormat.ODS
    if ods_is_encrypted(data) if own else is_encrypted(data):
        if key is None:
            raise WorkbookError("the workbook is encrypted; a password is needed")
        files = spark.createDataFrame([(first["path"], bytearray((decrypt_ods if own else decrypt_workbook)(spark, data, key)))], "path string, content binary")
        data = bytes(files.first()["content"])
    names = [n for n, _ in _open(first["path"], data).sheets]
    wanted = _wanted(config)
    numbers = [i for i, n in enumerate(names) if wanted(i, n)]
    if not numbers:
        raise WorkbookError(f"no sheet {config.sheet!r} among {names}")
    skip, header, blank = config.skip_rows, config.has_header, config.include_empty_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, at in zip(batch["path"], batch["content"], batch["at"], strict=True):
                book = _open(file, bytes(content))
                if at >= len(book.sheets):
                    continue
                name, part = book.sheets[at]
                out, seen, top, last = [], 0, header, -1

                def frame(rows: list, name: str = name, file: str = file, at: int = at) -> pd.DataFrame:
                    return pd.DataFrame({"path": file, "sheet": name, "sheet_index": at, "row": [r[0] for r in rows], "kinds": [r[1] for r in rows], "cells": [r[2] for r in rows]})

                for number, cells in book.rows(part):
                    if number < skip:
                        continue
                    empty = all(k == "null" for k, _ in cells)
                    if top:
                        if empty:
                            continue
                        top, last = False, number
                        out.append((-1, ["string"] * len(cells), [t or "" for _, t in cells]))
                        continue
                    if empty and not blank:
                        continue
                    if blank:
                        for _ in range(last + 1, number):
                            out.append((seen, [], []))
                            seen += 1
                    last = number
                    out.append((seen, [k for k, _ in cells], [t for _, t in cells]))
                    seen += 1
                    if len(out) >= 4096:
                        yield frame(out)
                        out = []
                if out:
                    yield frame(out)

    work = files.select("path", "content", F.explode(F.array(*[F.lit(i) for i in numbers])).alias("at"))
    return work.repartition(len(numbers), "at").mapInPandas(run, _RAW) if len(numbers) > 1 else work.mapInPandas(run, _RAW)


def _typed(text: Column, kind: Column, target: str) -> Column:
    if target == "bool":
        return F.when(kind == "bool", text == "TRUE")
    if target == "int":
        return F.when(kind == "int", text.try_cast("bigint"))
    if target == "float":
        return F.when(kind.isin("int", "float"), text.try_cast("double"))
    if target == "date":
        return F.when(kind == "date", text.try_cast("date"))
    if target == "datetime":
        return F.when(kind.isin("date", "datetime"), text.try_cast("timestamp_ntz"))
    return F.when(kind != "null", text)


def read_workbook(spark: SparkSession, path: str, config: ReaderConfig | None = None) -> DataFrame:
    """A table from a sheet, or with ``all_sheets`` from all, with the sheet's name in ``_sheet``.

    ``_row`` numbers the data rows of a sheet. Each column gets the type that its cells vote for; mixed
    columns become text, cells that their column's type can't hold become null, and error values keep
    their texts.
    """
    config = (config or ReaderConfig()).validate()
    raw = raw_cells(spark, path, config)
    flat = raw.select("row", F.posexplode(F.arrays_zip("kinds", "cells")).alias("pos", "c"))
    votes = flat.groupBy("pos").agg(F.min(F.when(F.col("row") == -1, F.col("c.cells"))).alias("header"), *[F.count_if((F.col("row") >= 0) & F.col("c.kinds").isin([a for a, b in _VOTE.items() if b == k])).alias(k) for k in ("bool", "int", "float", "string", "date", "datetime")])
    found = {r["pos"]: r for r in votes.collect()}
    width = max(found) + 1 if found else 0
    names: list[str] = []
    for i in range(width):
        name = (found[i]["header"] if i in found and config.has_header else None) or f"column_{i}"
        names.append(name if name not in names else f"{name}_{i}")
    kinds = [promote({k: found[i][k] for k in ("bool", "int", "float", "string", "date", "datetime")}) if i in found else "string" for i in range(width)]
    keep = list(range(width))
    if config.columns is not None:
        keep = [i for i in config.columns if i < width]
    elif config.column_names is not None:
        keep = [names.index(n) for n in config.column_names]
    data = raw.filter("row >= 0")
    if config.max_rows is not None:
        data = data.filter(F.col("row") < config.max_rows)
    cells = [_typed(F.get("cells", F.lit(i)), F.coalesce(F.get("kinds", F.lit(i)), F.lit("null")), kinds[i]).alias(names[i]) for i in keep]
    return data.select(*([F.col("sheet").alias("_sheet")] if config.all_sheets else []), F.col("row").alias("_row"), *cells)


def _python_rows(df: DataFrame, order: list[str] | None) -> Iterator[list]:
    shown = [quoted(f.name) if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else quoted(f.name).cast("double" if isinstance(f.dataType, T.DecimalType) else "string") for f in df.schema]
    rows = (df.orderBy(*order) if order else df).select(*shown)
    for r in rows.toLocalIterator():
        yield list(r)


def workbook_bytes(df: DataFrame, format: FileFormat, config: WriterConfig | None = None, order: list[str] | None = None, template: xlsx.Style | None = None) -> tuple[bytes, int]:
    """The table as a workbook of one sheet, and its rows. Rows stream through the driver partition by
    partition; a sheet holds about a million rows at most, so a workbook is never large data."""
    out, config = io.BytesIO(), config or WriterConfig()
    if format is FileFormat.XLSX:
        widths = None
        if config.auto_width and df.columns:
            row = df.agg(*[F.max(F.char_length(quoted(c).cast("string"))).alias(f"w{i}") for i, c in enumerate(df.columns)]).first()
            widths = [max(len(c), row[i] or 0) for i, c in enumerate(df.columns)]
        writer = xlsx.XlsxWriter(out, df.columns, config, template, widths)
    else:
        writer = ods.OdsWriter(out, df.columns, config)
    for r in _python_rows(df, order):
        writer.write(r)
    n = writer.finish()
    return out.getvalue(), n


def write_workbook(df: DataFrame, path: str, config: WriterConfig | None = None, order: list[str] | None = None, template: xlsx.Style | None = None) -> int:
    """Write a workbook to any store and return the number of data rows."""
    data, n = workbook_bytes(df, FileFormat.from_path(path), config, order, template)
    write_object(df.sparkSession, path, data)
    return n
