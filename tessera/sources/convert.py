"""Loading by file name, and conversions between formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import FileFormat, ReaderConfig, WriterConfig
from ..operators.fuzzy import fuzzy_left_join
from .columnar import read_arrow, read_parquet
from .csv import read_csv, to_csv_text
from .json import read_json
from .rows import with_row_index
from .storage import write_object
from .workbook import read_workbook, write_workbook


def load(spark: SparkSession, path: str, config: ReaderConfig | None = None) -> DataFrame:
    """A table from a file of any known kind, by its extension."""
    config = config or ReaderConfig()
    kind = FileFormat.from_path(path)
    if kind is FileFormat.TSV:
        return read_csv(spark, path, config.but(delimiter=config.delimiter or "\t"))
    if kind is FileFormat.CSV:
        return read_csv(spark, path, config)
    if kind in (FileFormat.XLSX, FileFormat.ODS):
        return read_workbook(spark, path, config)
    if kind is FileFormat.JSON:
        return read_json(spark, path, config)
    return read_parquet(spark, path, config) if kind is FileFormat.PARQUET else read_arrow(spark, path)


def fuzzy_join_files(spark: SparkSession, left: str, right: str, left_key: str, right_key: str, threshold: float, config: ReaderConfig | None = None) -> DataFrame:
    """The fuzzy left join of two files of any known kind; of equal matches the right file's first row counts."""
    other = load(spark, right, config)
    numbered = other.withColumnRenamed("_row", "__order") if "_row" in other.columns else with_row_index(other, "__order")
    return fuzzy_left_join(load(spark, left, config), numbered, left_key, right_key, threshold, ["__order"]).drop("__order")


def csv_to_workbook(spark: SparkSession, source: str, target: str, reader: ReaderConfig | None = None, writer: WriterConfig | None = None) -> int:
    """Rows converted."""
    return write_workbook(read_csv(spark, source, reader), target, writer)


def workbook_to_csv(spark: SparkSession, source: str, target: str, reader: ReaderConfig | None = None, writer: WriterConfig | None = None) -> int:
    df = read_workbook(spark, source, reader).orderBy("_row")
    text = to_csv_text(df.drop("_row"), writer)
    write_object(spark, target, text.encode((writer or WriterConfig()).encoding))
    return df.count()
