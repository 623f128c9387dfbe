"""JSON lines and JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ReaderConfig
from ..functions.values import quoted


def read_json(spark: SparkSession, path: str, config: ReaderConfig | None = None, array: bool = False) -> DataFrame:
    """One object per line, or with ``array`` one array of objects per file.

    Nested values come back as JSON text, missing keys as null. Columns are in the order of their names
    unless ``column_names`` says otherwise. A line that isn't an object raises under FAILFAST.
    """
    config = (config or ReaderConfig()).validate()
    reader = spark.read.option("mode", config.mode).option("multiLine", str(array).lower())
    df = reader.json(path)
    if config.column_names is not None:
        have = set(df.columns)
        df = df.select(*[quoted(c) if c in have else F.lit(None).cast("string").alias(c) for c in config.column_names])
    flat = [F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else quoted(f.name) for f in df.schema]
    df = df.select(*flat)
    return df if config.max_rows is None else df.limit(config.max_rows)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
