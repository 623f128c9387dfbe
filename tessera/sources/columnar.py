"""Parquet and Arrow."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import ReaderConfig
from ..functions.values import quoted
from .storage import read_object, write_object


def read_parquet(spark: SparkSession, path: str, config: ReaderConfig | None = None) -> DataFrame:
    """All types at full fidelity; column lists prune the scan."""
    config = (config or ReaderConfig()).validate()
    df = spark.read.parquet(path)
    if config.column_names is not None:
        df = df.select(*[quoted(c) for c in config.column_names])
    elif config.columns is not None:
        df = df.select(*[quoted(df.columns[i]) for i in config.columns if i < len(df.columns)])
    return df if config.max_rows is None else df.limit(config.max_rows)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """Names and types from the footers alone."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.read.parquet(path).schema)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def arrow_bytes(df: DataFrame, stream: bool = False) -> bytes:
    """The table in the Arrow file format, or the stream format. It passes through the driver."""
    table = df.toArrow()
    out = io.BytesIO()
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def write_arrow(df: DataFrame, path: str, stream: bool = False) -> None:
    write_object(df.sparkSession, path, arrow_bytes(df, stream))


def arrow_parts(df: DataFrame, stream: bool = True) -> DataFrame:
    """Each partition's batches as one Arrow message of bytes, made on the executors; no row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer = io.BytesIO(), None
        for b in batches:
            if writer is None:
                writer = (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, b.schema)
            writer.write_batch(b)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"content": pa.array([out.getvalue()], pa.binary())})

    return df.mapInArrow(run, "content binary")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow file or stream, told apart by the magic at its start."""
    data = read_object(spark, path)
    reader = pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)
    return spark.createDataFrame(reader.read_all())
