"""Operators whose state lives across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.values import column, display
from ..operators.aggregate import AggregateSpec
from ..operators.pivot import pivot_declared


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that appear in a folder; a bound on files per batch is the back-pressure."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def running_aggregate(stream: DataFrame, specs: Sequence[AggregateSpec], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over all rows so far; write it in complete mode.

    The engine has no distinct aggregates on streams, so ``count_distinct`` keeps the set of values as state
    and counts that: it is exact, and its state grows with the distinct values. ``approx_distinct`` has a
    state of bounded size, for those who ask for it.
    """
    return stream.groupBy(*by).agg(*[_expression(stream, s) for s in specs])


def _expression(stream: DataFrame, spec: AggregateSpec) -> Column:
    if spec.op != "count_distinct":
        return spec.expression(stream)
    name, c, kind = column(stream, spec.at)
    return F.size(F.collect_set(F.when(c.isNotNull(), display(c, kind)))).cast("long").alias(spec.alias or f"count_distinct_{name}")


def running_dedup(stream: DataFrame, keys: Sequence[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key to arrive. With a time column, keys are forgotten after ``late``, which
    bounds the state; without, they are kept for good."""
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def running_pivot(stream: DataFrame, row: str, col: str, value: str, values: Sequence[str], op: str = "sum") -> DataFrame:
    """A pivot over declared column keys; write it in complete mode."""
    return pivot_declared(stream, row, col, value, values, op)


def windowed(stream: DataFrame, time: str, width: str, specs: Sequence[AggregateSpec], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by event-time window; rows later than ``late`` are dropped with the window's state."""
    kept = stream.withWatermark(time, late)
    return kept.groupBy(F.window(time, width, slide or width).alias("window")).agg(*[_expression(kept, s) for s in specs]).select("window.start", "window.end", *[s.alias or f"{s.op}_{s.at}" for s in specs])


def to_table(result: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataStreamWriter:
    """An in-memory sink for tests and small results."""
    writer = result.writeStream.format("memory").queryName(name).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def to_files(result: DataFrame, path: str, checkpoint: str, format: str = "parquet", by: Sequence[str] = ()) -> DataStreamWriter:
    """Files that appear once each, whatever fails and is started again: append mode, with a checkpoint."""
    return result.writeStream.format(format).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by)


def to_each(result: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Hands every micro-batch and its number to ``write``, for any batch sink. A batch may come again after a
    failure, under the same number."""
    return result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
