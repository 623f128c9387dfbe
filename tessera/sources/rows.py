"""Row numbers for sources whose order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise


def with_row_index(df: DataFrame, name: str = "_row", scan: bool = False) -> DataFrame:
    """Number rows from 0 in the order of partitions; the counts (one for each partition) are broadcast.

    The partitions are written once, so that counting and numbering see the same ones: a sort picks its
    bounds anew each time it runs. ``scan`` says that the table is a plain scan, whose splits are always
    the same, and saves the writing; a single file's splits are in file order.
    """
    at = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    at = at if scan else materialise(at)
    # One row for each partition, bounded by the plan and not by the data: a window over it runs in one task.
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__s"))
    return at.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")
