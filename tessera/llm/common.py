"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"
_own_root: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and all runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_root[app] = tempfile.mkdtemp(prefix="tessera-shared-")
    return _own_root[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage with a copy that survives the loss of executors, and later readers take only
    the columns that they need. The application's folder can be dropped with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drop what :func:`materialise` wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tessera-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts are long and differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def hash_sample(rows: DataFrame, column: str, most: int, *ties: str) -> DataFrame:
    """The rows with the smallest hashes of a column, ``most`` at most.

    Rows that can't be among them by far are filtered out first, so that no task gathers the best of
    every partition of a large table.
    """
    n, place = rows.count(), F.xxhash64(column)
    if n > most:
        rows = rows.filter(place.cast("double") < F.lit((2.2 * most / n - 1) * 2.0**63))
    return rows.orderBy(place, column, *ties).limit(most)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII text takes the much faster ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower()))


def spaced(text: Column) -> Column:
    """Null as '', and each of \\x09-\\x0D as a space. Single replacements scan much faster than ``translate``."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(spaced(text), " "), "")


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text with A-Z lower-cased; null text has none."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def int_array(values) -> Column:
    """A literal array of integers that the optimiser folds into one constant."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")
