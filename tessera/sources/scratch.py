"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = tempfile.mkdtemp(prefix="tessera-shared-")
    return _own[app]


def new_path(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}{suffix}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the table as Parquet and read it back: all that read it see the same rows, also after a retry."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drop the intermediate tables of this application. Tables that still read them must not be used again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
