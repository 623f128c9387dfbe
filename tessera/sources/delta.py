"""Tables in the open Delta layout: Parquet parts and a JSON log."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SourceError
from .storage import exists, listing, read_object, write_object

TYPES = {T.BooleanType: "boolean", T.LongType: "long", T.IntegerType: "integer", T.ShortType: "short", T.ByteType: "byte", T.DoubleType: "double", T.FloatType: "float", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz", T.BinaryType: "binary"}


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n, _, _ in listing(spark, f"{path}/_delta_log") if n.endswith(".json") and n[:-5].isdigit())


def _actions(spark: SparkSession, path: str, version: int) -> list[dict]:
    text = read_object(spark, f"{path}/_delta_log/{version:020d}.json").decode()
    return [json.loads(x) for x in text.splitlines() if x.strip()]


def write_delta(df: DataFrame, path: str) -> int:
    """Append the table's rows as the next version and return its number.

    Parts are written in parallel under names of their own; the log entry, written last, makes them
    visible, and a reader never sees half a version.
    """
    spark = df.sparkSession
    batch = uuid.uuid4().hex
    df.write.mode("append").parquet(f"{path}/_part={batch}")
    versions = _versions(spark, path)
    version, now = (versions[-1] + 1 if versions else 0), int(time.time() * 1000)
    actions: list[dict] = [{"commitInfo": {"timestamp": now, "operation": "WRITE", "operationParameters": {"mode": "Append", "partitionBy": "[]"}, "isBlindAppend": True}}]
    if version == 0:
        naive = any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema)
        protocol = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["timestampNtz"], "writerFeatures": ["timestampNtz"]} if naive else {"minReaderVersion": 1, "minWriterVersion": 2}
        fields = [{"name": f.name, "type": TYPES.get(type(f.dataType), f.dataType.simpleString() if isinstance(f.dataType, T.DecimalType) else "string"), "nullable": True, "metadata": {}} for f in df.schema]
        meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": [], "configuration": {}, "createdTime": now}
        actions += [{"protocol": protocol}, {"metaData": meta}]
    for name, size, modified in listing(spark, f"{path}/_part={batch}"):
        if name.endswith(".parquet"):
            actions.append({"add": {"path": f"_part%3D{batch}/{name}", "partitionValues": {}, "size": size, "modificationTime": modified, "dataChange": True}})
    write_object(spark, f"{path}/_delta_log/{version:020d}.json", "".join(json.dumps(a) + "\n" for a in actions).encode(), overwrite=False)
    return version


def sync_catalog(spark: SparkSession, path: str, name: str) -> None:
    """Make the table's present state known to SQL under a name of the session."""
    read_delta(spark, path).createOrReplaceTempView(name)


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one by default."""
    if not exists(spark, f"{path}/_delta_log"):
        raise SourceError(f"no table at {path}")
    files: dict[str, None] = {}
    for v in _versions(spark, path):
        if version is not None and v > version:
            break
        for a in _actions(spark, path, v):
            if "add" in a:
                files[a["add"]["path"].replace("%3D", "=")] = None
            elif "remove" in a:
                files.pop(a["remove"]["path"].replace("%3D", "="), None)
    if not files:
        raise SourceError(f"no files in {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in files])
