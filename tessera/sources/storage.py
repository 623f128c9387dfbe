"""Objects in any store that the engine's file systems reach, by URI."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import SourceError


def _fs(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_object(spark: SparkSession, uri: str) -> bytes:
    row = spark.read.format("binaryFile").load(uri).select("content").first()
    if row is None:
        raise SourceError(f"nothing at {uri}")
    return bytes(row["content"])


def write_object(spark: SparkSession, uri: str, data: bytes, overwrite: bool = True) -> None:
    fs, path = _fs(spark, uri)
    out = fs.create(path, overwrite)
    try:
        # Portions keep each call to the JVM small.
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
    finally:
        out.close()


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _fs(spark, uri)
    return fs.exists(path)


def listing(spark: SparkSession, uri: str) -> list[tuple[str, int, int]]:
    """Name, bytes and modification time of the files in a folder, by name."""
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path) if s.isFile())


class MultipartUpload:
    """Parts are appended in the order of the calls and appear as one object on completion."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.uri, self.parts = spark, uri, []

    def upload_part(self, data: bytes) -> int:
        if not data:
            raise SourceError("a part can't be empty")
        self.parts.append(bytes(data))
        return len(self.parts)

    def complete(self) -> int:
        if not self.parts:
            raise SourceError("there are no parts")
        write_object(self.spark, self.uri, b"".join(self.parts))
        return sum(map(len, self.parts))
