"""Message queues: options, payloads and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConnectorMissing
from ..functions.values import quoted


@dataclass(frozen=True)
class Credentials:
    username: str
    password: str
    mechanism: str = "PLAIN"
    protocol: str = "SASL_SSL"

    def options(self) -> dict[str, str]:
        module = "scram.ScramLoginModule" if self.mechanism.startswith("SCRAM") else "plain.PlainLoginModule"
        secret = self.password.replace("\\", "\\\\").replace('"', '\\"')
        return {"kafka.security.protocol": self.protocol, "kafka.sasl.mechanism": self.mechanism, "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.{module} required username="{self.username}" password="{secret}";'}


def options(servers: str, topic: str, credentials: Credentials | None = None, max_offsets: int | None = None) -> dict[str, str]:
    """Reader options; ``max_offsets`` bounds a micro-batch."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic} | (credentials.options() if credentials else {})
    return out | ({"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {})


def available(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
    except Exception:
        return False
    return True


def _need(spark: SparkSession) -> None:
    if not available(spark):
        raise ConnectorMissing("the session has no Kafka connector; add the spark-sql-kafka package")


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON messages: key and value."""
    k = quoted(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def from_messages(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def read_stream(spark: SparkSession, schema: T.StructType | str, **how) -> DataFrame:
    _need(spark)
    return from_messages(spark.readStream.format("kafka").options(**options(**how)).load(), schema)


def publish(df: DataFrame, servers: str, topic: str, key: str | None = None, credentials: Credentials | None = None) -> None:
    _need(df.sparkSession)
    out = {"kafka.bootstrap.servers": servers, "topic": topic} | (credentials.options() if credentials else {})
    to_messages(df, key).write.format("kafka").options(**out).save()
