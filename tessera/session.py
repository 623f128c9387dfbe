"""Session defaults that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps naive timestamps naive; adaptive execution sizes shuffles and splits skewed joins at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the defaults; keyword names use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
