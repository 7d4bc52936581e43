"""A session with the settings that this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "vertexloom", shuffle_partitions: int | None = None) -> SparkSession:
    """An existing or a new session: UTC, adaptive execution with skewed joins split."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()
