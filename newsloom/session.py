"""A Spark session with the settings that the engine relies on."""

from pyspark.sql import SparkSession


def session(name: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; on a cluster, partitions and the checkpoint folder come from its own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.multipleWatermarkPolicy": "min",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
