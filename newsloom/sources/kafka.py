"""Topics on Kafka: readers and writers that need the connector's jar on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOPICS = ("raw_news", "clean_news", "ticks", "bars", "ranked_stories", "briefs")


def read_topic(spark: SparkSession, servers: str, topic: str, schema: str, prefix: str = "", earliest: bool = True) -> DataFrame:
    """A topic's JSON values as a typed stream with the broker's order."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", prefix + topic).option("startingOffsets", "earliest" if earliest else "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m"), "partition", "offset").select("m.*", "partition", "offset")


def write_topic(rows: DataFrame, servers: str, topic: str, checkpoint: str, prefix: str = ""):
    values = rows.select(F.to_json(F.struct("*")).alias("value"))
    return values.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", prefix + topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).start()
