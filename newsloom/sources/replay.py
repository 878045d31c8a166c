"""Replay feeds: JSON lines (gzip is read as it is), as typed rows in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom import schemas
from newsloom.constants import MINUTE_MS
from newsloom.functions import text as T


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed lines in order; ``seq`` is a line's number in its file. Blank lines are skipped."""
    rows = spark.read.schema(schemas.REPLAY + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    return numbered(rows.where("type is not null").drop("_bad"))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.monotonically_increasing_id())


def news(feed: DataFrame) -> DataFrame:
    """Raw news: event time is when it was observed; the id comes from the URL, whatever the feed says."""
    url = T.canonical_url("url")
    return feed.where("type = 'news'").select(
        T.article_id(url).alias("id"), "source", "title", "url", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("published_ms", "ts_ms").alias("published_ms"), F.col("ts_ms").alias("observed_ms"), F.lit(False).alias("ts_inferred"), "seq",
    )


def bars(feed: DataFrame) -> DataFrame:
    """Bars: event time is their end."""
    return feed.where("type = 'bar'").select(
        "symbol", F.col("start_ms"), F.col("ts_ms").alias("end_ms"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.col("c").alias("close"), F.col("v").alias("volume"), F.coalesce("venue", F.lit("fixture")).alias("venue"), "seq",
    )


def envelopes(feed: DataFrame, until_ms: int | None = None) -> DataFrame:
    """The feed's events and a watermark on each topic for each minute that it passes, as (topic, kind, ts_ms, seq, arrival)."""
    kept = feed if until_ms is None else feed.where(F.col("ts_ms") <= until_ms)
    events = kept.select(F.when(F.col("type") == "news", "raw_news").otherwise("bars").alias("topic"), F.when(F.col("type") == "news", "news").otherwise("bar").alias("kind"), "ts_ms", "seq", (F.col("seq") * 2 + 1).alias("arrival"))
    minute = F.col("ts_ms") - F.pmod("ts_ms", F.lit(MINUTE_MS))
    marks = kept.groupBy(minute.alias("ts_ms")).agg(F.min("seq").alias("seq"))
    marks = marks.select(F.explode(F.array(F.lit("raw_news"), F.lit("bars"))).alias("topic"), F.lit("watermark").alias("kind"), "ts_ms", F.lit(0).cast("bigint").alias("seq"), (F.col("seq") * 2).alias("arrival"))
    return events.unionByName(marks)


def write_feed(rows: DataFrame, path: str) -> None:
    """A recorded feed: one line a URL or bar, in order of time, kind, symbol and URL, compressed."""
    key = F.coalesce(F.col("url"), F.concat_ws(":", "symbol", F.col("start_ms").cast("string")))
    one = rows.withColumn("__k", key).dropDuplicates(["type", "__k"]).drop("__k")
    one.orderBy("ts_ms", "type", F.coalesce("symbol", F.lit("")), F.coalesce("url", F.lit(""))).write.mode("overwrite").option("compression", "gzip").json(path)
