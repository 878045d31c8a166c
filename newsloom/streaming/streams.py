"""Structured Streaming forms of the stages: the same columns, with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from newsloom.constants import LATENESS_MS


def with_event_time(rows: DataFrame, ms: str, lateness_ms: int = LATENESS_MS) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_millis(ms)).withWatermark("event_time", f"{lateness_ms} milliseconds")


def minute_bars(ticks: DataFrame, step: str = "1 minute", lateness_ms: int = LATENESS_MS) -> DataFrame:
    """OHLCV in append mode: a bar comes when the watermark passes its end."""
    order = F.struct("ts_ms", "seq")
    out = with_event_time(ticks, "ts_ms", lateness_ms).groupBy("symbol", F.window("event_time", step).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_ticks"),
    )
    return out.select("symbol", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "open", "high", "low", "close", "volume", "n_ticks")


def fresh_articles(articles: DataFrame, ms: str = "observed_ms", lateness_ms: int = LATENESS_MS) -> DataFrame:
    """The first article of each id within the watermark's memory."""
    return with_event_time(articles, ms, lateness_ms).dropDuplicatesWithinWatermark(["id"])


def fan_out(rows: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """One read of each micro-batch for several sinks."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for write in sinks.values():
                write(batch, number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
