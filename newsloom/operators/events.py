"""Event time: watermarks, late rows, merge order, job grids and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.constants import JOBS, LATENESS_MS, WINDOW_MS


def with_watermark(rows: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Adds the topic's watermark before each row, in order of arrival: the largest explicit mark or time less lateness.

    ``kind`` watermark rows set the mark itself. The running maximum is taken within blocks of arrival and
    over block maxima, so a topic is not one partition.
    """
    mark = F.when(F.col("kind") == "watermark", F.col("ts_ms")).otherwise(F.col("ts_ms") - lateness_ms)
    marked = rows.withColumns({"__m": mark, "__b": F.floor(F.col("arrival") / 65536)})
    tops = marked.groupBy("topic", "__b").agg(F.max("__m").alias("__top"))
    before = Window.partitionBy("topic").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__start", F.max("__top").over(before)).drop("__top")
    inside = Window.partitionBy("topic", "__b").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumn("__in", F.max("__m").over(inside)).join(tops, ["topic", "__b"])
    return out.withColumn("watermark", F.greatest("__in", "__start")).drop("__m", "__b", "__in", "__start")


def late_flags(rows: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Adds ``late``: the row's time is before (not at) its topic's watermark when it arrives."""
    return with_watermark(rows, lateness_ms).withColumn("late", F.coalesce((F.col("kind") != "watermark") & (F.col("ts_ms") < F.col("watermark")), F.lit(False)))


def merge_order(rows: DataFrame, topics: list[str]) -> DataFrame:
    """Rows in release order: time, sequence, topic, arrival. A range partitioning, then local sorts."""
    place = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    return rows.withColumn("topic_order", place.cast("int")).orderBy("ts_ms", "seq", "topic_order", "arrival")


def job_grid(bounds: DataFrame, jobs: tuple[tuple[str, int, int], ...] = JOBS) -> DataFrame:
    """(first_ms, last_ms) to one row a due job: multiples of the period after the start, up to the end."""
    specs = F.array(*[F.struct(F.lit(n).alias("job"), F.lit(p).cast("bigint").alias("period"), F.lit(o).alias("priority")) for n, p, o in jobs])
    each = bounds.select("first_ms", "last_ms", F.explode(specs).alias("s")).select("first_ms", "last_ms", "s.*")
    start = (F.floor(F.col("first_ms") / F.col("period")) + 1) * F.col("period")
    each = each.where(start <= F.col("last_ms"))
    return each.select("job", "priority", F.explode(F.sequence(start, F.col("last_ms"), F.col("period"))).alias("due_ms"))


def window_members(articles: DataFrame, grid: DataFrame, window_ms: int = WINDOW_MS, step_ms: int = 60_000) -> DataFrame:
    """(due_ms, id): articles with due - window <= published <= due. An article finds its own grid points."""
    first = F.ceil(F.col("published_ms") / step_ms) * step_ms
    last = F.floor((F.col("published_ms") + window_ms) / step_ms) * step_ms
    own = articles.where(first <= last).select("id", "published_ms", F.explode(F.sequence(first, last, F.lit(step_ms).cast("bigint"))).alias("due_ms"))
    return own.join(grid.select("due_ms"), "due_ms", "left_semi")
