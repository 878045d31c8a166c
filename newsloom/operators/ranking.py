"""Scores of clusters of one snapshot from their articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.config import prior
from newsloom.constants import COVERAGE, RECENT_MS
from newsloom.functions.scoring import credibility, recency, velocity


def coverage_counts(members: DataFrame, key: str, now: str = "now_ms", recent_ms: int = RECENT_MS) -> DataFrame:
    """Per cluster: size, recent and earlier articles, first and last publication, sources and their priors."""
    recent = F.col("published_ms") > F.col(now) - recent_ms
    return members.groupBy(key, now).agg(
        F.count(F.lit(1)).alias("size"), F.count_if(recent).alias("n_recent"), F.count_if(~recent).alias("n_prior"),
        F.min("published_ms").alias("first_ms"), F.max("published_ms").alias("last_ms"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def source_priors(members: DataFrame, key: str, table=None) -> DataFrame:
    """(key, n_sources, mean_prior, top_prior) over distinct sources."""
    own = members.select(key, "source").distinct()
    p = own.withColumn("prior", prior(F.col("source"))) if table is None else own.join(F.broadcast(table), "source", "left").withColumn("prior", F.coalesce("prior", F.lit(0.5)))
    return p.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.avg("prior").alias("mean_prior"), F.max("prior").alias("top_prior"))


def basic_components(members: DataFrame, key: str, now: str = "now_ms", table=None, recent_ms: int = RECENT_MS, window_ms: int = 6 * 3_600_000, half_life_ms: int = 3_600_000) -> DataFrame:
    """Counts with velocity, credibility and recency."""
    counts = coverage_counts(members, key, now, recent_ms).join(source_priors(members, key, table), key)
    return counts.withColumns({
        "velocity": velocity(F.col("n_recent"), F.col("n_prior"), recent_ms, window_ms),
        "credibility": credibility(F.col("mean_prior"), F.col("n_sources")),
        "recency": recency(F.col(now), F.col("last_ms"), half_life_ms),
    })


def priced_tickers(members: DataFrame, key: str, symbols: DataFrame, share: float = COVERAGE) -> DataFrame:
    """(key, symbol, n): tickers on at least the share of a cluster's articles, counted once each, that have a bar."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    each = members.select(key, F.explode(F.array_distinct("tickers")).alias("symbol")).groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("size")))
    return each.join(sizes, key).where(F.col("n") >= need).select(key, "symbol", "n").join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def top_stories(scored: DataFrame, snapshot: str, score: str = "score", id_col: str = "cluster_id", top: int = 20) -> DataFrame:
    """Rank by the score to six places, ties by id; the top of each snapshot."""
    order = Window.partitionBy(snapshot).orderBy(F.desc(F.round(score, 6)), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
