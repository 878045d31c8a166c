"""How well a ranking finds what moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.constants import HOUR_MS


def moved(ret: Column, sigma: Column, units: float = 60.0, over: float = 2.0) -> Column:
    """Did a return leave its range? Null without a return or sigma."""
    return F.when(ret.isNotNull() & sigma.isNotNull(), F.abs(ret) > over * sigma * F.sqrt(F.lit(units)))


def story_label(moves: DataFrame, key: list[str]) -> DataFrame:
    """Per story: any ticker moved; null if none is priced."""
    return moves.groupBy(*key).agg(F.bool_or("moved").alias("label"))


def quality(ranked: DataFrame, snapshot: str, rank: str, label: str, k_precision: int = 5, k_gain: int = 10) -> DataFrame:
    """Per snapshot with a positive: precision at k (over min(k, n)) and normalised discounted gain."""
    ideal_order = Window.partitionBy(snapshot).orderBy(F.desc(F.col(label).cast("int")), rank)
    rows = ranked.withColumn("__i", F.row_number().over(ideal_order))
    y = F.col(label).cast("int")
    gain = lambda place, k: F.sum(F.when((y == 1) & (place <= k), 1 / F.log2(place + 1)).otherwise(0.0))
    out = rows.groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.sum(F.when(F.col(rank) <= k_precision, y).otherwise(0)).alias("__top"),
        gain(F.col(rank), k_gain).alias("__dcg"), gain(F.col("__i"), k_gain).alias("__ideal"),
    ).where("positives > 0")
    return out.select(snapshot, "n", "positives", (F.col("__top") / F.least(F.lit(k_precision), F.col("n"))).alias("precision"), (F.col("__dcg") / F.col("__ideal")).alias("ndcg"))


def strided(times: list[int], stride_ms: int = 10 * 60_000) -> list[int]:
    """Times at least a stride after the one taken before: sequential, over snapshot times only."""
    out: list[int] = []
    for t in sorted(times):
        if not out or t - out[-1] >= stride_ms:
            out.append(t)
    return out


HORIZON_MS = HOUR_MS
