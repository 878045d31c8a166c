"""Components of the impact score as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.constants import BROAD_SHARE, BROAD_SOURCES, EMA_ALPHA, HALF_LIFE_MS, RECENT_MS, WEIGHTS, WINDOW_MS


def velocity(n_recent: Column, n_prior: Column, recent_ms: int = RECENT_MS, window_ms: int = WINDOW_MS) -> Column:
    expected = n_prior * (recent_ms / (window_ms - recent_ms))
    return 1 / (1 + F.exp(-(n_recent - expected) / F.sqrt(expected + 1)))


def credibility(mean_prior: Column, n_sources: Column) -> Column:
    return F.when(n_sources > 0, mean_prior * (1 - F.exp(-n_sources / 2))).otherwise(F.lit(0.0))


def recency(now_ms: Column, latest_ms: Column, half_life_ms: int = HALF_LIFE_MS) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * F.greatest(F.lit(0), now_ms - latest_ms) / half_life_ms)


def novelty(max_cosine: Column) -> Column:
    return F.when(max_cosine.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - max_cosine)))


def combined(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the components that are not null; 0 without any."""
    top = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    mass = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return F.when(mass > 0, top / mass).otherwise(F.lit(0.0))


def ema(scores: Column, alpha: float = EMA_ALPHA) -> Column:
    """Of an ordered array: the first as it is, then alpha times the new and the rest of the old."""
    return F.aggregate(scores, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))


def eligible(size: Column, top_prior: Column, market: Column) -> Column:
    return (size >= 2) | ((top_prior >= 0.9) & F.coalesce(market >= 0.8, F.lit(False)))


def is_broad(size: Column, n_sources: Column, window_size: Column) -> Column:
    return (window_size > 0) & (size > BROAD_SHARE * window_size) & (n_sources >= BROAD_SOURCES)


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
