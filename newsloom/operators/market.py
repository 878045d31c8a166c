"""Bars, as-of prices, returns, volatility and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.constants import LOOKBACK_MIN, MAX_LAG, MINUTE_MS, PRICE_MAX_AGE_MS, RETURN_MAX_GAP_MS, VOL_MIN_RETURNS


def floor_to(c: Column, step: int) -> Column:
    return c - F.pmod(c, F.lit(step))


def bars(ticks: DataFrame, step_ms: int = MINUTE_MS) -> DataFrame:
    """OHLCV per symbol and tumbling step; equal times go by ``seq``. One partial aggregation, one shuffle."""
    order = F.struct("ts_ms", "seq")
    out = ticks.groupBy("symbol", floor_to(F.col("ts_ms"), step_ms).alias("start_ms")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_ticks"),
    )
    return out.withColumn("end_ms", F.col("start_ms") + step_ms)


def in_order_ticks(ticks: DataFrame, step_ms: int = MINUTE_MS) -> DataFrame:
    """Ticks that arrive (by ``arrival``) no later than their symbol's open step: a later step closes the ones before."""
    w = Window.partitionBy("symbol").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    step = floor_to(F.col("ts_ms"), step_ms)
    return ticks.withColumn("__open", F.max(step).over(w)).where(F.col("__open").isNull() | (step >= F.col("__open"))).drop("__open")


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``: the whole row as the value of a partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, "__row.*").select(*rows.columns)


def asof(
    probes: DataFrame, facts: DataFrame, by: str, probe_ts: str, fact_ts: str, value: str,
    strict: bool = False, max_age_ms: int | None = None, bucket_ms: int = 24 * 3_600_000, out: str = "asof",
) -> DataFrame:
    """Adds to each probe the last ``value`` of its key at or before (``strict``: before) its time.

    Probes and facts are ordered together within time buckets, so one hot key is many partitions; what
    a bucket starts with is the last fact of the buckets before, found over one row a bucket. No
    inequality join. Older than ``max_age_ms`` is null.
    """
    names = probes.columns
    side = F.lit(1 if not strict else -1)
    p = probes.select(F.struct(*names).alias("__p"), F.col(by).alias("__k"), F.col(probe_ts).alias("__t"), F.lit(None).cast(f"struct<t:bigint,v:double>").alias("__f"), side.alias("__o"))
    f = facts.select(
        F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), F.col(by).alias("__k"), F.col(fact_ts).alias("__t"),
        F.struct(F.col(fact_ts).cast("bigint").alias("t"), F.col(value).cast("double").alias("v")).alias("__f"), F.lit(0).alias("__o"),
    )
    both = p.unionByName(f).withColumn("__b", F.floor(F.col("__t") / bucket_ms))
    last_of = f.groupBy("__k", F.floor(F.col("__t") / bucket_ms).alias("__b")).agg(F.max("__f").alias("__last"))
    carry = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = last_of.select("__k", "__b").union(p.select("__k", F.floor(F.col("__t") / bucket_ms).alias("__b"))).distinct()
    start = buckets.join(last_of, ["__k", "__b"], "left").withColumn("__start", F.last("__last", True).over(carry)).select("__k", "__b", "__start")
    w = Window.partitionBy("__k", "__b").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__f", True).over(w)).where(F.col("__p").isNotNull())
    seen = seen.join(start, ["__k", "__b"], "left").withColumn("__seen", F.coalesce("__seen", "__start"))
    found = F.col("__seen.v")
    if max_age_ms is not None:
        found = F.when(F.col("__t") - F.col("__seen.t") <= max_age_ms, found)
    return seen.select("__p.*", found.alias(out))


def close_at(probes: DataFrame, bars_: DataFrame, probe_ts: str, strict: bool = False, max_age_ms: int | None = PRICE_MAX_AGE_MS, out: str = "close_at") -> DataFrame:
    return asof(probes, bars_, "symbol", probe_ts, "end_ms", "close", strict, max_age_ms, out=out)


def log_return(p0: Column, p1: Column) -> Column:
    """ln(p1 / p0); null if a price is missing or not positive."""
    return F.when((p0 > 0) & (p1 > 0), F.ln(p1 / p0))


def returns(bars_: DataFrame, max_gap_ms: int = RETURN_MAX_GAP_MS, unit_ms: int = MINUTE_MS) -> DataFrame:
    """symbol, end_ms, ret: return on the bar before per root of the gap in units; gaps over the limit give none.

    The bar before comes from the whole series; filter afterwards. Non-positive prices give none.
    """
    w = Window.partitionBy("symbol").orderBy("end_ms")
    out = bars_.select("symbol", "end_ms", "close", F.lag("close").over(w).alias("__c"), F.lag("end_ms").over(w).alias("__e"))
    gap = F.col("end_ms") - F.col("__e")
    out = out.where((gap > 0) & (gap <= max_gap_ms) & (F.col("__c") > 0) & (F.col("close") > 0))
    return out.select("symbol", "end_ms", (F.ln(F.col("close") / F.col("__c")) / F.sqrt(gap / unit_ms)).alias("ret"))


def range_join(probes: DataFrame, points: DataFrame, by: str, low: str, high: str, at: str, bucket_ms: int) -> DataFrame:
    """Pairs of probes and points of one key with low <= at <= high, by an equi-join on time buckets."""
    p = probes.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket_ms), F.floor(F.col(high) / bucket_ms))))
    q = points.withColumn("__b", F.floor(F.col(at) / bucket_ms)).withColumnRenamed(by, "__by")
    joined = p.join(q, (p[by] == q["__by"]) & (p["__b"] == q["__b"]) & (q[at] >= p[low]) & (q[at] <= p[high]))
    return joined.drop(p["__b"]).drop(q["__b"]).drop("__by")


def realized_vol(probes: DataFrame, returns_: DataFrame, low: str, high: str, bucket_ms: int, least: int = VOL_MIN_RETURNS, out: str = "sigma") -> DataFrame:
    """Adds the sample deviation of the returns in [low, high] of each (symbol, low, high); null below ``least`` returns."""
    keys = probes.select("symbol", F.col(low).alias("__lo"), F.col(high).alias("__hi")).distinct()
    pairs = range_join(keys, returns_, "symbol", "__lo", "__hi", "end_ms", bucket_ms)
    vol = pairs.groupBy("symbol", "__lo", "__hi").agg(F.when(F.count("ret") >= least, F.stddev_samp("ret")).alias(out))
    on = [probes["symbol"] == vol["symbol"], probes[low] == vol["__lo"], probes[high] == vol["__hi"]]
    return probes.join(vol, on, "left").drop(vol["symbol"]).drop("__lo", "__hi")


def sigmas(ret: Column, sigma: Column, units: Column) -> Column:
    """A return in units of sigma over the time."""
    return ret / (sigma * F.sqrt(units) + F.lit(1e-6))


def market_component(best_m: Column, best_rho: Column) -> Column:
    return F.when(best_m.isNotNull(), 0.7 * (1 - F.exp(-best_m / 2)) + 0.3 * F.greatest(F.lit(0.0), F.coalesce(best_rho, F.lit(0.0))))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where a side is constant or there are fewer than 3 points."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    flat = (n < 3) | (vx <= 1e-12 * n * sxx) | (vy <= 1e-12 * n * syy)
    return F.when(flat, F.lit(0.0)).otherwise((n * sxy - sx * sy) / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(vx * vy)))


def lead_lag(
    probes: DataFrame, returns_: DataFrame, coverage: DataFrame, now: str = "now_ms", key: str = "key", lookback: int = LOOKBACK_MIN,
    max_lag: int = MAX_LAG, step_ms: int = MINUTE_MS,
) -> DataFrame:
    """Best correlation of |return| with later coverage, over lags, per probe (key, symbol, now).

    Bins are steps before ``now`` floored; missing bins are 0. ``returns_``: (symbol, end_ms, ret);
    ``coverage``: (key, ts_ms). Only bins with something are joined: sums over the grid need no zeros.
    """
    grid = probes.select(key, "symbol", now).distinct().withColumn("__start", floor_to(F.col(now), step_ms) - lookback * step_ms)
    bucket = lookback * step_ms
    r = returns_.select("symbol", "end_ms", F.abs("ret").alias("a"))
    a = range_join(grid, r, "symbol", "__start", now, "end_ms", bucket)
    a = a.withColumn("bin", F.floor((F.col("end_ms") - step_ms - F.col("__start")) / step_ms)).where(f"bin >= 0 and bin < {lookback}").select(key, "symbol", now, "bin", "a")
    g2 = grid.withColumn("__end", F.col("__start") + lookback * step_ms - 1)
    c = range_join(g2, coverage.select(F.col(key).alias("__key"), "ts_ms"), key, "__start", "__end", "ts_ms", bucket) if key == "__key" else range_join(g2, coverage.select(key, "ts_ms"), key, "__start", "__end", "ts_ms", bucket)
    c = c.withColumn("bin", F.floor((F.col("ts_ms") - F.col("__start")) / step_ms)).groupBy(key, "symbol", now, "bin").agg(F.count(F.lit(1)).cast("double").alias("c"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    # at lag l: a[i] meets c[i + l], i < lookback - l
    left = a.select(key, "symbol", now, "bin", "a", lags).where(F.col("bin") < lookback - F.col("lag"))
    right = c.select(key, "symbol", now, (F.col("bin")).alias("cb"), "c", lags).where(F.col("cb") >= F.col("lag")).withColumn("bin", F.col("cb") - F.col("lag"))
    full = left.join(right.drop("cb"), [key, "symbol", now, "lag", "bin"], "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    sums = full.groupBy(key, "symbol", now, "lag").agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = (F.lit(lookback) - F.col("lag")).cast("double")
    rho = sums.withColumn("rho", pearson(n, *(F.col(v) for v in ("sx", "sy", "sxx", "syy", "sxy"))))
    best = rho.groupBy(key, "symbol", now).agg(F.greatest(F.lit(0.0), F.max("rho")).alias("rho"))
    return probes.select(key, "symbol", now).distinct().join(best, [key, "symbol", now], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))
