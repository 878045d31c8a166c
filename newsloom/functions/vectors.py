"""Vectors as arrays, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """The vector over its length; zero stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def mean_vectors(rows: DataFrame, key: str, vector: str, out: str = "centroid", unit_length: bool = True) -> DataFrame:
    """Mean of each component per key. Sums per (key, position) combine before the shuffle, so a group may be large."""
    flat = rows.select(key, F.posexplode(vector).alias("pos", "x"))
    sums = flat.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("__v"))
    mean = F.transform("__v", lambda p: p["x"])
    return whole.select(key, (unit(mean) if unit_length else mean).alias(out))


def assert_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fails when a vector has another length."""
    return rows.withColumn(vector, F.when(F.assert_true(F.size(vector) == dim, F.lit(f"a vector's length is not {dim}")).isNull(), F.col(vector)))
