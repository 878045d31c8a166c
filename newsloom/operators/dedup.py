"""Exact and near duplicates, and the article cleaning that uses them."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.constants import NEAR_BITS
from newsloom.functions import text as T
from newsloom.operators.market import latest_wins
from newsloom.operators.tickers import extract_tickers


def exact(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a partial aggregate, so copies never meet in number."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, "__row.*").select(*rows.columns)


def sha_simhash(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, simhash) from 64 bits of SHA-256 of words and pairs: plain Spark, for checks against SQL."""
    rows = docs.select(id_col, words.alias("__w"))
    pairs = F.zip_with(F.slice("__w", 1, F.greatest(F.size("__w") - 1, F.lit(0))), F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    grams = F.when(F.size("__w") > 1, F.concat("__w", pairs)).otherwise(F.col("__w"))
    digests = F.transform(grams, lambda g: F.sha2(g.cast("binary"), 256))
    n = F.size("__d")

    def bit(i: int) -> Column:
        digit, place = i // 4 + 1, 3 - i % 4
        on = "".join(c for c in "0123456789abcdef" if int(c, 16) >> place & 1)
        votes = F.aggregate("__d", F.lit(0), lambda s, d: s + F.when(F.contains(F.lit(on), F.substr(d, F.lit(digit), F.lit(1))), 1).otherwise(0))
        return F.when(votes * 2 > n, F.lit("1")).otherwise(F.lit("0"))

    bits = rows.select(id_col, digests.alias("__d")).select(id_col, F.concat(*[bit(i) for i in range(64)]).alias("bits"))
    return bits


def band_pairs(rows: DataFrame, id_col: str, bits: int = NEAR_BITS, hash_col: str = "simhash") -> DataFrame:
    """(a, b, distance) for distinct hashes at most ``bits`` (3 or fewer) apart: one of four 16-bit bands is equal.

    Rows with one hash are one: the pairs are between hashes, with the least id of each.
    """
    one = rows.where(F.col(hash_col) != 0).groupBy(hash_col).agg(F.min(id_col).alias("id"))
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col(hash_col), 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("v")) for i in range(4)]))
    keyed = one.select("id", hash_col, band.alias("band"))
    a, b = keyed.select(F.col("id").alias("a"), F.col(hash_col).alias("ha"), "band"), keyed.select(F.col("id").alias("b"), F.col(hash_col).alias("hb"), "band")
    d = T.hamming(F.col("ha"), F.col("hb"))
    return a.join(b, "band").where((F.col("ha") < F.col("hb")) & (d <= bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), d.cast("int").alias("distance")).distinct()


def _greedy(bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        kept: list[int] = []
        keep = []
        for h in group["simhash"].tolist():
            near = any(((h ^ k) & (1 << 64) - 1).bit_count() <= bits for k in kept)
            keep.append(not near)
            if not near:
                kept.append(h)
        return group.assign(kept=keep)[["id", "kept"]]

    return run


def near_greedy(rows: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """(id, kept) of rows (id, simhash, ord): in order, a row is dropped if a kept one is within ``bits``.

    Distance is not transitive, so this is sequential, but only inside components of near hashes: rows of
    equal hash keep their first, and each component of what is left is one group. Hash 0 is always kept.
    """
    spark = rows.sparkSession
    first = rows.where("simhash <> 0").groupBy("simhash").agg(F.min_by(F.struct("id", "ord"), "ord").alias("f")).select("f.id", "simhash", "f.ord")
    pairs = band_pairs(first.select("id", "simhash"), "id", bits)
    edges = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("v", "u")
    labels = edges.select("v").distinct().withColumn("label", F.col("v"))
    while True:
        seen = edges.join(labels.withColumnsRenamed({"v": "u", "label": "l"}), "u").groupBy("v").agg(F.min("l").alias("l"))
        new = labels.join(seen, "v").select("v", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved"))
        new = checkpointed(new)
        labels = new.select("v", "label")
        if not new.where("moved").limit(1).count():
            break
    grouped = first.join(labels.withColumnRenamed("v", "id"), "id")
    kind = rows.schema["id"].dataType.simpleString()
    resolved = grouped.groupBy("label").applyInPandas(_greedy(bits), f"id {kind}, kept boolean")
    alone = first.join(labels.withColumnRenamed("v", "id"), "id", "left_anti").select("id", F.lit(True).alias("kept"))
    marks = resolved.union(alone)
    out = rows.join(marks, "id", "left")
    del spark
    return out.select("id", F.coalesce("kept", F.col("simhash") == 0).alias("kept"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder; a local session without one gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="newsloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def clean(raw: DataFrame, noise: tuple[str, ...] = T.TITLE_NOISE) -> DataFrame:
    """Raw news to articles with a ``reason`` they are dropped for (empty, noise, exact, near) or null.

    Order matters: noise does not mark an id as seen, an article dropped as near does. Exact copies keep
    the first by (observed, seq).
    """
    rows = raw.withColumns({"title": T.strip_html("title"), "summary": T.strip_html("summary"), "url": T.canonical_url("url")})
    rows = rows.withColumn("summary", T.without_boilerplate(F.col("summary")))
    rows = rows.withColumn("summary", T.truncated(T.without_title(F.col("summary"), F.col("title"))))
    rows = rows.withColumns({
        "id": T.article_id(F.col("url")), "published_ms": F.least("published_ms", "observed_ms"), "simhash": T.simhash64("title"),
        "tickers": extract_tickers(F.concat_ws(" ", "title", "summary")),
    })
    rows = rows.withColumn("reason", F.when(F.col("title") == "", "empty").when(T.is_noise(F.col("title"), noise), "noise"))
    order = Window.partitionBy("id", F.col("reason").isNull()).orderBy("observed_ms", "seq")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(order) > 1), "exact").otherwise(F.col("reason")))
    fresh = rows.where("reason is null").select("id", "simhash", F.struct("observed_ms", "seq").alias("o"))
    fresh = fresh.withColumn("ord", F.col("o.observed_ms") * 1_000_000 + F.col("o.seq")).drop("o")
    near = near_greedy(checkpointed(fresh)).where("not kept").select(F.col("id").alias("__near"))
    rows = rows.join(near, rows["id"] == near["__near"], "left")
    reason = F.when(F.col("reason").isNull() & F.col("__near").isNotNull(), "near").otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).drop("__near")


__all__ = ["band_pairs", "clean", "exact", "latest_wins", "near_greedy", "sha_simhash"]
