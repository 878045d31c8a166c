"""Tables of results and the reads that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.operators.market import latest_wins


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table after the changes: for each key the last row by ``order``, changes over what was there."""
    both = current.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    return latest_wins(both, key, ["__side", *order]).drop("__side")


def insert_new(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows whose key it lacks."""
    return current.unionByName(rows.join(current.select(*key), key, "left_anti"))


def replace_partition(rows: DataFrame, path: str, column: str) -> None:
    """Write rows so that only the partitions that they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def article_tickers(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("article_id"), F.explode(F.array_distinct("tickers")).alias("symbol"))


def articles_by_ticker(articles: DataFrame, bridge: DataFrame, symbol: str, limit: int) -> DataFrame:
    """The most recent articles of a ticker; the limit is the feature (top-k by publication)."""
    own = bridge.where(F.col("symbol") == symbol).select(F.col("article_id").alias("id"))
    return articles.join(own, "id", "left_semi").orderBy(F.desc("published_ms"), "id").limit(limit)


def last_bars(bars: DataFrame, symbol: str, since_ms: int, limit: int) -> DataFrame:
    """The last ``limit`` bars of a symbol from a time on, in order of time."""
    last = bars.where((F.col("symbol") == symbol) & (F.col("start_ms") >= since_ms)).orderBy(F.desc("start_ms")).limit(limit)
    return last.orderBy("start_ms")


def latest(rows: DataFrame, at: str) -> DataFrame:
    """The row with the largest time."""
    return rows.orderBy(F.desc(at)).limit(1)


def retired(clusters: DataFrame, live: DataFrame, now_ms: int) -> DataFrame:
    """Clusters with ``retired_ms`` set once for those that are no longer live."""
    gone = clusters.join(live.select("id").withColumn("__live", F.lit(True)), "id", "left")
    stamp = F.when(F.col("__live").isNull(), F.coalesce("retired_ms", F.lit(now_ms).cast("bigint"))).otherwise(F.col("retired_ms"))
    return gone.withColumn("retired_ms", stamp).drop("__live")


def next_cluster_number(clusters: DataFrame) -> DataFrame:
    number = F.expr("try_cast(substring(id, 2) AS BIGINT)")
    return clusters.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def story_filter(stories: DataFrame, tickers: list[str] | None, limit: int) -> DataFrame:
    """Stories that name one of the tickers, by rank."""
    out = stories if not tickers else stories.where(F.arrays_overlap("tickers", F.array(*[F.lit(t) for t in tickers])))
    return out.orderBy("rank").limit(limit)


def cluster_detail(clusters: DataFrame, articles: DataFrame, briefs: DataFrame, cluster_id: str) -> DataFrame:
    """A cluster's articles, each with the cluster's latest brief."""
    own = clusters.where(F.col("id") == cluster_id)
    members = own.select(F.col("id").alias("cluster_id"), F.explode("members").alias("id")).join(articles, "id")
    last = briefs.where(F.col("cluster_id") == cluster_id).groupBy("cluster_id").agg(F.max_by("text", "ts_ms").alias("brief"))
    return members.join(F.broadcast(last), "cluster_id", "left")  # one row


def for_subscriber(messages: DataFrame, tickers: list[str] | None) -> DataFrame:
    """Messages a subscriber gets: snapshots with their stories filtered, updates only of its tickers, all others."""
    if not tickers:
        return messages
    wanted = F.array(*[F.lit(t) for t in tickers])
    mine = F.filter("stories", lambda s: F.arrays_overlap(s["tickers"], wanted))
    out = messages.withColumn("stories", F.when(F.col("kind").isin("snapshot", "cluster_update"), mine).otherwise(F.col("stories")))
    return out.where((F.col("kind") != "cluster_update") | (F.size("stories") > 0))


def best_rank(stories: DataFrame) -> DataFrame:
    """(symbol, rank, cluster_id): each symbol's best story."""
    each = stories.select("rank", "cluster_id", F.explode("tickers").alias("symbol"))
    return each.groupBy("symbol").agg(F.min("rank").alias("rank"), F.min_by("cluster_id", F.struct("rank", "cluster_id")).alias("cluster_id"))


def digest(rows: DataFrame) -> Column | DataFrame:
    """One SHA-256 of all rows, whatever their order: a hash of sorted row hashes, summed in parts first."""
    each = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"), 256).alias("h"))
    parts = each.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), "").cast("binary"), 256).alias("digest"))


def rank_within(rows: DataFrame, key: str, score: str, tie: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
