"""The test tables seen as the engine's records, by stated formulas, in Spark and in SQL.

events: ticks (symbol = event_type, price = value, size = props.k, seq = event_id). documents: articles (title =
first line; published_ms from doc_id; cluster = doc_id mod 12). embeddings: vectors with given clusters (label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Events are about 20 minutes apart per symbol, so bars are of an hour and limits scale with them.
STEP = 3_600_000
BASE = 1_704_067_200_000  # 2024-01-01, when events start
DAY = 24 * STEP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"), "user_id",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), "source",
        (F.lit(BASE) + (F.col("doc_id") * 7919 % 43200) * 1000).alias("published_ms"), (F.col("doc_id") % 12).alias("cluster"),
        F.array_distinct(F.array(F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")))).alias("tickers"),
        F.lit(BASE + 12 * STEP).alias("now_ms"),
    )


def priors(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.lit(0.3) + F.col("id") * 0.035).alias("prior"))


SQL_TICKS = """ticks AS (
  SELECT event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, user_id FROM events
)"""
SQL_BARS = SQL_TICKS + f""", bars AS (
  SELECT symbol, ts_ms // {STEP} * {STEP} AS start_ms, first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts_ms, seq) AS close, sum(size) AS volume, count(*) AS n_ticks, ts_ms // {STEP} * {STEP} + {STEP} AS end_ms
  FROM ticks GROUP BY symbol, ts_ms // {STEP}
)"""
SQL_RETURNS = SQL_BARS + f""", gaps AS (
  SELECT a.symbol, a.end_ms, a.close, b.close AS c0, b.end_ms AS e0
  FROM bars a ASOF JOIN bars b ON a.symbol = b.symbol AND a.end_ms > b.end_ms
), returns AS (
  SELECT symbol, end_ms, ln(close / c0) / sqrt((end_ms - e0) / {STEP}.0) AS ret FROM gaps WHERE end_ms - e0 <= {5 * STEP} AND close > 0 AND c0 > 0
)"""
SQL_PROBES = f"probes AS (SELECT DISTINCT symbol, {BASE} + d * {DAY} AS now_ms FROM ticks, range(2, 30) r(d))"
SQL_ARTICLES = f"""articles AS (
  SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS summary, source, {BASE} + (doc_id * 7919 % 43200) * 1000 AS published_ms, doc_id % 12 AS cluster,
         CASE WHEN doc_id % 7 = doc_id % 3 THEN ['T' || (doc_id % 7)] ELSE ['T' || (doc_id % 7), 'T' || (doc_id % 3)] END AS tickers, {BASE + 12 * STEP} AS now_ms
  FROM documents
)"""
SQL_PRIORS = "priors AS (SELECT 'src' || i AS source, 0.3 + i * 0.035 AS prior FROM range(0, 20) t(i))"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.operators import market

    return market.bars(ticks(spark, sf_dir), STEP)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.operators import market

    return market.returns(bars(spark, sf_dir), 5 * STEP, STEP)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol at each midnight from the third day to the thirtieth."""
    symbols = ticks(spark, sf_dir).select("symbol").distinct()
    return symbols.select("symbol", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(29).cast("bigint"))).alias("d")).select("symbol", (F.lit(BASE) + F.col("d") * DAY).alias("now_ms"))
