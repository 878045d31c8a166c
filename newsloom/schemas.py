"""Row types of streams, stages and tables, as Spark DDL. Times are UTC epoch milliseconds."""

RAW_NEWS = "id STRING, source STRING, title STRING, url STRING, summary STRING, published_ms BIGINT, observed_ms BIGINT, ts_inferred BOOLEAN"
CLEAN_NEWS = "id STRING, source STRING, title STRING, url STRING, summary STRING, published_ms BIGINT, observed_ms BIGINT, tickers ARRAY<STRING>, simhash BIGINT"
TICK = "symbol STRING, asset_class STRING, price DOUBLE, size DOUBLE, ts_ms BIGINT, venue STRING"
BAR = "symbol STRING, ts_ms BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, venue STRING"
ENVELOPE = "topic STRING, kind STRING, ts_ms BIGINT, seq BIGINT, arrival BIGINT"
VECTOR = "generation INT, embedder_id STRING, article_id STRING, vector ARRAY<FLOAT>"
CLUSTER = "tick_ms BIGINT, id STRING, generation INT, embedder_id STRING, members ARRAY<STRING>, centroid ARRAY<FLOAT>, born_ms BIGINT"
RANKING = "snapshot_ms BIGINT, cluster_id STRING, rank INT, score DOUBLE, components MAP<STRING,DOUBLE>, stale BOOLEAN"
BRIEF = "ts_ms BIGINT, kind STRING, cluster_id STRING, membership_hash STRING, method STRING, text STRING, text_hash STRING"
#: One line of a replay feed: news and bars in one shape.
REPLAY = (
    "type STRING, ts_ms BIGINT, source STRING, title STRING, url STRING, summary STRING, published_ms BIGINT, "
    "symbol STRING, start_ms BIGINT, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE, venue STRING"
)
#: Kinds of envelopes.
KINDS = ("news", "bar", "tick", "watermark", "eos", "snapshot", "cluster_update", "market_brief")
