"""Named queries of the engine's operators over the test tables; SQL checks are written another way round."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.constants import JOBS
from newsloom.functions import scoring as S
from newsloom.functions import text as T
from newsloom.functions import vectors as V
from newsloom.operators import briefs, clusters, dedup, evaluation, events, market, ranking, serving, tickers
from newsloom.plans import replay
from newsloom.plans.tables import BASE, DAY, SQL_ARTICLES, SQL_BARS, SQL_PRIORS, SQL_PROBES, SQL_RETURNS, SQL_TICKS, STEP, articles, bars, priors, probes, returns, table, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, c, places: int = 6):
    return F.round(c, places).alias(name)


# --- market ------------------------------------------------------------------------------------


@query(f"WITH {SQL_BARS} SELECT symbol, start_ms, open, high, low, close, round(volume, 6) AS volume, n_ticks, end_ms FROM bars")
def bars_ohlcv(spark, sf):
    return bars(spark, sf).withColumn("volume", F.round("volume", 6))


@query(f"""WITH {SQL_BARS}, {SQL_PROBES} SELECT p.symbol, p.now_ms, b.close AS close_at
FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.now_ms >= b.end_ms""")
def asof_close(spark, sf):
    return market.close_at(probes(spark, sf), bars(spark, sf), "now_ms", max_age_ms=None)


@query(f"""WITH {SQL_BARS}, {SQL_PROBES} SELECT p.symbol, p.now_ms, CASE WHEN p.now_ms - b.end_ms <= {STEP} THEN b.close END AS close_at
FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.now_ms > b.end_ms""")
def asof_close_strict_stale(spark, sf):
    return market.close_at(probes(spark, sf), bars(spark, sf), "now_ms", strict=True, max_age_ms=STEP)


def _spans(spark, sf):
    p = probes(spark, sf).withColumn("then_ms", F.col("now_ms") - 6 * STEP)
    b = bars(spark, sf)
    return market.close_at(market.close_at(p, b, "then_ms", max_age_ms=None, out="p0"), b, "now_ms", max_age_ms=None, out="p1")


_SPANS = f"""{SQL_BARS}, {SQL_PROBES}, spans AS (
  SELECT p.symbol, p.now_ms, p.now_ms - {6 * STEP} AS then_ms,
    (SELECT arg_max(b.close, b.end_ms) FROM bars b WHERE b.symbol = p.symbol AND b.end_ms <= p.now_ms - {6 * STEP}) AS p0,
    (SELECT arg_max(b.close, b.end_ms) FROM bars b WHERE b.symbol = p.symbol AND b.end_ms <= p.now_ms) AS p1
  FROM probes p)"""


@query(f"WITH {_SPANS} SELECT symbol, now_ms, round(ln(p1) - ln(p0), 6) AS ret FROM spans")
def log_returns(spark, sf):
    return _spans(spark, sf).select("symbol", "now_ms", _r("ret", market.log_return(F.col("p0"), F.col("p1"))))


@query(f"WITH {SQL_RETURNS} SELECT symbol, end_ms, round(ret, 6) AS ret FROM returns")
def minute_returns(spark, sf):
    return returns(spark, sf).withColumn("ret", F.round("ret", 6))


_VOL = f"""{SQL_RETURNS}, {SQL_PROBES}, vol AS (
  SELECT p.symbol, p.now_ms, CASE WHEN count(r.ret) >= 10 THEN stddev_samp(r.ret) END AS sigma
  FROM probes p LEFT JOIN returns r ON r.symbol = p.symbol AND r.end_ms >= p.now_ms - {48 * STEP} AND r.end_ms <= p.now_ms GROUP BY p.symbol, p.now_ms)"""


def _vol(spark, sf, rows=None):
    rows = (probes(spark, sf) if rows is None else rows).withColumn("low_ms", F.col("now_ms") - 48 * STEP)
    return market.realized_vol(rows, returns(spark, sf), "low_ms", "now_ms", 48 * STEP)


@query(f"WITH {_VOL} SELECT symbol, now_ms, round(sigma, 6) AS sigma FROM vol")
def realized_vol(spark, sf):
    return _vol(spark, sf).select("symbol", "now_ms", _r("sigma", F.col("sigma")))


def _moves(spark, sf):
    both = _vol(spark, sf, _spans(spark, sf))
    return both.select("symbol", "now_ms", market.sigmas(market.log_return(F.col("p0"), F.col("p1")), F.col("sigma"), F.lit(6.0)).alias("sigmas"))


_MOVES = f"""{_VOL}, spans AS (
  SELECT p.symbol, p.now_ms, a.close AS p0, b.close AS p1 FROM probes p
  ASOF LEFT JOIN (SELECT symbol, end_ms + {6 * STEP} AS e, close FROM bars) a ON a.symbol = p.symbol AND p.now_ms >= a.e
  ASOF LEFT JOIN bars b ON b.symbol = p.symbol AND p.now_ms >= b.end_ms),
moves AS (SELECT symbol, now_ms, ln(p1 / p0) / (sigma * sqrt(6.0) + 1e-6) AS sigmas FROM spans JOIN vol USING (symbol, now_ms))"""


@query(f"WITH {_MOVES} SELECT symbol, now_ms, round(sigmas, 5) AS sigmas, round(0.7 * (1 - exp(-abs(sigmas) / 2)), 5) AS market FROM moves")
def market_move_sigma(spark, sf):
    component = market.market_component(F.abs("sigmas"), F.lit(0.0))
    return _moves(spark, sf).select("symbol", "now_ms", _r("sigmas", F.col("sigmas"), 5), _r("market", component, 5))


@query(f"""WITH {_MOVES} SELECT symbol, count(sigmas) AS n, round(max(abs(sigmas)), 5) AS top, CAST(row_number() OVER (ORDER BY round(max(abs(sigmas)), 5) DESC NULLS LAST, symbol) AS INTEGER) AS rank
FROM moves GROUP BY symbol""")
def largest_moves(spark, sf):
    best = _moves(spark, sf).groupBy("symbol").agg(F.count("sigmas").alias("n"), _r("top", F.max(F.abs("sigmas")), 5))
    return serving.rank_within(best.withColumn("all", F.lit(1)), "all", "top", "symbol", 1_000_000).select("symbol", "n", "top", F.col("rank").cast("int").alias("rank"))


def _lag_inputs(spark, sf):
    p = probes(spark, sf).withColumn("key", F.col("symbol"))
    return p, returns(spark, sf), ticks(spark, sf).select(F.col("symbol").alias("key"), "ts_ms")


@query(f"""WITH {SQL_RETURNS}, {SQL_PROBES}, grid AS (SELECT p.*, i, now_ms - now_ms % {STEP} - 48 * {STEP} AS s FROM probes p, range(0, 48) g(i)),
a AS (SELECT g.symbol, g.now_ms, g.i, coalesce(max(abs(r.ret)), 0) AS a FROM grid g LEFT JOIN returns r ON r.symbol = g.symbol AND r.end_ms - {STEP} = g.s + g.i * {STEP} GROUP BY ALL),
c AS (SELECT g.symbol, g.now_ms, g.i, count(t.ts_ms) AS c FROM grid g LEFT JOIN ticks t ON t.symbol = g.symbol AND t.ts_ms >= g.s + g.i * {STEP} AND t.ts_ms < g.s + (g.i + 1) * {STEP} GROUP BY ALL),
r AS (SELECT a.symbol, a.now_ms, l, CASE WHEN stddev_pop(a.a) = 0 OR stddev_pop(c.c) = 0 THEN 0 ELSE corr(a.a, c.c) END AS rho
  FROM a, range(0, 6) t(l), c WHERE c.symbol = a.symbol AND c.now_ms = a.now_ms AND c.i = a.i + l GROUP BY a.symbol, a.now_ms, l)
SELECT symbol, now_ms, round(greatest(0, max(rho)), 5) AS rho FROM r GROUP BY symbol, now_ms""")
def lead_lag_corr(spark, sf):
    out = market.lead_lag(*_lag_inputs(spark, sf), lookback=48, max_lag=5, step_ms=STEP)
    return out.select("symbol", "now_ms", _r("rho", F.col("rho"), 5))


@query(f"""WITH {_SPANS} SELECT symbol, now_ms, round((p1 / p0 - 1) * 100, 4) AS pct FROM spans WHERE p0 IS NOT NULL AND p1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY now_ms ORDER BY symbol) <= 4""")
def market_facts_topk(spark, sf):
    rows = _spans(spark, sf).withColumn("ret", market.log_return(F.col("p0"), F.col("p1"))).where("ret is not null")
    rows = rows.withColumn("one", F.lit(0))
    return serving.rank_within(rows, "now_ms", "one", "symbol", 4).select("symbol", "now_ms", _r("pct", F.expm1("ret") * 100, 4))


@query(f"""WITH {SQL_TICKS} SELECT symbol, ts_ms // {STEP} AS slot, price, seq FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms // {STEP} ORDER BY seq DESC) = 1""")
def price_latest_wins(spark, sf):
    rows = ticks(spark, sf).select("symbol", F.floor(F.col("ts_ms") / STEP).alias("slot"), "price", "seq")
    return market.latest_wins(rows, ["symbol", "slot"], ["seq"])


# --- event time --------------------------------------------------------------------------------

_ARRIVALS = SQL_TICKS + ", arrivals AS (SELECT symbol AS topic, 'tick' AS kind, ts_ms, seq, seq + (seq * 7919 % 97) AS arrival0 FROM ticks), arrived AS (SELECT topic, kind, ts_ms, seq, arrival0 * 1000000 + seq AS arrival FROM arrivals)"


def _arrivals(spark, sf):
    late = F.col("seq") + F.col("seq") * 7919 % 97  # up to 96 places late
    return ticks(spark, sf).select(F.col("symbol").alias("topic"), F.lit("tick").alias("kind"), "ts_ms", "seq", (late * 1_000_000 + F.col("seq")).alias("arrival"))


@query(f"""WITH {_ARRIVALS}, w AS (SELECT *, max(ts_ms - {STEP}) OVER (PARTITION BY topic ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM arrived)
SELECT topic, seq, coalesce(ts_ms < wm, false) AS late FROM w""")
def late_flags(spark, sf):
    return events.late_flags(_arrivals(spark, sf), STEP).select("topic", "seq", "late")


@query(f"""WITH {_ARRIVALS} SELECT topic, count(*) AS n, count(*) FILTER (WHERE ts_ms < wm) AS late FROM (
  SELECT *, max(ts_ms - {STEP}) OVER (PARTITION BY topic ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM arrived) GROUP BY topic""")
def late_counts(spark, sf):
    return events.late_flags(_arrivals(spark, sf), STEP).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


_TOPICS = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH {_ARRIVALS} SELECT seq, topic, ts_ms, lead(seq) OVER (ORDER BY ts_ms, seq, list_position({_TOPICS}, topic), arrival) AS next_seq FROM arrived""")
def event_merge_order(spark, sf):
    from pyspark.sql import Window

    rows = events.merge_order(_arrivals(spark, sf), _TOPICS)
    # release order within days, and the first of the next day after each day's last: no single partition
    day = F.floor(F.col("ts_ms") / DAY)
    rows = rows.withColumn("day", day)
    order = ["ts_ms", "seq", "topic_order", "arrival"]
    heads = rows.groupBy("day").agg(F.min_by("seq", F.struct(*order)).alias("head"))
    heads = heads.withColumn("following", F.lead("head").over(Window.orderBy("day"))).drop("head")  # one row a day
    inside = F.lead("seq").over(Window.partitionBy("day").orderBy(*order))
    return rows.withColumn("n", inside).join(F.broadcast(heads), "day").select("seq", "topic", "ts_ms", F.coalesce("n", "following").alias("next_seq"))


@query(f"""WITH {SQL_TICKS}, b AS (SELECT min(ts_ms) AS a, max(ts_ms) AS z FROM ticks), j AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {p}, {o})" for n, p, o in JOBS)}) t(job, p, priority))
SELECT job, CAST(priority AS INTEGER) AS priority, CAST(z // p - a // p AS BIGINT) AS n, (a // p + 1) * p AS first_ms, z // p * p AS last_ms FROM b, j""")
def job_grid_counts(spark, sf):
    bounds = ticks(spark, sf).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    grid = events.job_grid(bounds)
    return grid.groupBy("job", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("due_ms").alias("first_ms"), F.max("due_ms").alias("last_ms"))


@query(f"""WITH {SQL_ARTICLES}, g AS (SELECT {BASE} + i * 600000 AS due_ms FROM range(0, 109) t(i))
SELECT due_ms, count(*) AS n, sum(id) AS ids FROM g JOIN articles ON published_ms BETWEEN due_ms - {6 * STEP} AND due_ms GROUP BY due_ms""")
def window_membership(spark, sf):
    grid = spark.range(109).select((F.lit(BASE) + F.col("id") * 600_000).alias("due_ms"))
    return events.window_members(articles(spark, sf), grid, 6 * STEP, 600_000).groupBy("due_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


# --- cleaning ----------------------------------------------------------------------------------

_URL = r"""urls AS (
  SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages
), parts AS (
  SELECT page_id, regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '') AS host, regexp_replace(path, '/+', '/', 'g') AS path,
         list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|mc_|ga_)')
           AND lower(split_part(p, '=', 1)) NOT IN (KEYS))) AS kept FROM urls
), canon AS (
  SELECT page_id, 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM parts
)""".replace("KEYS", ", ".join(f"'{k}'" for k in T.TRACKING_KEYS))


@query(f"WITH {_URL} SELECT page_id, url FROM canon")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_url("url").alias("url"))


@query(f"WITH {_URL} SELECT page_id, url FROM canon")
def canonical_url_native(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_url_column(F.col("url")).alias("url"))


@query(f"WITH {_URL} SELECT page_id, sha256(url) AS id FROM canon")
def article_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.article_id(T.canonical_url_column(F.col("url"))).alias("id"))


@query()
def strip_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html("html").alias("text"))


@query(f"""WITH {SQL_ARTICLES} SELECT id, regexp_matches(title, '\\bthe\\b') OR regexp_matches(title, '^(Die|La) ') AS noise,
  lower(regexp_replace(title, '\\s+[-|–—]\\s+[A-Z][\\w .&]{{1,30}}$', '')) AS normal FROM articles""")
def title_noise_filter(spark, sf):
    a = articles(spark, sf)
    return a.select("id", T.is_noise(F.col("title"), (r"\bthe\b", "^(Die|La) ")).alias("noise"), T.normal_title(F.col("title")).alias("normal"))


@query(f"""WITH {SQL_ARTICLES}, t AS (SELECT id, summary AS s, left(summary, 300) AS h FROM articles)
SELECT id, CASE WHEN length(s) <= 300 THEN s ELSE regexp_replace(CASE WHEN contains(h, ' ') THEN left(h, 300 - strpos(reverse(h), ' ')) ELSE h END, '[,;:\\-]+$', '') || '…' END AS summary FROM t""")
def truncate_summary(spark, sf):
    return articles(spark, sf).select("id", T.truncated(F.col("summary")).alias("summary"))


@query(f"""WITH {SQL_ARTICLES} SELECT id, CASE WHEN starts_with(lower(summary), lower(title)) THEN regexp_replace(substr(summary, length(title) + 1), '^[ .:\\-]+', '') ELSE summary END AS summary,
  title || '. ' || left(summary, 300) AS embed FROM articles""")
def summary_without_title(spark, sf):
    a = articles(spark, sf)
    return a.select("id", T.without_title(F.col("summary"), F.col("title")).alias("summary"), T.embed_text(F.col("title"), F.col("summary")).alias("embed"))


@query(f"WITH {SQL_ARTICLES} SELECT sha256(summary) AS key, min(id) AS id, any_value(source ORDER BY id) AS source FROM articles GROUP BY summary")
def exact_dedup(spark, sf):
    rows = articles(spark, sf).select(F.sha2(F.col("summary").cast("binary"), 256).alias("key"), "id", "source")
    return dedup.exact(rows, ["key"], ["id"])


def _title_words(a):
    return F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)"), 1)


_BITS = f"""{SQL_ARTICLES}, w AS (SELECT id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM articles),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w WHERE len(w) > 0),
h AS (SELECT id, ('0x' || substr(sha256(g), 1, 8))::UINTEGER AS a, ('0x' || substr(sha256(g), 9, 8))::UINTEGER AS b FROM g),
v AS (SELECT id, i, 2 * sum(CASE WHEN i < 32 THEN (a >> (31 - i)) & 1 ELSE (b >> (63 - i)) & 1 END) > count(*) AS y FROM h, range(0, 64) t(i) GROUP BY id, i)"""


@query(f"WITH {_BITS} SELECT id, string_agg(CASE WHEN y THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM v GROUP BY id")
def simhash_sha(spark, sf):
    a = articles(spark, sf)
    out = dedup.sha_simhash(a.withColumn("w", _title_words(a)), "id", F.col("w"))
    return out.join(a.where(F.size(_title_words(a)) > 0).select("id"), "id", "left_semi")


_HASHES = """v AS (SELECT vec_id AS id, list_sum(list_transform(range(0, 60), lambda i: CASE WHEN embedding[i % 12 + 1] > 0 AND (vec_id % 7 = 0 OR i < 12) THEN (1::BIGINT << i) ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings)"""


def _hashes(spark, sf):
    """Bits of signs, repeated for every seventh vector: many hashes near each other."""
    e = table(spark, sf, "embeddings")
    bits = [F.when((F.col("embedding")[i % 12] > 0) & ((F.col("vec_id") % 7 == 0) | F.lit(i < 12)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(60)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return e.select(F.col("vec_id").alias("id"), total.alias("simhash"))


@query(f"""WITH {_HASHES}, u AS (SELECT h, min(id) AS id FROM v WHERE h <> 0 GROUP BY h)
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM u a JOIN u b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 3""")
def near_dup_bands(spark, sf):
    return dedup.band_pairs(_hashes(spark, sf), "id")


@query()
def near_dup_greedy(spark, sf):
    return dedup.near_greedy(_hashes(spark, sf).withColumn("ord", F.col("id")))


@query()
def simhash_titles(spark, sf):
    return articles(spark, sf).select("id", T.simhash64("title").alias("simhash"))


@query()
def ticker_mentions(spark, sf):
    a = articles(spark, sf)
    return a.select("id", tickers.extract_tickers("summary").alias("tickers"))


# --- vectors and clusters ----------------------------------------------------------------------

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_CENTROIDS = f"""{_UNIT}, f AS (SELECT label, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m, sqrt(sum(m * m)) AS n FROM f GROUP BY label), cc AS (SELECT label, list_transform(m, lambda x: x / n) AS centroid FROM c)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", V.unit("embedding").alias("v"))


def _centroids(spark, sf):
    return V.mean_vectors(_vectors(spark, sf), "label", "v")


@query(f"WITH {_UNIT} SELECT vec_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, round(list_inner_product(v, v), 6) AS norm FROM u")
def vector_normalize(spark, sf):
    v = _vectors(spark, sf)
    return v.select("vec_id", _r("total", F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), _r("first", F.col("v")[0]), _r("norm", V.dot("v", "v")))


@query(f"WITH {_CENTROIDS} SELECT label, round(unnest(centroid), 6) AS x, unnest(range(0, 64)) AS pos FROM cc")
def centroids(spark, sf):
    return _centroids(spark, sf).select("label", F.posexplode("centroid").alias("p", "x")).select("label", _r("x", F.col("x")), F.col("p").cast("bigint").alias("pos"))


@query(f"WITH {_CENTROIDS} SELECT label, round(avg(list_inner_product(v, centroid)), 6) AS cohesion, count(*) AS n FROM u JOIN cc USING (label) GROUP BY label")
def cohesion(spark, sf):
    v = _vectors(spark, sf)
    return clusters.cohesion(v, _centroids(spark, sf), "label", "v").join(v.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").withColumn("cohesion", F.round("cohesion", 6))


@query(f"""WITH {_CENTROIDS} SELECT label, vec_id, round(list_inner_product(v, centroid), 6) AS cos FROM u JOIN cc USING (label)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_inner_product(v, centroid), 9) DESC, vec_id) = 1""")
def headline_pick(spark, sf):
    return clusters.headlines(_vectors(spark, sf), _centroids(spark, sf), "label", "vec_id", "v").withColumn("cos", F.round("cos", 6))


@query(f"WITH {_CENTROIDS} SELECT a.label, round(least(1, greatest(0, 1 - max(list_inner_product(a.centroid, b.centroid)))), 6) AS novelty FROM cc a JOIN cc b ON a.label <> b.label GROUP BY a.label")
def novelty_maxcos(spark, sf):
    c = _centroids(spark, sf)
    return clusters.max_cosines(c, c, "label").select("label", _r("novelty", S.novelty(F.col("max_cosine"))))


_GROUPS = "a AS (SELECT label AS g, list(vec_id) AS m FROM embeddings GROUP BY label), b AS (SELECT (vec_id // 3) % 8 AS g, list(vec_id) AS m FROM embeddings GROUP BY (vec_id // 3) % 8)"


def _groups(spark, sf):
    e = table(spark, sf, "embeddings")
    old = e.groupBy("label").agg(F.collect_list("vec_id").alias("old"))
    new = e.groupBy((F.floor(F.col("vec_id") / 3) % 8).alias("draft")).agg(F.collect_list("vec_id").alias("new"))
    return old.join(F.broadcast(new), F.lit(True))  # a few clusters of one window


@query(f"""WITH {_GROUPS}, ea AS (SELECT g AS label, unnest(m) AS v FROM a), eb AS (SELECT g AS draft, unnest(m) AS v FROM b), i AS (SELECT label, draft, count(*) AS n FROM ea JOIN eb USING (v) GROUP BY ALL)
SELECT a.g AS label, b.g AS draft, round(coalesce(n, 0) / (len(a.m) + len(b.m) - coalesce(n, 0)), 6) AS jaccard FROM a CROSS JOIN b LEFT JOIN i ON i.label = a.g AND i.draft = b.g""")
def jaccard_match_scores(spark, sf):
    return _groups(spark, sf).select("label", "draft", _r("jaccard", S.jaccard("old", "new")))


@query()
def id_assignment(spark, sf):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = part.pivot(index="label", columns="draft", values="jaccard").fillna(0.0).sort_index()
        pairs = clusters.assign(grid.to_numpy())
        return pd.DataFrame([(int(grid.index[r]), int(grid.columns[c]), float(grid.to_numpy()[r, c])) for r, c in pairs], columns=["label", "draft", "jaccard"])

    return jaccard_match_scores(spark, sf).withColumn("run", F.lit(1)).groupBy("run").applyInPandas(run, "label int, draft bigint, jaccard double")


_TERMS = f"""{SQL_ARTICLES}, w AS (SELECT cluster, list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9]+'), lambda x: length(x) > 3) AS w FROM articles),
t AS (SELECT cluster, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
n AS (SELECT cluster, term, count(*) AS n FROM t GROUP BY ALL), z AS (SELECT cluster, sum(n) AS size FROM n GROUP BY cluster), tot AS (SELECT term, sum(n) AS total FROM n GROUP BY term),
s AS (SELECT n.cluster, n.term, n.n, n.n / z.size * ln(1 + (SELECT avg(size) FROM z) / total) AS score FROM n JOIN z USING (cluster) JOIN tot USING (term))"""


@query(f"""WITH {_TERMS} SELECT cluster, term, n, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) <= 3""")
def ctfidf_terms(spark, sf):
    a = articles(spark, sf)
    words = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("([a-z][a-z0-9]+)"), 1), lambda w: F.length(w) > 3)
    top = clusters.top_terms(clusters.term_scores(a.select("cluster", words.alias("w")), "cluster", "w"), "cluster")
    return top.select("cluster", "term", "n", _r("score", F.col("score")), F.col("rank").cast("int").alias("rank"))


@query()
def kmeans_select(spark, sf):
    return clusters.selected_k(_vectors(spark, sf), "label", "vec_id", "v")


# --- scores ------------------------------------------------------------------------------------

_BASIC = f"""{SQL_ARTICLES}, {SQL_PRIORS}, n AS (
  SELECT cluster, now_ms, count(*) AS size, count(*) FILTER (WHERE published_ms > now_ms - 1800000) AS n_recent, count(*) FILTER (WHERE published_ms <= now_ms - 1800000) AS n_prior,
         min(published_ms) AS first_ms, max(published_ms) AS last_ms FROM articles GROUP BY ALL),
p AS (SELECT cluster, count(*) AS n_sources, avg(prior) AS mean_prior, max(prior) AS top_prior FROM (SELECT DISTINCT cluster, source FROM articles) JOIN priors USING (source) GROUP BY cluster),
b AS (SELECT *, 1 / (1 + exp(-(n_recent - n_prior * 30 / 330.0) / sqrt(n_prior * 30 / 330.0 + 1))) AS velocity, mean_prior * (1 - exp(-n_sources / 2.0)) AS credibility,
      pow(0.5, (now_ms - last_ms) / 3600000.0) AS recency FROM n JOIN p USING (cluster))"""


def _basic(spark, sf):
    return ranking.basic_components(articles(spark, sf), "cluster", table=priors(spark))


@query(f"WITH {_BASIC} SELECT cluster, n_recent, n_prior, round(velocity, 6) AS velocity FROM b")
def velocity(spark, sf):
    return _basic(spark, sf).select("cluster", "n_recent", "n_prior", _r("velocity", F.col("velocity")))


@query(f"WITH {_BASIC} SELECT cluster, n_sources, round(credibility, 6) AS credibility FROM b")
def credibility(spark, sf):
    return _basic(spark, sf).select("cluster", "n_sources", _r("credibility", F.col("credibility")))


@query(f"WITH {_BASIC} SELECT cluster, last_ms, round(recency, 6) AS recency FROM b")
def recency(spark, sf):
    return _basic(spark, sf).select("cluster", "last_ms", _r("recency", F.col("recency")))


@query(f"""WITH {SQL_ARTICLES}, t AS (SELECT cluster, unnest(tickers) AS symbol FROM articles), z AS (SELECT cluster, count(*) AS size FROM articles GROUP BY cluster)
SELECT cluster, symbol, count(*) AS n FROM t JOIN z USING (cluster) WHERE symbol IN ('T0', 'T1', 'T2', 'T3') GROUP BY cluster, symbol, size HAVING count(*) >= greatest(1, ceil(0.3 * size))""")
def priced_coverage(spark, sf):
    symbols = spark.range(4).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("symbol"))
    return ranking.priced_tickers(articles(spark, sf), "cluster", symbols).select("cluster", "symbol", "n")


_COMBINED = f"""{_BASIC}, m AS (SELECT *, CASE WHEN cluster % 3 = 0 THEN NULL ELSE cluster / 12.0 END AS market, cluster / 24.0 AS novelty FROM b),
k AS (SELECT *, (0.3 * velocity + 0.2 * credibility + 0.2 * recency + coalesce(0.2 * market, 0) + 0.1 * novelty) / (CASE WHEN market IS NULL THEN 0.8 ELSE 1.0 END) AS score FROM m)"""


def _combined(spark, sf):
    rows = _basic(spark, sf).withColumns({"market": F.when(F.col("cluster") % 3 != 0, F.col("cluster") / 12.0), "novelty": F.col("cluster") / 24.0})
    return rows.withColumn("score", S.combined({k: F.col(k) for k in ("velocity", "credibility", "recency", "market", "novelty")}))


@query(f"WITH {_COMBINED} SELECT cluster, round(market, 6) AS market, round(score, 6) AS score FROM k")
def impact_combine(spark, sf):
    return _combined(spark, sf).select("cluster", _r("market", F.col("market")), _r("score", F.col("score")))


@query(f"""WITH RECURSIVE {SQL_BARS}, o AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY end_ms) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
e AS (SELECT symbol, i, n, close AS ema FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.i, o.n, 0.5 * o.close + 0.5 * e.ema FROM e JOIN o ON o.symbol = e.symbol AND o.i = e.i + 1)
SELECT symbol, n, round(ema, 6) AS ema FROM e WHERE i = n""")
def ema_scores(spark, sf):
    lists = bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("end_ms", "close"))), lambda x: x["close"]).alias("c"))
    return lists.select("symbol", "n", _r("ema", S.ema(F.col("c"))))


@query(f"""WITH {_COMBINED} SELECT cluster, size >= 2 OR (top_prior >= 0.9 AND coalesce(market >= 0.8, false)) AS eligible,
  size / (SELECT count(*) FROM articles) > 0.5 AND n_sources >= 6 AS broad FROM k""")
def eligible_broad(spark, sf):
    rows = _combined(spark, sf)
    whole = rows.agg(F.sum("size").alias("window"))
    rows = rows.join(F.broadcast(whole), F.lit(True))  # one row
    return rows.select("cluster", S.eligible(F.col("size"), F.col("top_prior"), F.col("market")).alias("eligible"), S.is_broad(F.col("size"), F.col("n_sources"), F.col("window")).alias("broad"))


@query(f"WITH {_COMBINED} SELECT cluster, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, cluster) AS INTEGER) AS rank FROM k QUALIFY rank <= 20")
def ranked_stories(spark, sf):
    top = ranking.top_stories(_combined(spark, sf), "now_ms", id_col="cluster")
    return top.select("cluster", _r("score", F.col("score")), F.col("rank").cast("int").alias("rank"))


# --- serving -----------------------------------------------------------------------------------


@query(f"WITH {SQL_ARTICLES} SELECT id, source, published_ms FROM articles WHERE list_contains(tickers, 'T2') ORDER BY published_ms DESC, id LIMIT 50")
def articles_by_ticker(spark, sf):
    a = articles(spark, sf)
    return serving.articles_by_ticker(a, serving.article_tickers(a), "T2", 50).select("id", "source", "published_ms")


@query(f"WITH {SQL_BARS} SELECT symbol, start_ms, close FROM bars WHERE symbol = 'click' AND start_ms >= {BASE + 5 * DAY} ORDER BY start_ms DESC LIMIT 60")
def bars_since(spark, sf):
    return serving.last_bars(bars(spark, sf), "click", BASE + 5 * DAY, 60).select("symbol", "start_ms", "close")


@query(f"WITH {SQL_BARS} SELECT start_ms, count(*) AS symbols, round(sum(volume), 6) AS volume FROM bars GROUP BY start_ms ORDER BY start_ms DESC LIMIT 1")
def latest_snapshot(spark, sf):
    return serving.latest(bars(spark, sf).groupBy("start_ms").agg(F.count(F.lit(1)).alias("symbols"), _r("volume", F.sum("volume"))), "start_ms")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def upsert_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return serving.upsert(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT vec_id AS id, CASE WHEN label IN (1, 4, 7) THEN CASE WHEN vec_id % 5 = 0 THEN 7 ELSE 99 END ELSE CASE WHEN vec_id % 5 = 0 THEN 7 END END::BIGINT AS retired_ms FROM embeddings")
def retire_clusters(spark, sf):
    e = table(spark, sf, "embeddings")
    current = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.lit(7)).cast("bigint").alias("retired_ms"))
    live = e.where(~F.col("label").isin(1, 4, 7)).select(F.col("vec_id").alias("id"))
    return serving.retired(current, live, 99)


@query(f"WITH {SQL_ARTICLES}, s AS (SELECT id, tickers, row_number() OVER (ORDER BY published_ms DESC, id) AS rank FROM articles) SELECT id, rank FROM s WHERE list_has_any(tickers, ['T1', 'T5']) ORDER BY rank LIMIT 40")
def stories_filter(spark, sf):
    a = articles(spark, sf).withColumn("all", F.lit(1)).withColumn("newest", F.col("published_ms"))
    ranked = serving.rank_within(a, "all", "newest", "id", 1_000_000_000).withColumn("rank", F.col("rank").cast("bigint"))
    return serving.story_filter(ranked, ["T1", "T5"], 40).select("id", "rank")


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""")
def dimension_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.where("r_name = 'ASIA'").groupBy("c_mktsegment", "o_orderpriority")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


# --- briefs and evaluation ---------------------------------------------------------------------


@query(f"""WITH {SQL_ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY published_ms DESC, id) AS r FROM articles)
SELECT cluster, id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY published_ms, id) AS INTEGER) AS n FROM r WHERE r <= 8""")
def brief_items(spark, sf):
    return briefs.pick_items(articles(spark, sf), "cluster").select("cluster", "id", F.col("n").cast("int").alias("n"))


@query()
def extractive_brief(spark, sf):
    return briefs.extracts(briefs.pick_items(articles(spark, sf), "cluster"), "cluster")


@query()
def brief_validate(spark, sf):
    a = articles(spark, sf).join(extractive_brief(spark, sf), "cluster").select("id", "text", F.lit(8).alias("n"), "summary")
    return a.select("id", briefs.checked("text", "n", "summary").alias("problems"))


@query(f"WITH {SQL_ARTICLES} SELECT cluster, substr(sha256(string_agg(id::VARCHAR, '|' ORDER BY id::VARCHAR)), 1, 16) AS hash FROM articles GROUP BY cluster")
def membership_hash(spark, sf):
    g = articles(spark, sf).groupBy("cluster").agg(F.collect_list(F.col("id").cast("string")).alias("m"))
    return g.select("cluster", briefs.membership_hash("m").alias("hash"))


_LABELS = f"""{_VOL}, after AS (SELECT p.symbol, p.now_ms, a.close AS p0, b.close AS p1 FROM probes p ASOF LEFT JOIN bars a ON a.symbol = p.symbol AND p.now_ms >= a.end_ms
  ASOF LEFT JOIN (SELECT symbol, end_ms - {6 * STEP} AS e, close FROM bars) b ON b.symbol = p.symbol AND p.now_ms >= b.e),
l AS (SELECT symbol, now_ms, abs(ln(p1 / p0)) > 1.0 * sigma * sqrt(6) AS label FROM after JOIN vol USING (symbol, now_ms))"""


def _labels(spark, sf):
    b = bars(spark, sf)
    p = probes(spark, sf).withColumn("after_ms", F.col("now_ms") + 6 * STEP)
    p = market.close_at(market.close_at(p, b, "now_ms", max_age_ms=None, out="p0"), b, "after_ms", max_age_ms=None, out="p1")
    rows = _vol(spark, sf, p)
    return rows.select("symbol", "now_ms", evaluation.moved(market.log_return(F.col("p0"), F.col("p1")), F.col("sigma"), 6.0, 1.0).alias("label"))


@query(f"WITH {_LABELS} SELECT symbol, now_ms, label FROM l")
def label_moves(spark, sf):
    return _labels(spark, sf)


@query(f"""WITH {_LABELS}, k AS (SELECT now_ms, label::INT AS y, row_number() OVER (PARTITION BY now_ms ORDER BY symbol) AS r, row_number() OVER (PARTITION BY now_ms ORDER BY label DESC, symbol) AS i FROM l WHERE label IS NOT NULL)
SELECT now_ms, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(y) FILTER (WHERE r <= 3) / least(3, count(*)), 6) AS "precision",
  round(sum(CASE WHEN y = 1 AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / sum(CASE WHEN y = 1 AND i <= 10 THEN 1 / log2(i + 1) ELSE 0 END), 6) AS ndcg
FROM k GROUP BY now_ms HAVING sum(y) > 0""")
def precision_ndcg(spark, sf):
    rows = _labels(spark, sf).where("label is not null").withColumn("zero", F.lit(0))
    ranked = serving.rank_within(rows, "now_ms", "zero", "symbol", 1000)
    out = evaluation.quality(ranked, "now_ms", "rank", "label", 3, 10)
    return out.select("now_ms", "n", F.col("positives").cast("bigint").alias("positives"), _r("precision", F.col("precision")), _r("ndcg", F.col("ndcg")))


@query()
def replay_stories(spark, sf):
    """The whole engine over the test tables: bars from events, articles from documents, clusters, ranks, briefs."""
    return replay.run(articles_for_replay(spark, sf), bars_for_replay(spark, sf), every_ms=2 * STEP, window_ms=6 * STEP, max_age_ms=4 * STEP)


def articles_for_replay(spark, sf):
    a = articles(spark, sf)
    return a.select(F.format_string("a%010d", "id").alias("id"), "title", T.truncated(F.col("summary")).alias("summary"), "source", "published_ms", F.col("published_ms").alias("observed_ms"), "tickers")


def bars_for_replay(spark, sf):
    b = bars(spark, sf)
    name = F.create_map(*[F.lit(x) for i, t in enumerate(_TOPICS) for x in (t, f"T{i}")])
    return b.withColumn("symbol", name[F.col("symbol")])


