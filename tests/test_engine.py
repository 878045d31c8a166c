"""Closed-form values and small cases of the engine's operators."""

import json
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.config import Watchlist, prior
from newsloom.functions import scoring as S
from newsloom.functions import text as T
from newsloom.functions import vectors as V
from newsloom.operators import briefs, clusters, dedup, embedding, evaluation, events, market, serving
from newsloom.operators.tickers import Finder
from newsloom.plans import queries, replay
from newsloom.sources import parsers
from newsloom.sources import replay as feeds
from newsloom.streaming import streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_score_values(spark):
    lit = F.lit
    r = one(
        spark, S.velocity(lit(5), lit(0)).alias("a"), S.velocity(lit(0), lit(20)).alias("b"), S.credibility(lit(0.9), lit(1)).alias("c"), S.credibility(lit(0.8), lit(3)).alias("d"),
        S.recency(lit(3_600_000), lit(1_800_000)).alias("e"), S.ema(F.array(lit(1.0), lit(0.0), lit(1.0))).alias("f"), S.novelty(lit(None).cast("double")).alias("g"), S.novelty(lit(1.2)).alias("h"),
    )
    assert [round(x, 4) for x in r] == [0.9933, 0.2529, 0.3541, 0.6215, 0.7071, 0.75, 1.0, 0.0]


def test_missing_component_renormalises(spark):
    parts = {k: F.lit(1.0) for k in ("velocity", "credibility", "recency", "novelty")} | {"market": F.lit(None).cast("double")}
    assert one(spark, S.combined(parts))[0] == pytest.approx(1.0)


def test_eligibility_and_broad(spark):
    lit, none = F.lit, F.lit(None).cast("double")
    r = one(spark, S.eligible(lit(2), lit(0.1), none), S.eligible(lit(1), lit(0.95), lit(0.8)), S.eligible(lit(1), lit(0.95), none), S.is_broad(lit(6), lit(6), lit(12)), S.is_broad(lit(7), lit(6), lit(12)))
    assert list(r) == [True, True, False, False, True]


def test_bars_and_asof(spark):
    ticks = spark.createDataFrame([("A", 10.0, 1.0, 0, 0), ("A", 12.0, 2.0, 30_000, 1), ("A", 9.0, 1.0, 30_000, 2), ("A", 11.0, 1.0, 60_000, 3)], "symbol string, price double, size double, ts_ms bigint, seq bigint")
    bars = market.bars(ticks)
    first = bars.where("start_ms = 0").first()
    assert (first.open, first.high, first.low, first.close, first.volume) == (10.0, 12.0, 9.0, 9.0, 4.0)
    probes = spark.createDataFrame([("A", 59_999), ("A", 60_000), ("A", 120_000), ("A", 10_000_000), ("B", 60_000)], "symbol string, at bigint")
    seen = {(r.symbol, r["at"]): r.close_at for r in market.close_at(probes, bars, "at").collect()}
    assert seen == {("A", 59_999): None, ("A", 60_000): 9.0, ("A", 120_000): 11.0, ("A", 10_000_000): None, ("B", 60_000): None}
    strict = {r["at"]: r.close_at for r in market.close_at(probes.where("symbol = 'A'"), bars, "at", strict=True).collect()}
    assert strict[60_000] is None and strict[120_000] == 9.0


def test_asof_over_buckets_has_no_inequality_join(spark):
    rng = random.Random(3)
    facts = [("S", rng.randrange(10**6), float(i)) for i in range(300)]
    facts = list({t: (s, t, v) for s, t, v in facts}.values())
    at = [rng.randrange(10**6) for _ in range(200)]
    f = spark.createDataFrame(facts, "symbol string, end_ms bigint, close double")
    p = spark.createDataFrame([("S", t) for t in at], "symbol string, at bigint")
    out = market.asof(p, f, "symbol", "at", "end_ms", "close", bucket_ms=7919)
    want = sorted((t, max(((e, v) for _, e, v in facts if e <= t), default=(0, None))[1]) for t in at)
    assert sorted((r["at"], r["asof"]) for r in out.collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_late_ticks_of_a_closed_minute_are_dropped(spark):
    rows = spark.createDataFrame([("A", 1.0, 1.0, 10, 0, 0), ("A", 1.0, 1.0, 60_010, 1, 1), ("A", 5.0, 1.0, 20, 2, 2)], "symbol string, price double, size double, ts_ms bigint, seq bigint, arrival bigint")
    assert market.in_order_ticks(rows).count() == 2


def test_returns_keep_the_bar_before_the_range_and_skip_gaps(spark):
    bars = spark.createDataFrame([("A", 60_000, 1.0), ("A", 120_000, math.e), ("A", 900_000, 5.0), ("A", 960_000, -1.0)], "symbol string, end_ms bigint, close double")
    got = market.returns(bars).collect()
    assert [(r.end_ms, round(r.ret, 9)) for r in got] == [(120_000, 1.0)]


def test_correlation_is_zero_when_flat(spark):
    probes = spark.createDataFrame([("k", "A", 7_200_000)], "key string, symbol string, now_ms bigint")
    none = spark.createDataFrame([], "symbol string, end_ms bigint, ret double")
    cover = spark.createDataFrame([("k", 7_000_000)], "key string, ts_ms bigint")
    assert market.lead_lag(probes, none, cover).first().rho == 0.0


def test_lead_lag_matches_numpy(spark):
    rng = np.random.default_rng(1)
    now, minute = 7_200_000, 60_000
    ret = {i: float(rng.normal()) for i in range(120) if rng.random() < 0.6}
    count = {i: int(rng.integers(1, 4)) for i in range(120) if rng.random() < 0.4}
    a, c = np.zeros(120), np.zeros(120)
    for i, r in ret.items():
        a[i] = abs(r)
    for i, n in count.items():
        c[i] = n
    want = max(0.0, *(np.corrcoef(a[: 120 - lag], c[lag:])[0, 1] for lag in range(6)))
    probes = spark.createDataFrame([("k", "A", now)], "key string, symbol string, now_ms bigint")
    rows = spark.createDataFrame([("A", (i + 1) * minute, r) for i, r in ret.items()], "symbol string, end_ms bigint, ret double")
    cover = spark.createDataFrame([("k", i * minute + 5) for i, n in count.items() for _ in range(n)], "key string, ts_ms bigint")
    assert market.lead_lag(probes, rows, cover).first().rho == pytest.approx(want)


def test_late_rows_strictly_before_the_mark(spark):
    rows = [("t", "x", 100, 0), ("t", "x", 50, 1), ("t", "x", 40, 2), ("t", "watermark", 90, 3), ("t", "x", 90, 4), ("t", "x", 89, 5)]
    df = spark.createDataFrame(rows, "topic string, kind string, ts_ms bigint, arrival bigint")
    late = {r.arrival: r.late for r in events.late_flags(df, 50).collect()}
    assert late == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_jobs_fall_on_multiples_strictly_after_the_start(spark):
    grid = events.job_grid(spark.createDataFrame([(60_000, 180_000)], "first_ms bigint, last_ms bigint"))
    rows = sorted((r.due_ms, r.priority, r.job) for r in grid.collect())
    assert rows == [(90_000, 1, "rank"), (120_000, 0, "recluster"), (120_000, 1, "rank"), (150_000, 1, "rank"), (180_000, 0, "recluster"), (180_000, 1, "rank")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com/a//b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("https://example.com:443/", "https://example.com/"),
        ("https://u:p@example.com:8080/x/?FBCLID=1", "https://example.com:8080/x"),
        ("https://example.com", "https://example.com/"),
    ],
)
def test_canonical_url(url, want):
    assert T.canonical(url) == want


def test_text_cleaning(spark):
    assert T.plain_text("<p>Fed&nbsp;holds <b>rates</b> &amp;amp; waits</p>") == "Fed holds rates & waits"
    assert T.plain_text(None) == ""
    r = one(
        spark, T.truncated(F.lit("aaa bbb, ccc"), 9), T.truncated(F.lit("aaaaaaaaaa"), 5), T.truncated(F.lit("short")), T.without_title(F.lit("Big News: more here"), F.lit("big news")),
        T.without_boilerplate(F.lit("Text. Continue reading on the site")), T.normal_title(F.lit("Bitcoin falls - The Daily")), T.embed_text(F.lit("t"), F.lit("")),
    )
    assert list(r) == ["aaa bbb…", "aaaaa…", "short", "more here", "Text.", "bitcoin falls", "t"]


def test_title_noise(spark):
    titles = ["ACME Earnings Preview", "Crypto Market Today: up", "XRP Price Prediction for May", "Plain title"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(T.is_noise(F.col("t"))).collect()] == [True, True, True, False]


def test_simhash_is_near_for_near_titles():
    a, b, c = (T.simhash(x) for x in ("Fed holds rates steady as inflation cools", "Fed holds rates steady as inflation cools - Outlet News", "Nvidia beats estimates on data centre sales"))
    assert a == b and a != c and T.simhash("") == 0


def test_near_greedy_keeps_what_a_dropped_row_is_near_to(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        h = rng.getrandbits(63) if i % 4 == 0 or not rows else rows[-1][1] ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))
        rows.append((i, h if i % 17 else 0, i))
    kept, want = [], {}
    for i, h, _ in rows:
        near = h != 0 and any((h ^ k).bit_count() <= 3 for k in kept)
        want[i] = not near
        if not near and h:
            kept.append(h)
    got = {r.id: r.kept for r in dedup.near_greedy(spark.createDataFrame(rows, "id bigint, simhash bigint, ord bigint")).collect()}
    assert got == want


def test_cleaning_reasons(spark):
    rows = [
        (1, "s", "Bitcoin falls below support as ETF flows turn negative", "https://a.com/1?utm_source=x", "Read more here", 10, 20, 0),
        (2, "s", "Bitcoin falls below support as ETF flows turn negative", "https://a.com/1", "", 10, 30, 1),
        (3, "s", "Bitcoin falls below support as ETF flows turn negative - Wire", "https://b.com/9", "", 99, 40, 2),
        (4, "s", "ACME Earnings Preview", "https://c.com/", "", 1, 50, 3),
        (5, "s", " ", "https://d.com/", "", 1, 60, 4),
    ]
    raw = spark.createDataFrame(rows, "n int, source string, title string, url string, summary string, published_ms bigint, observed_ms bigint, seq bigint").withColumn("id", F.lit(""))
    got = {r.n: (r.reason, r.published_ms, r.tickers) for r in dedup.clean(raw).collect()}
    assert {n: v[0] for n, v in got.items()} == {1: None, 2: "exact", 3: "near", 4: "noise", 5: "empty"}
    assert got[3][1] == 40 and got[1][2] == ["BTC"]


TICKER_CASES = [
    ("Bitcoin rises and $ETH follows", ["BTC", "ETH"]),
    ("Chip maker (NASDAQ: NVDA) gains", ["NVDA"]),
    ("The CEO of an AI firm in the USA spoke to the SEC", []),
    ("Uniswap and Chainlink climb", ["LINK", "UNI"]),
    ("Ripple effects of the storm", []),
    ("Ripple wins as crypto rallies", ["XRP"]),
    ("Apple pie recipe shares", []),
    ("Apple shares rise", ["AAPL"]),
    ("ETH Zurich publishes study", []),
    ("MATIC holders move to the new token", ["POL"]),
    ("Polygon.io ships data", []),
    ("Polygon blockchain upgrade", ["POL"]),
    ("Goldman Sachs and JPMorgan Chase report", ["GS", "JPM"]),
    ("Costs $BTCX", []),
]


@pytest.mark.parametrize(("text", "want"), TICKER_CASES)
def test_tickers(text, want):
    assert Finder(Watchlist()).symbols(text) == want


def test_mentions_do_not_overlap():
    found = Finder().find("$BTC BTC Bitcoin (NYSE: GS) Goldman Sachs")
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and len(found) == 5


def test_silhouette_picks_three_blobs():
    rng = np.random.default_rng(0)
    centers = np.linalg.qr(rng.normal(size=(16, 16)))[0][:3]
    x = np.concatenate([c + rng.normal(scale=0.08, size=(30, 16)) for c in centers])
    assert clusters.select_k(x)[0] == 3
    assert clusters.select_k(x[:5])[0] == 1


def test_assignment_is_best():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for shape in ((4, 4), (3, 5), (5, 3), (1, 1)):
        s = rng.random(shape)
        got = sum(s[r, c] for r, c in clusters.assign(s))
        small, large = sorted(shape)
        m = s if shape[0] <= shape[1] else s.T
        assert got == pytest.approx(max(sum(m[i, p[i]] for i in range(small)) for p in permutations(range(large), small)))


def test_cluster_ids_persist_and_change_with_generations():
    rng = np.random.default_rng(0)
    centers = np.linalg.qr(rng.normal(size=(16, 16)))[0][:3]
    x = np.concatenate([c + rng.normal(scale=0.05, size=(12, 16)) for c in centers])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"a{i:03d}" for i in range(36)]
    c = clusters.Clusterer()
    c.refit(0, ids, x)
    first = {k: v.members for k, v in c.clusters.items()}
    c.refit(60_000, ids[:-1], x[:-1])
    assert set(c.clusters) == set(first) and not c.fresh and all(v.born_ms == 0 for v in c.clusters.values())
    c.refit(120_000, ids[:-1], x[:-1][:, ::-1].copy(), generation=2)
    assert set(c.clusters) == set(first)
    c.refit(180_000, ids[:12], x[:12])
    assert len(c.gone) >= 2 and set(c.gone) <= set(c.retired)


def test_labels_drop_subsets():
    assert clusters.without_subsets(["fed rate", "fed", "rate cut path", "rate cut"], 3) == ["fed rate", "rate cut path"]
    terms = clusters.label_terms({"a": ["Fed holds rates", "Fed rates steady"], "b": ["Nvidia chips sell", "Nvidia chips"]})
    assert "fed" in " ".join(terms["a"]) and "nvidia" in " ".join(terms["b"])


def test_sentences_numbers_and_checks():
    assert briefs.sentences('Rates fell in the U.S. Fed vote. [1] Next came "X". [2]') == ["Rates fell in the U.S. Fed vote. [1]", 'Next came "X". [2]']
    assert [briefs.plain_number(x) for x in ("1,200", "2.50", "09:30", "007", "0.5")] == ["1200", "2.5", "9:30", "7", "0.5"]
    source = "[1] BTC fell -2.1% at 13:09 on 1,200 trades"
    assert briefs.problems("BTC fell 2.1% on 1200 trades. [1]", 1, source) == []
    found = briefs.problems("BTC rose +2.1% to 9. [2] No citation here.", 1, source)
    assert any("invalid citation" in p for p in found) and any("uncited" in p for p in found) and any("sign" in p for p in found) and any("number not in input: 9" in p for p in found)
    assert briefs.problems("  ", 1, "") == ["empty"]


def test_extract_cites_and_prefers_variety():
    items = [{"n": 1, "title": "Fed holds rates", "summary": ""}, {"n": 2, "title": "Fed holds rates", "summary": ""}, {"n": 3, "title": "Oil prices jump on supply", "summary": ""}, {"n": 4, "title": "Oil prices jump on supply", "summary": ""}]
    text = briefs.extract(items, ["BTC +1.0%"], 2)
    assert "[3]" in text and text.endswith("Why it matters: BTC +1.0%.")


def test_briefer_falls_back_and_gives_up():
    class Bad:
        calls = 0

        def complete(self, system, user):
            Bad.calls += 1
            raise RuntimeError

    b = briefs.Briefer(Bad())
    items = [{"n": 1, "title": "Fed holds rates", "summary": ""}]
    for i in range(5):
        assert b.brief(f"c{i}", ["x"], items, [])[1] == "extractive"
    assert Bad.calls == 3


def test_membership_and_refresh(spark):
    r = one(spark, briefs.membership_hash(F.array(F.lit("b"), F.lit("a"))), briefs.needs_brief(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), F.lit(0)), briefs.needs_brief(F.array(F.lit(1)), F.array(F.lit(2)), F.lit(0)))
    assert list(r) == [briefs.membership(["a", "b"]), False, True]


def test_embedder_chain():
    class Broken:
        embedder_id, dim = "broken", 4

        def embed(self, texts):
            raise RuntimeError

    chain = embedding.Chain([Broken(), embedding.HashingEmbedder(8)])
    assert chain.sync(["a"], ["a", "b"]) is None and chain.sync(["a"], ["a", "b"]) is None
    assert chain.sync(["a"], ["alpha beta", "gamma"]).shape == (2, 8) and chain.generation == 2 and chain.status == "regenerated"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 0.0])], "k int, v array<double>")
    assert [r[0] for r in df.select(V.unit("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert V.mean_vectors(df, "k", "v", unit_length=False).first().centroid == [1.5, 2.0]


def test_prior(spark):
    df = spark.createDataFrame([("sec",), ("nobody",), ("cryptopanic:x.com",)], "s string")
    assert [r[0] for r in df.select(prior(F.col("s"))).collect()] == [0.95, 0.5, 0.5]


def test_quality_and_stride(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "t int, rank int, label boolean")
    row = evaluation.quality(df, "t", "rank", "label").collect()
    assert len(row) == 1 and row[0].precision == 0.5 and row[0].ndcg == pytest.approx(1 / math.log2(3))
    assert evaluation.strided([0, 5, 12, 20, 25], 10) == [0, 12, 25]


def test_serving(spark):
    a = spark.createDataFrame([("k", 1, "old")], "id string, t int, v string")
    b = spark.createDataFrame([("k", 0, "new"), ("m", 1, "x")], "id string, t int, v string")
    assert {(r.id, r.v) for r in serving.upsert(a, b, ["id"], ["t"]).collect()} == {("k", "new"), ("m", "x")}
    assert serving.insert_new(a, b, ["id"]).count() == 2
    c = spark.createDataFrame([("c00009",), ("c00012",), ("odd",)], "id string")
    assert serving.next_cluster_number(c).first()["next"] == 13
    assert serving.digest(b).first()[0] == serving.digest(b.orderBy(F.desc("id"))).first()[0]


def test_subscriber_filter(spark):
    rows = [("snapshot", [(1, ["BTC"]), (2, ["ETH"])]), ("cluster_update", [(3, ["ETH"])]), ("market_brief", [])]
    df = spark.createDataFrame(rows, "kind string, stories array<struct<rank:int,tickers:array<string>>>")
    got = {r.kind: [s.rank for s in r.stories] for r in serving.for_subscriber(df, ["BTC"]).collect()}
    assert got == {"snapshot": [1], "market_brief": []}


def test_parsers(spark):
    xml = "<rss><channel><item><title>A</title><link>https://a.com/1</link><pubDate>Mon, 21 Sep 2026 09:00:00 -0400</pubDate></item><item><title>B</title><link>https://a.com/2</link></item><item><title>no link</title></item></channel></rss>"
    docs = spark.createDataFrame([("s", xml, 5), ("s", "not xml", 6), ("s", None, 7)], "source string, content string, observed_ms bigint")
    got = {r.title: (r.published_ms, r.ts_inferred) for r in parsers.rss(docs).collect()}
    assert got == {"A": (1789995600000, False), "B": (5, True)}
    body = json.dumps({"results": [{"url": "https://x.com/1", "title": "T", "published_at": "2026-09-21T13:00:00Z", "source": {"domain": "d.com"}}, {"title": "none"}]})
    r = parsers.news_api(spark.createDataFrame([(body, 1)], "body string, observed_ms bigint")).collect()
    assert [(x.source, x.published_ms) for x in r] == [("cryptopanic:d.com", 1789995600000)]
    msgs = [json.dumps(m) for m in ({"type": "ticker", "product_id": "BTC-USD", "price": "2.5", "time": "2026-09-21T13:00:00Z"}, {"type": "heartbeat"})]
    r = parsers.crypto_ticks(spark.createDataFrame([(m,) for m in msgs], "body string")).collect()
    assert [(x.symbol, x.price, x["size"]) for x in r] == [("BTC", 2.5, 0.0)]
    frame = json.dumps([{"ev": "status", "status": "ok"}, {"ev": "T", "sym": "AAPL", "p": 1.5, "s": 2, "t": 7}])
    f = spark.createDataFrame([(frame,)], "body string")
    assert parsers.equity_ticks(f).first().ts_ms == 7 and parsers.equity_statuses(f).count() == 1
    page = spark.createDataFrame([("B", "[[60,1,4,2,3,9],[60,1,4,2,3,9]]")], "symbol string, body string")
    assert [(r.start_ms, r.open, r.high, r.low, r.close) for r in parsers.candles(page).collect()] == [(60_000, 2.0, 4.0, 1.0, 3.0)]


def test_feed_reader(spark, tmp_path):
    lines = [{"type": "news", "ts_ms": 10, "source": "s", "title": "t", "url": "https://a.com/?utm_x=1"}, {"type": "bar", "ts_ms": 60_000, "symbol": "B", "start_ms": 0, "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}]
    path = os.path.join(tmp_path, "feed.jsonl")
    with open(path, "w") as f:
        f.write("\n\n".join(json.dumps(x) for x in lines))
    feed = feeds.read_feed(spark, path)
    assert feeds.news(feed).first().published_ms == 10 and feeds.bars(feed).first().venue == "fixture"
    assert feeds.envelopes(feed).where("kind = 'watermark'").count() == 4
    feeds.write_feed(feed.drop("seq"), os.path.join(tmp_path, "out"))
    assert feeds.read_feed(spark, os.path.join(tmp_path, "out")).count() == 2


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = [("A", float(i % 7 + 1), 1.0, i * 20_000, i) for i in range(60)]
    schema = "symbol string, price double, size double, ts_ms bigint, seq bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.minute_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start_ms, r.close) for r in spark.table("bars_out").collect()}
    batch = {(r.start_ms, r.close) for r in market.bars(spark.createDataFrame(rows, schema)).collect()}
    assert got and got <= batch and len(batch) - len(got) <= 3


def test_streamed_machine_keeps_its_state(spark, tmp_path):
    e = embedding.HashingEmbedder(32)
    texts = ["fed holds rates steady", "fed keeps rates steady", "nvidia sells chips", "nvidia chips sell"]
    vec = e.embed(texts)
    rows = [("r", t, f"a{i}", texts[i], "", f"s{i}", 0.7, 100 + i, ["BTC"], [float(x) for x in vec[i]]) for t in (60_000, 120_000) for i in range(4)]
    schema = "run string, due_ms bigint, id string, title string, summary string, source string, prior double, published_ms bigint, tickers array<string>, vector array<double>"
    for n, t in enumerate((60_000, 120_000)):
        spark.createDataFrame([r for r in rows if r[1] == t], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={n}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = replay.stories_stream(src).writeStream.format("memory").queryName("stories_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("stories_out").toPandas()
    assert set(got["snapshot_ms"]) == {60_000, 120_000}
    assert set(got[got.snapshot_ms == 60_000].cluster_id) == set(got[got.snapshot_ms == 120_000].cluster_id)


def test_machine_scores_and_briefs():
    e = embedding.HashingEmbedder(64)
    titles = ["Fed holds rates", "Fed rates on hold", "Fed keeps rates"]
    rows = pd.DataFrame({"id": ["a", "b", "c"], "title": titles, "summary": ["", "", ""], "source": ["fed", "sec", "cnbc"], "prior": [0.95, 0.95, 0.85], "published_ms": [1, 2, 3], "tickers": [["BTC"]] * 3, "vector": list(e.embed(titles))})
    m = replay.Machine()
    first = m.tick(60_000, rows, {"BTC": (2.0, 0.0)})[0]
    second = m.tick(120_000, rows, {})[0]
    assert first["rank"] == 1 and first["market"] == pytest.approx(0.7 * (1 - math.exp(-1)), abs=1e-6) and second["market"] is None
    assert second["score"] == pytest.approx(0.5 * second["raw_score"] + 0.5 * first["raw_score"], abs=2e-6) and first["brief"] == second["brief"]


def plain_kmeans(x, k, seed=7, starts=3, steps=100):
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        c = [x[rng.integers(len(x))]]
        d = ((x - c[0]) ** 2).sum(axis=1)
        for _ in range(1, k):
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
            d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
        c, labels = np.array(c), None
        for _ in range(steps):
            new = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for j in set(labels.tolist()):
                c[j] = x[labels == j].mean(axis=0)
        inertia = ((x - c[labels]) ** 2).sum()
        if best is None or inertia < best[2] - 1e-12:
            best = labels, c, inertia
    return best


def test_kmeans_that_skips_vectors_equals_lloyd():
    rng = np.random.default_rng(5)
    for n, k in ((400, 7), (60, 20), (5, 5)):
        x = rng.normal(size=(n, 6)) + rng.integers(0, 4, size=(n, 1))
        x[: n // 3] = x[n // 3 : 2 * (n // 3)]  # copies
        for mine in (clusters.kmeans(x, k), clusters.kmeans(x.astype(np.float32), k)):
            want = plain_kmeans(x, k)
            assert (mine[0] == want[0]).all() and np.allclose(mine[1], want[1], atol=1e-5) and mine[2] == pytest.approx(want[2], rel=1e-5)


def plain_silhouette(x, labels):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(length == 0, 1, length)
    far, out = 1 - u @ u.T, []
    np.fill_diagonal(far, 0)
    for i, own in enumerate(labels):
        if (labels == own).sum() == 1:
            out.append(0.0)
            continue
        a = far[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(far[i, labels == j].mean() for j in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_by_sums_equals_all_pairs():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5)) + 2 * np.eye(5)[rng.integers(0, 3, 90)]
    x[:2], x[10:20] = 0, x[20:30]
    labels = rng.integers(0, 4, 90)
    labels[labels == 3] = 5  # a name that is no place
    labels[50] = 9  # alone
    for own in (x, x.astype(np.float32)):
        assert clusters.silhouette(own, labels) == pytest.approx(plain_silhouette(own.astype(float), labels), abs=1e-9)
    assert clusters.silhouette(x, np.zeros(90, dtype=int)) is None and clusters.silhouette(x, np.arange(90)) is None


def test_number_of_clusters_comes_from_all_vectors():
    rng = np.random.default_rng(9)
    x = rng.normal(scale=0.4, size=(2500, 6)) + np.eye(6)[rng.integers(0, 4, 2500)]
    k, scores = clusters.select_k(x, k_max=6)
    want = {j: plain_silhouette(x, plain_kmeans(x, j)[0]) for j in range(2, 7)}
    assert scores == pytest.approx(want, abs=1e-9) and k == max(want, key=lambda j: (round(want[j], 6), -j))
    fit = clusters.better(clusters.best_fit(x, [2, 5]), clusters.best_fit(x, [3, 4, 6]))  # in shares
    assert fit[:2] == (k, scores) and (fit[2][0] == clusters.kmeans(x, k)[0]).all()


def test_numbers_of_clusters_tried_in_several_tasks(spark):
    assert sorted(k for ks in replay._shares(5000, 7) for k in ks) == list(range(2, 31)) and max(map(sum, replay._shares(5000, 7))) < 75
    sf = "/root/testdata/sf0.001"
    articles, bars = queries.articles_for_replay(spark, sf), queries.bars_for_replay(spark, sf)
    step = 3_600_000
    spread, one = ([r.asDict() for r in replay.run(articles, bars, 2 * step, 6 * step, 4 * step, alone=n).orderBy("snapshot_ms", "rank").collect()] for n in (20, 4096))
    assert spread == one and len(one) > 20


def test_run_equals_one_machine_over_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    articles, bars = queries.articles_for_replay(spark, sf), queries.bars_for_replay(spark, sf)
    step = 3_600_000
    got = replay.run(articles, bars, 2 * step, 6 * step, 4 * step).toPandas().sort_values(["snapshot_ms", "rank"])
    seen, moves = replay.tick_inputs(articles, bars, 2 * step, 6 * step, 4 * step)
    moves = {due: {r.symbol: (r.sigmas, 0.0) for r in own.itertuples()} for due, own in moves.toPandas().groupby("due_ms")}
    machine, want = replay.Machine(), []
    for now, rows in seen.toPandas().sort_values(["due_ms", "published_ms", "id"]).groupby("due_ms"):
        want += machine.tick(int(now), rows, moves.get(now, {}), step // 2, 6 * step)
    assert len(want) == len(got) > 20 and got["brief"].notna().sum() > 5
    for w, g in zip(want, got.to_dict("records"), strict=True):
        g["tickers"] = list(g["tickers"])
        assert {c: None if g[c] is None or g[c] != g[c] else g[c] for c in w} == w


def test_the_machine_of_a_run_holds_one_tick(spark):
    e = embedding.HashingEmbedder(16)
    rows = pd.DataFrame({"id": list("abcde"), "source": "fed", "prior": 0.9, "published_ms": range(5), "tickers": [["BTC"]] * 5, "vector": list(e.embed(["Fed holds"] * 5))})
    made = replay._window(True)((pa.scalar(60_000),), pa.Table.from_pandas(rows.assign(moves=[[{"symbol": "BTC", "sigmas": 2.0}]] * 5)))
    read = []

    def pieces():
        for due in (60_000, 120_000):
            read.append(due)
            yield made.set_column(0, "due_ms", pa.array([due] * made.num_rows)).to_batches()[0]

    out = replay._told(3_600_000)(pieces())
    first = next(out)
    assert first.column("due_ms").to_pylist() == [60_000] and read == [60_000, 120_000] and "title" not in str(made.schema)
    assert [b.column("due_ms")[0].as_py() for b in out] == [60_000, 120_000, 120_000]
