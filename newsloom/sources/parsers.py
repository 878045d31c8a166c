"""Messages of news and price services to typed rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from newsloom.functions import text as T

_ITEM = ArrayType(StructType([StructField(c, StringType()) for c in ("title", "url", "summary")] + [StructField("published_ms", LongType())]))
_ATOM = "{http://www.w3.org/2005/Atom}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def moment(text: str | None) -> int | None:
    """Milliseconds of an RFC 822 or ISO time; a time without a zone is UTC."""
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            t = read((text or "").strip().replace("Z", "+00:00"))
        except (ValueError, TypeError):
            continue
        return round((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)
    return None


def feed_items(xml: str | None) -> list[dict]:
    """Entries with a link and a title of an RSS or Atom document; [] if it is not XML."""
    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError:
        return []
    out = []
    for node in [*root.iter("item"), *root.iter(f"{_ATOM}entry")]:
        said = {c.tag.removeprefix(_ATOM): (c.text or "").strip() for c in node if c.tag != f"{_ATOM}link"}
        link = said.get("link") or next((c.get("href") for c in node.iter(f"{_ATOM}link") if c.get("href")), None)
        if not link or not said.get("title"):
            continue
        times = (said.get(k) for k in ("pubDate", "published", f"{_DC}date", "updated", "created"))
        out.append({"title": said["title"], "url": link, "summary": said.get("description") or said.get("summary") or "", "published_ms": next((m for t in times if t and (m := moment(t)) is not None), None)})
    return out


@F.pandas_udf(_ITEM)
def _feed_items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in batches:
        yield part.map(feed_items)


def _raw_news(rows: DataFrame) -> DataFrame:
    known = F.col("published_ms").isNotNull()
    return rows.select(
        T.article_id(T.canonical_url("url")).alias("id"), "source", "title", "url", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("published_ms", "observed_ms").alias("published_ms"), "observed_ms", (~known).alias("ts_inferred"),
    )


def rss(documents: DataFrame) -> DataFrame:
    """(source, content, observed_ms) of fetched feeds to raw news."""
    items = documents.select("source", "observed_ms", F.explode(_feed_items("content")).alias("i")).select("source", "observed_ms", "i.*")
    return _raw_news(items)


def _iso_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def news_api(messages: DataFrame, aggregator: str = "cryptopanic") -> DataFrame:
    """(body, observed_ms) of an aggregator's JSON pages to raw news."""
    shape = "struct<results:array<struct<original_url:string,url:string,title:string,published_at:string,created_at:string,description:string,source:struct<domain:string>>>>"
    posts = messages.select("observed_ms", F.explode(F.from_json("body", shape)["results"]).alias("p"))
    blank = lambda c: F.when(c != "", c)
    url = F.coalesce(blank(F.col("p.original_url")), blank(F.col("p.url")))
    domain = F.col("p.source.domain")
    rows = posts.select(
        F.when(domain != "", F.concat(F.lit(f"{aggregator}:"), domain)).otherwise(F.lit(aggregator)).alias("source"), F.col("p.title").alias("title"), url.alias("url"),
        F.col("p.description").alias("summary"), _iso_ms(F.coalesce(blank(F.col("p.published_at")), blank(F.col("p.created_at")))).alias("published_ms"), "observed_ms",
    ).where("url is not null and title is not null and title <> ''")
    return _raw_news(rows)


def crypto_ticks(messages: DataFrame) -> DataFrame:
    """(body) of a crypto exchange's socket to ticks: ticker messages with a price and a time."""
    m = F.from_json("body", "struct<type:string,product_id:string,price:string,last_size:string,time:string>")
    rows = messages.select(m.alias("m")).where("m.type = 'ticker' and m.price is not null and m.time is not null")
    return rows.select(
        F.split("m.product_id", "-")[0].alias("symbol"), F.lit("crypto").alias("asset_class"), F.col("m.price").cast("double").alias("price"),
        F.coalesce(F.expr("try_cast(m.last_size AS DOUBLE)"), F.lit(0.0)).alias("size"), _iso_ms(F.col("m.time")).alias("ts_ms"), F.lit("coinbase").alias("venue"),
    )


_FRAME = "array<struct<ev:string,sym:string,p:double,s:double,t:bigint,status:string,message:string>>"


def equity_ticks(frames: DataFrame) -> DataFrame:
    """(body) of an equity service's frames (JSON arrays) to ticks: trades."""
    rows = frames.select(F.explode(F.from_json("body", _FRAME)).alias("m")).where("m.ev = 'T'")
    return rows.select(
        F.col("m.sym").alias("symbol"), F.lit("equity").alias("asset_class"), F.col("m.p").alias("price"), F.coalesce("m.s", F.lit(0.0)).alias("size"),
        F.col("m.t").alias("ts_ms"), F.lit("polygon").alias("venue"),
    )


def equity_statuses(frames: DataFrame) -> DataFrame:
    return frames.select(F.explode(F.from_json("body", _FRAME)).alias("m")).where("m.ev = 'status'").select("m.status", "m.message")


def candles(pages: DataFrame) -> DataFrame:
    """(symbol, body) of candle pages, rows [time s, low, high, open, close, volume], to one bar a minute."""
    rows = pages.select("symbol", F.explode(F.from_json("body", "array<array<double>>")).alias("c"))
    out = rows.select("symbol", (F.col("c")[0] * 1000).cast("bigint").alias("start_ms"), F.col("c")[3].alias("open"), F.col("c")[2].alias("high"), F.col("c")[1].alias("low"), F.col("c")[4].alias("close"), F.col("c")[5].alias("volume"))
    return out.dropDuplicates(["symbol", "start_ms"])
