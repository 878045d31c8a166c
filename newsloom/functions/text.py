"""Cleaning of titles, summaries and URLs. Column expressions where Spark has them, Arrow batches else."""

from __future__ import annotations

import hashlib
import re
from html import unescape
from html.parser import HTMLParser
from itertools import pairwise
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType, StringType

from newsloom.config import TITLE_NOISE
from newsloom.constants import SUMMARY_CHARS

# Patterns and keys that decide results.
BOILERPLATE = r"(?i)(The post .{0,200}? appeared first on .{0,80}?\.?$)|(Continue reading.*$)|(Read more.*$)"
TITLE_SUFFIX = r"\s+[-|–—]\s+[A-Z][\w .&]{1,30}$"
TITLE_WORD = r"[a-z0-9]+(?:'[a-z]+)?"
TRACKING_PREFIXES = ("utm_", "mc_", "ga_")
TRACKING_KEYS = (
    "fbclid", "gclid", "dclid", "msclkid", "ref", "ref_src", "cmpid", "taid", "ncid", "src",
    "cid", "mod", "yptr", "guccounter", "guce_referrer", "guce_referrer_sig", "sr_share",
)


class _Pieces(HTMLParser):
    """Text between tags, without scripts' and styles' own text being joined to words around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(data.strip())


def plain_text(text: str | None) -> str:
    """Tags away, pieces joined by spaces, entities resolved (twice if they were escaped twice), white space collapsed."""
    if not text:
        return ""
    if "<" in text or "&" in text:
        parser = _Pieces()
        parser.feed(text)
        parser.close()
        text = " ".join(parser.found)
    return " ".join(unescape(text).split())


@F.pandas_udf(StringType())
def strip_html(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text, na_action=None)


def without_boilerplate(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BOILERPLATE, ""))


def without_title(summary: Column, title: Column) -> Column:
    """Cuts a title that the summary starts with, whatever its case, and the marks after it."""
    starts = F.startswith(F.lower(summary), F.lower(title))
    rest = F.substr(summary, F.length(title) + 1)
    return F.when(starts, F.regexp_replace(rest, r"^[ .:\-]+", "")).otherwise(summary)


def truncated(c: Column, limit: int = SUMMARY_CHARS) -> Column:
    """Up to ``limit`` characters; a longer text is cut at its last space within them, with an ellipsis."""
    head = F.substr(c, F.lit(1), F.lit(limit))
    cut = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[,;:\-]+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def canonical(url: str | None) -> str:
    """One spelling of a URL: https, lower-case host without www and default ports, no tracking, sorted query."""
    parts = urlsplit((url or "").strip())
    scheme = parts.scheme if parts.scheme not in ("", "http", "https") else "https"
    host = (parts.hostname or "").removeprefix("www.")
    try:
        port = parts.port
    except ValueError:
        port = None
    if port and port not in (80, 443):
        host += f":{port}"
    path = re.sub("//+", "/", parts.path) or "/"
    if path != "/":
        path = path.removesuffix("/")
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    kept = sorted((k, v) for k, v in pairs if k.lower() not in TRACKING_KEYS and not k.lower().startswith(TRACKING_PREFIXES))
    return urlunsplit((scheme, host, path, urlencode(kept), ""))


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical, na_action=None)


def canonical_url_column(url: Column) -> Column:
    """The same for plain URLs (no user, no escapes in the query), inside Spark's generated code."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_extract(rest, r"\?(.*)$", 1)).otherwise(F.lit(""))
    place = F.regexp_replace(rest, r"\?.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(place, r"^[^/]*", ""), "/{2,}", "/")
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    keys = "|".join(TRACKING_KEYS)
    noise = rf"(?i)^(?:(?:{'|'.join(TRACKING_PREFIXES)})[^=]*|(?:{keys}))(?:=|$)"
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(noise))))
    return F.concat(F.lit("https://"), host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def article_id(canonical_: Column) -> Column:
    return F.sha2(canonical_.cast("binary"), 256)


def is_noise(title: Column, patterns: tuple[str, ...] = TITLE_NOISE) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= title.rlike(p)
    return out


def normal_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, TITLE_SUFFIX, ""))


def embed_text(title: Column, summary: Column, limit: int = SUMMARY_CHARS) -> Column:
    has = F.length(F.coalesce(summary, F.lit(""))) > 0
    return F.when(has, F.concat(title, F.lit(". "), F.substr(summary, F.lit(1), F.lit(limit)))).otherwise(title)


_WORD = re.compile(TITLE_WORD)
_SUFFIX = re.compile(TITLE_SUFFIX)


def simhash(title: str | None) -> int:
    """64 bits as a signed integer: majority of the hashes of words and neighbouring pairs; 0 without words."""
    words = _WORD.findall(_SUFFIX.sub("", title or "").lower())
    features = [*words, *(" ".join(p) for p in pairwise(words))]
    if not features:
        return 0
    import numpy as np

    raw = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features), dtype=np.uint8)
    votes = np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(features)
    return int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def simhash64(titles: pd.Series) -> pd.Series:
    return titles.map(simhash, na_action=None).astype("int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hhmm(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm")
