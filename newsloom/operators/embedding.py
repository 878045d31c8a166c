"""Vectors for articles: a hashing embedder, a cache, and generations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: English words without content; one explicit list, used for vectors, labels and briefs.
STOP_WORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)
_TOKEN = re.compile(r"(?u)\b\w\w+\b")


class Embedder(Protocol):
    """Anything that turns texts into unit vectors."""

    embedder_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of one- and two-word terms in hashed places, scaled to length one."""

    def __init__(self, dim: int = 1024):
        self.dim = dim
        self.embedder_id = f"hashing/ngram12/blake2b/{dim}/stop{len(STOP_WORDS)}"

    def embed(self, texts: list[str]) -> np.ndarray:
        from hashlib import blake2b

        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        place: dict[str, int] = {}  # terms come again
        for i, text in enumerate(texts):
            words = [w for w in _TOKEN.findall(text.lower()) if w not in STOP_WORDS]
            at = []
            for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                p = place.get(term)
                if p is None:
                    p = place[term] = int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "big") % self.dim
                at.append(p)
            if at:
                out[i] = np.bincount(at, minlength=self.dim)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths == 0, 1, lengths)).astype(np.float32)


def embedded(texts: Column | str, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(list(embedder.embed(part.fillna("").tolist())), index=part.index)

    return run(texts)


def missing(articles: DataFrame, cache: DataFrame, embedder_id: str) -> DataFrame:
    """Articles whose vector the cache (embedder_id, article_id, vector) lacks."""
    own = cache.where(F.col("embedder_id") == embedder_id).select(F.col("article_id").alias("__a"))
    return articles.join(own, articles["id"] == own["__a"], "left_anti")


def synced(articles: DataFrame, cache: DataFrame, embedder: Embedder, text: Column) -> DataFrame:
    """The cache with a vector for every article; only those it lacks are embedded."""
    new = missing(articles, cache, embedder.embedder_id)
    made = new.select(F.lit(embedder.embedder_id).alias("embedder_id"), F.col("id").alias("article_id"), embedded(text, embedder).alias("vector"))
    return cache.select("embedder_id", "article_id", "vector").unionByName(made)


class Chain:
    """A primary embedder and fallbacks: after ``tries`` failures in a row the next one takes over as a new generation."""

    def __init__(self, embedders: list[Embedder], tries: int = 3):
        self.embedders, self.tries = embedders, tries
        self.at, self.failures, self.generation = 0, 0, 1
        self.status = "idle"

    @property
    def current(self) -> Embedder:
        return self.embedders[self.at]

    def sync(self, texts: list[str], everything: list[str]) -> np.ndarray | None:
        """Vectors of ``texts``; of ``everything`` when the generation changes; None while degraded."""
        try:
            out = self.current.embed(texts)
            self.failures, self.status = 0, "ok"
            return out
        except Exception:
            self.failures += 1
            self.status = "degraded"
            if self.failures < self.tries or self.at + 1 >= len(self.embedders):
                return None
        self.at += 1
        self.generation += 1
        self.failures = 0
        out = self.current.embed(everything)
        self.status = "regenerated"
        return out
