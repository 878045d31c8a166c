"""Benchmark decontamination: a broadcast hash set of test n-grams against training windows.

Each benchmark item gives its windows of ``n`` consecutive normalised words (an item of fewer words
is one window). Their 64-bit hashes are broadcast and looked up at every position of every whole
document; each hit is verified word by word. No shuffle: documents are scanned where they lie.

A broadcast holds at most ``max_broadcast_bytes`` of benchmark text. A larger benchmark is cut by
item into parts under that bound and the scans of the parts are chained as narrow maps, so its size
changes the number of passes and never the result.

Defined results: a null or empty text has no words and is clean; benchmark rows with a null id or
text are ignored, repeated rows count once; repeated documents are judged each; an empty benchmark
leaves every document clean. Other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import alnum_words, entered

N = 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class WindowSet:
    """Windows of benchmark items by their length, with hashes for the scan and words for the proof."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, raw in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(raw)]
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                by_length.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(item)
        self.windows = by_length
        self.hashes = {}
        for k, found in by_length.items():
            rows = np.array(list(found), dtype=np.uint64).reshape(-1, k)
            self.hashes[k] = np.unique(self._rolled([rows[:, j] for j in range(k)]))

    @staticmethod
    def _rolled(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = h * _BASE + c
        return h

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per document: the verified windows as word ranges, and the items that they come from."""
        get = self.vocab.get
        flat: list[int] = []
        starts = []
        for words in docs:
            starts.append(len(flat))
            flat.extend([get(w, 0) for w in words])
            flat.append(0)
        ids = np.array(flat, dtype=np.uint64)
        starts = np.array(starts, dtype=np.int64)
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        gaps = np.cumsum(ids == 0)
        for k, hashes in self.hashes.items():
            m = len(ids) - k + 1
            if m <= 0:
                continue
            whole = np.flatnonzero((ids[:m] != 0) & (gaps[k - 1 :] == gaps[:m]))
            if not len(whole):
                continue
            h = self._rolled([ids[whole + j] for j in range(k)])
            at = whole[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
            for i, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                items = self.windows[k].get(tuple(flat[i : i + k]))
                if items:
                    a = i - int(starts[d])
                    out[d][0].append((a, a + k))
                    out[d][1].update(items)
        return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, bound: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark in parts of at most ``bound`` bytes of text each (an item is never split)."""
    parts, size = [[]], 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for r in rows.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        raw = bytes(r[1])
        if parts[-1] and size + len(raw) > bound:
            parts.append([])
            size = 0
        parts[-1].append((r[0], raw))
        size += len(raw)
    return parts


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = N, doc_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = 16 << 20, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_col, columns in ``keep``, n_words, hit spans ``[start, end)`` in words, items."""
    doc_type = docs.schema[doc_col].dataType.simpleString()
    kept = [c for c in dict.fromkeys((doc_col, *keep)) if c != text_col]
    body = docs.select(*kept, F.col(text_col).cast("binary").alias("__raw"))
    body = body.withColumns({
        "__spans": F.array().cast("array<struct<a:int,b:int>>"), "__items": F.array().cast("array<string>"), "__n": F.lit(0).cast("bigint"),
    })
    schema = body.schema
    parts = _parts(benchmark, item_col, item_text_col, max_broadcast_bytes)
    for part in parts:
        shared = docs.sparkSession.sparkContext.broadcast((part, n))
        body = body.mapInArrow(_scanner(shared), schema)
    del doc_type
    return body.withColumnsRenamed({"__spans": "spans", "__items": "items", "__n": "n_words", "__raw": "raw"})


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("decontamination")
        windows = WindowSet(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            words = [alnum_words(x) for x in batch.column("__raw").to_pylist()]
            found = windows.scan(words)
            before = batch.column("__spans").to_pylist()
            spans = [_merged([(s["a"], s["b"]) for s in old] + new) for old, (new, _) in zip(before, found, strict=True)]
            items = [sorted({*old, *new}) for old, (_, new) in zip(batch.column("__items").to_pylist(), found, strict=True)]
            made = {
                "__spans": pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], batch.schema.field("__spans").type),
                "__items": pa.array(items, batch.schema.field("__items").type),
                "__n": pa.array([len(w) for w in words], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], schema=batch.schema)

    return run


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (``n_hit > 0 and share * n_hit >= n_words``)."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    out = found.withColumn("n_hit", hit)
    return out.withColumns({
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")),
    })


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    out = judged(scan(docs, benchmark, **options))
    return out.select(options.get("doc_col", "doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_spans(raw: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given word ranges; white space around a cut becomes one space."""
    if raw is None:
        return None
    if not spans:
        return raw.decode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]].rstrip())
        last = at[b - 1][1]
    out.append(raw[last:].lstrip())
    return b" ".join(x for x in out if x).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (mode document), or with hit spans cut out of them (mode span).

    All columns of ``docs`` come back in their order, whatever their names.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {c: f"c{i}" for i, c in enumerate(names)}
    options = options | {"doc_col": of[options.get("doc_col", "doc_id")]}
    found = judged(scan(inner, benchmark, text_col=of[text_col], keep=tuple(of.values()), **options))
    if mode == "document":
        found = found.where(~F.col("contaminated"))
        text = F.col("raw").cast("string")
    elif mode == "span":
        cut = F.udf(lambda raw, spans: without_spans(raw and bytes(raw), [(s["a"], s["b"]) for s in spans]), "string")
        text = F.when(F.col("contaminated"), cut("raw", "spans")).otherwise(F.col("raw").cast("string"))
    else:
        raise ValueError("mode is document or span")
    return found.select(*[(text if c == text_col else F.col(of[c])).alias(c) for c in names])
