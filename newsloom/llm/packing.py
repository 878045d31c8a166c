"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents become token ids plus one end id and are cut into full pieces of the sequence length and
a remainder, which is cut once more if it is over half a sequence. Remainders are packed by length
alone: the histogram of remainder lengths (at most
``size`` rows, whatever the corpus) goes to the driver, where a linear program over patterns is
solved by column generation (a knapsack DP prices new patterns), its solution is rounded down, and
what is left over is filled by bounded subset-sum DPs. Patterns then meet documents through ranks:
the r-th piece of a length takes the r-th slot that the patterns hold for that length. Ranks are a
prefix sum of per-task counts plus a counter kept while tokenising, so no task ever gathers a
length, however many pieces have it.

Ids come from the tokenizer file named by the parameter, through ``tokenizers``. Chunks between spaces
are memoised in a bounded table (frequent chunks come early); a text whose runs of white space cross
chunks is encoded whole instead, and so is every text if the file is not plain byte-level BPE.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null
doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import entered, work_dir, written

SIZE = 1024
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: Letters, then marks that are neither letters, numbers nor white space: one piece each of the byte-level pattern.
_WORD = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}]*)")


class _Run(Exception):
    """White space follows a space: a text's chunks cannot be told apart by spaces."""


class Encoder:
    """Token ids of a text, by the tokenizer file itself, as little-endian unsigned 32-bit bytes.

    Where the file splits texts as byte-level BPE without a normalizer does, a word's ids with the space
    before it do not depend on its neighbours: they are kept. There letters alone, and marks alone, are
    single pieces, which go to the file's model at once. Other files, and texts with runs of white space
    or special tokens, are encoded whole.
    """

    def __init__(self, path: str, max_chunks: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_chunk = spec.get("normalizer") is None and spec.get("post_processor") is None and (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["model"].get("dropout"))
        # byte-level BPE spells bytes as printable characters, in this order
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelled = str.maketrans({chr(b): chr(b) if b in printed else chr(256 + b - sum(p < b for p in printed)) for b in range(256)})
        self.max_chunks = max_chunks
        self.chunks: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of what the file's pattern takes as one piece."""
        return np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelled))], dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Of a word and the space before it; a word and the marks behind it are kept apart."""
        if not chunk or chunk[0] in _WHITE:
            raise _Run
        word = _WORD.fullmatch(chunk)
        known = self.chunks
        if word and word[2]:
            marks = self.marks.get(word[2])
            if marks is None:
                marks = self._piece(word[2])
                if len(self.marks) < 10_000:
                    self.marks[word[2]] = marks
            found = (known.get(word[1]) or self._chunk(word[1])) + marks
        else:
            found = self._piece(" " + chunk) if word else self._whole(" " + chunk)
        if len(known) < self.max_chunks:
            known[chunk] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(word in text for word in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        get, chunk = self.chunks.get, self._chunk
        try:
            return (self._whole(first) if first else b"") + b"".join([get(c) or chunk(c) for c in rest])
        except _Run:
            return self._whole(text)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker: what it knows of words serves all the worker's tasks, until another operator's come."""
    return Encoder(path)


def solve(demand: dict[int, int], size: int, tolerance: float = 1e-4, max_columns: int = 2500) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to copies) with their counts that use exactly ``demand`` (length to pieces).

    Column generation: min sum(x) with sum(a x) >= demand, from the patterns of one length; stop when
    the Farley bound proves the plan within ``tolerance`` of the linear optimum.
    """
    lengths = np.array(sorted(n for n, c in demand.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[n] for n in lengths.tolist()], dtype=np.float64)
    m = len(lengths)
    columns = np.diag(size // lengths).astype(np.float64)
    inverse = np.diag(1.0 / (size // lengths))
    x = inverse @ need
    at = np.zeros(size + 1, dtype=np.int64)
    at[lengths] = np.arange(m)
    for _ in range(max_columns):
        price = inverse.sum(axis=0)
        gain = np.full(size + 1, -1.0)
        gain[lengths] = price
        best, pick = _knapsack(gain, size)
        if best <= 1 + 1e-9 or x.sum() * (1 - 1 / best) <= max(0.5, tolerance * x.sum()):
            break
        column = np.zeros(m)
        room = size
        while room and pick[room]:
            if pick[room] > 0:
                column[at[pick[room]]] += 1
                room -= pick[room]
            else:
                room -= 1
        u = inverse @ column
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        x = x - u * ratio[r]
        x[r] = ratio[r]
        columns[:, r] = column
    left = need.astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-x):
        take = columns[:, j].astype(np.int64)
        used = take > 0
        count = min(int(np.floor(x[j] + 1e-7)), int((left[used] // take[used]).min()))
        # a pattern with much room is left to the filling below
        if count > 0 and size - int(take @ lengths) <= max(1, size // 128):
            left -= take * count
            plan.append(({int(n): int(a) for n, a in zip(lengths[used], take[used], strict=True)}, count))
    return plan + _filled({int(n): int(c) for n, c in zip(lengths, left, strict=True) if c}, size)


def _knapsack(gain: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best value of lengths within ``size``; pick[c]: the length last taken, -1 where c is better left open."""
    f = np.zeros(size + 1)
    pick = np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        with_last = f[c - 1 :: -1][:c] + gain[1 : c + 1]
        k = int(np.argmax(with_last))
        if with_last[k] > f[c - 1] and gain[k + 1] >= 0:
            f[c], pick[c] = with_last[k], k + 1
        else:
            f[c], pick[c] = f[c - 1], -1 if f[c - 1] > 0 else 0
    return float(f[size]), pick


def _filled(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Largest piece first, its room filled as far as sums of what is left can reach."""
    plan: list[tuple[dict[int, int], int]] = []
    while left:
        top = max(left)
        pattern = {top: 1}
        left[top] -= 1
        room = size - top
        reach, steps = 1, []
        mask = (1 << (room + 1)) - 1
        for n in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
            before = reach
            k = 1
            c = min(left[n], room // n)
            while c > 0:  # binary splitting of the count
                k = min(k, c)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                c -= k
                k *= 2
            if reach >> room & 1:
                break
            if reach == before:
                continue
        total = reach.bit_length() - 1
        for n, k, before in reversed(steps):
            if not before >> total & 1:
                pattern[n] = pattern.get(n, 0) + k
                total -= n * k
        for n in pattern:
            left[n] -= pattern[n] - (n == top)
        # the same pattern again, as often as the counts allow
        again = min(left[n] // a for n, a in pattern.items())
        for n, a in pattern.items():
            left[n] -= a * again
            if not left[n]:
                del left[n]
        plan.append((pattern, 1 + again))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, copies in a sequence, first sequence, offset in it), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            r = ranks.get(n, 0)
            out.setdefault(n, []).append((r, pattern[n], sequence, offset))
            ranks[n] = r + pattern[n] * count
            offset += n * pattern[n]
        sequence += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def _pieces(path: str, size: int, end_id: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("packing", encoder_of.cache_clear)
        encoder = encoder_of(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            who, start, length, crc, total, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.ids(text) + end
                n = len(raw) // 4
                a = 0
                while a < n:
                    # a remainder over half a sequence is cut there: halves pair up, and what is left is small
                    k = size if n - a >= size else min(size // 2, n - a)
                    who.append(i)
                    start.append(a)
                    length.append(k)
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + k)]))
                    total.append(n)
                    rank.append(int(seen[k]))
                    seen[k] += 1
                    a += k
            column = batch.column(0).take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [column, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(who), pa.int64()), pa.array(rank, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"],
            )

    return run


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                n = int(length[own[0]])
                rows = where[n]
                hit = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                k = rank[own] - hit[:, 0]
                sequence[own] = hit[:, 2] + k // hit[:, 1]
                offset[own] = hit[:, 3] + k % hit[:, 1] * n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema[doc_col].dataType.simpleString()
    rest = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    body = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = work_dir(spark, "packing")
    pieces = written(body.mapInArrow(_pieces(tokenizer_path, size, end_id, None), f"doc_id {kind}, {rest}, part bigint, local bigint"), f"{folder}/pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, f"{folder}/counts")
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    full = demand.pop(size, 0)
    plan = [({size: 1}, full)] * bool(full) + solve(demand, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    shared = spark.sparkContext.broadcast(slots(plan))
    return ranked.mapInArrow(_placed(shared), f"doc_id {kind}, {rest}, sequence_id bigint, offset bigint")
