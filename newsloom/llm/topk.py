"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers. Vectors are dealt into index blocks; a block keeps, per dimension, its
vectors ordered by component value. For one query the vectors whose products reach a given size in a
dimension are the two ends of that order: those ends are its posting segments, one pair a dimension
for each level of quantised impact. Levels are read from the largest impact down. After a level no
unread product is larger than the level's border, so a vector's sum so far, plus that border (or the
dimension's own largest product, if that is less) for each of its unread dimensions, is more than
it can reach. Reading stops for a query when this proves that all but a few vectors cannot be
members, few meaning that exact scoring costs no more than reading on; those are scored exactly.
Without proof everything is read.

The score to beat comes from exact scores: first those of about one index block's vectors, which are
candidates like all others, then those of the vectors that lead after the first levels. Index blocks
are dealt to tasks once, and every query block is sent to each of them; a pair of blocks gives at
most k rows a query, and the k best of all pairs are the answer.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates; a shorter vector counts as ending in zeros, an empty one as zeros alone;
a candidate is every row but those with the query's own id, ties go to the smaller id; rows with a
null id take no part; repeated query ids are answered once (the smallest vector by its components);
an empty table gives no rows. Scores, and the integers that components become, must fit 64 bits;
beyond that an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import work_dir, written

#: Levels of quantised impact that are read one after another: all down to FIRST of the largest, then down by RATIO.
LEVELS, FIRST, RATIO = 14, 0.065, 0.85


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``q``, as 64-bit integers."""
    most = x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    if any(abs(s) >= 1 << 63 for s in exact.ravel().tolist()):
        raise ValueError("a score passes 64 bits: scale the vectors down")
    return exact.astype(np.int64)


class Block:
    """An index block: ids, components, and the vectors in order of each dimension's components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, np.ascontiguousarray(x, dtype=np.int64)
        self.size, self.dims = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T).ravel()
        self.values = np.ascontiguousarray(np.take_along_axis(self.x, order, axis=0).T).ravel().astype(np.float64)
        shape = (self.dims, self.size)
        self.low, self.high = (self.values.reshape(shape)[:, [0, -1]].T if self.size else np.zeros((2, self.dims)))
        self.read = self.scored = 0  # postings read and vectors scored exactly, for all queries so far

    def _ends(self, q: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, border and dimension: how many vectors at the low and at the high end have products of that size."""
        low = np.zeros((*border.shape, self.dims), dtype=np.int64)
        high = low.copy()
        for d in np.flatnonzero(np.maximum(np.abs(self.low), np.abs(self.high))):
            asked = np.flatnonzero(q[:, d])
            own = self.values[d * self.size : (d + 1) * self.size]
            least = border[asked] / np.abs(q[asked, d])[:, None]
            low[asked, :, d] = np.searchsorted(own, -least, side="right")
            high[asked, :, d] = self.size - np.searchsorted(own, least, side="left")
        return low, high

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query: scores and ids of the k best vectors but the query's own that reach its floor, best first."""
        q = queries.astype(np.float64)
        largest = np.abs(q) * np.maximum(np.abs(self.low), np.abs(self.high))[None, :]
        steps = np.append(FIRST * RATIO ** np.arange(LEVELS - 1), 0.0)
        border = np.maximum(largest.max(axis=1, initial=0.0)[:, None] * steps, np.finfo(float).tiny)
        low, high = self._ends(q, border)
        for i in range(len(q)):
            yield self._one(queries[i], q[i], int(own[i]), k, -np.inf if floors is None else float(floors[i]), largest[i], border[i], low[i], high[i])

    def _one(self, query, q, own, k, floor, largest, border, low, high) -> tuple[np.ndarray, np.ndarray]:
        slack = 1e-9 * largest.sum() if largest.sum() >= 2.0**52 else 0.0  # sums of larger numbers are rounded
        unit = 2.0 ** np.ceil(np.log2(4 * largest.sum() + 4))  # sums and numbers of products share a float where both fit
        joint = unit * self.dims < 2.0**52
        both, total, reads = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size)
        unread = int((low[-1] + high[-1]).sum())
        ends = np.arange(1, self.dims + 1) * self.size
        was_low, was_high = ends - self.size, ends
        open_ = np.flatnonzero(self.ids != own)
        led = 0
        for j in range(LEVELS):
            # the two ends of a dimension that this level adds
            to_low, to_high = ends - self.size + low[j], ends - high[j]
            starts, stops = np.concatenate([was_low, to_high]), np.concatenate([to_low, was_high])
            was_low, was_high = to_low, to_high
            some = np.flatnonzero(stops > starts)
            n = int((stops - starts).sum())
            if n:
                spans = list(zip(starts[some].tolist(), stops[some].tolist(), strict=True))
                who = np.concatenate([self.postings[a:b] for a, b in spans])
                product = np.concatenate([self.values[a:b] for a, b in spans]) * np.repeat(q[some % self.dims], stops[some] - starts[some])
                if joint:
                    both += np.bincount(who, product + unit, self.size)
                else:
                    total += np.bincount(who, product, self.size)
                    reads += np.bincount(who, minlength=self.size)
                self.read += n
                unread -= n
            if not unread:
                break
            if joint:
                reads = np.rint(both / unit)
                total = both - reads * unit
            if led < 3 and n:  # the leaders' exact scores raise the score to beat
                led += 1
                lead = open_[np.argpartition(-total[open_], min(2 * k, len(open_) - 1))[: 2 * k]] if len(open_) > 2 * k else open_
                if len(lead) >= k:
                    self.scored += len(lead)
                    floor = max(floor, float(np.partition(products(self.x[lead], query), len(lead) - k)[len(lead) - k]))
            rest = np.minimum(border[j], largest).sum()
            open_ = open_[total[open_] + rest - reads[open_] * border[j] + slack >= floor]
            if len(open_) * self.dims <= unread or len(open_) <= 2 * k:
                break
        self.scored += len(open_)
        exact, ids = products(self.x[open_], query), self.ids[open_]
        best = exact >= floor
        exact, ids = exact[best], ids[best]
        ranked = np.lexsort((ids, -exact))[:k]
        return exact[ranked], ids[ranked]


def _components(vector: str, scale: int):
    """Components as 64-bit integers, and whether the vector takes part."""
    value = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return value, F.coalesce(sound, F.lit(False))


_PACK = "slot int, n int, dims int, width int, ids binary, x binary"


def _packed(ids: np.ndarray, rows: list[np.ndarray]) -> list:
    """One row of a table of blocks: vectors in order of id, in the fewest bytes a component."""
    dims = max(map(len, rows), default=0)
    x = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    order = np.argsort(ids, kind="stable")
    width = next(w for w in (1, 2, 4, 8) if w == 8 or (x.min(initial=0) >= -(1 << 8 * w - 1) and x.max(initial=0) < 1 << 8 * w - 1))
    return [len(ids), dims, width, ids[order].astype("<i8").tobytes(), x[order].astype(f"<i{width}").tobytes()]


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(row["n"], row["dims"])
    return np.frombuffer(row["ids"], "<i8"), x.astype(np.int64)


def _pack_rows(size: int):
    """Rows of (id, components) to rows of up to ``size`` vectors, with this task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cells = [slot, *_packed(np.array(ids, dtype=np.int64), rows)]
            kinds = [pa.int32()] * 4 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["slot", "n", "dims", "width", "ids", "x"])

        for batch in batches:
            names, lists = batch.column("id").to_pylist(), batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, v in zip(names, np.split(flat, ends[:-1]) if len(ends) else [], strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield out()
                    ids.clear()
                    rows.clear()
        if ids:
            yield out()

    return run


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _floors(shared, k: int):
    """Adds to each block of queries the k-th best exact score among the vectors of one index block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        for batch in batches:
            floors = []
            for row in batch.to_pylist():
                own, q = _unpacked(row)
                dims = max(q.shape[1], vectors.shape[1])
                found = np.full(len(own), -np.inf)
                if len(names) > k:
                    scores = products(_wide(vectors, dims), _wide(q, dims).T).astype(np.float64)
                    scores[names[:, None] == own[None, :]] = -np.inf
                    found = np.nextafter(np.partition(scores, len(names) - k, axis=0)[len(names) - k], -np.inf)
                floors.append(found.astype("<f8").tobytes())
            yield batch.append_column("floor", pa.array(floors, pa.binary()))

    return run


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own, q = _unpacked({c: row[f"q_{c}"] for c in ("n", "dims", "width", "ids", "x")})
                dims = max(row["dims"], row["q_dims"])
                if last != (row["ids"], row["x"], dims):
                    last = (row["ids"], row["x"], dims)
                    names, x = _unpacked(row)
                    block = Block(names, _wide(x, dims))
                q = _wide(q, dims)
                answers = list(block.top(q, own, k, np.frombuffer(row["q_floor"], "<f8")))
                who = np.repeat(own, [len(s) for s, _ in answers])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who), pa.array(np.concatenate([i for _, i in answers])), pa.array(np.concatenate([s for s, _ in answers]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = 4096, query_block: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "topk")
    value, sound = _components(vector_col, scale)
    ints = vectors.where(sound & F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), value.alias("v"))
    asked = ints.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-ints.count() // block))
    index = written(ints.repartition(parts, "id").mapInArrow(_pack_rows(block), _PACK), f"{folder}/index")
    slots = 1 + (index.agg(F.max("slot")).first()[0] or 0)
    # blocks of any vectors, up to about the size of one, give a first score to beat; their vectors are candidates like all
    ahead = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    some = [_unpacked(r.asDict()) for r in index.orderBy("slot", "ids").limit(max(1, block * ahead[0] // max(1, ahead[1] or 0))).collect()]
    dims = max([x.shape[1] for _, x in some], default=0)
    names = np.concatenate([n for n, _ in some]) if some else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((names, np.concatenate([_wide(x, dims) for _, x in some]) if some else np.zeros((0, 0), np.int64)))
    asked = asked.mapInArrow(_pack_rows(query_block), _PACK).mapInArrow(_floors(shared, k), f"{_PACK}, floor binary")
    asked = written(asked, f"{folder}/asked")
    # a block of queries goes to every index block; an index block to one task, once
    dealt = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "width", "ids", "x", "floor")], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = index.repartition(slots, "slot").join(dealt.repartition(slots, "slot").hint("merge"), "slot")
    found = pairs.mapInArrow(_answers(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
