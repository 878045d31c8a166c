"""Exact Jaccard self-join of documents on word shingles, with set relations used to skip work.

Sets: 64-bit fingerprints of distinct shingles. Texts with equal sets form a class; one class id
(64 bits of a digest of the set) stands for all its copies, so copies cost one row each and no pair.

Candidates: prefix filter. Shingles are ordered by grade, then fingerprint; the grade ranks a count in
a fixed-size sketch over all documents, so shared passages come last in every set and stay out of
prefixes. Any grade gives the same links; a coarse one only costs more candidates.
Posting lists are read in order of (shingle, set size) as a stream. Blocks of a list are size classes
a factor 5/4 apart: a set meets only its own and the neighbouring block, all others are skipped by
position. Each pair of neighbouring blocks is led by its first set, and what leaves the list is one
row per member, (leader, member): no pair of members is written.

Verification: sets that candidates connect are brought together with their texts, and linked there; if
they are too many for one task, each leader's members are. A set is
compared with all members only if its answers cannot be derived: from the computed overlaps of a
highly similar set, bounds on the overlap with each other member follow, and members that are bounded
away or already connected are skipped. Members above a bound of shingles are cut in blocks that all
hold the leader; blocks are linked by themselves, and then only members not linked to the leader are
compared with the other blocks.

Links become components by minimum labels with pointer jumping over written tables; nothing about
links or documents is collected.

Defined results: null and empty texts have the empty set, link with nothing and are their own
component; repeated rows are copies of each other; rows with a null id take part, and a component
takes the least id that is not null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from newsloom.llm.common import entered, space_words, work_dir, written

WORDS = 5
#: log2 of the bits of the bitmap that keeps texts without candidates out of a shuffle.
ASKED_BITS = 25
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles; a shorter text is one shingle, none without words."""
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in space_words(raw)], dtype=np.uint64)
    k = min(words, len(w))
    if not k:
        return w
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _B + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h))


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, share: tuple[int, int]) -> int:
    a, b = share
    return n - (a * n + b - 1) // b + 1


def _sets(bits: int, words: int, chunk: int = 1 << 16):
    """Rows of documents (kind 0: id, digest, size, class) and of this task's sketch (kind 1: chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("ngram_join")
        cells = np.zeros(1 << bits, dtype=np.uint16)  # more than 65535 counts as that
        mask = np.uint64((1 << bits) - 1)
        names = ["kind", "doc_id", "digest", "n", "sid", "chunk", "cells"]

        def rows(kind, ids, digests, n, sid, at, found):
            m = len(n)
            return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), ids, digests, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(at, pa.int32()), pa.array(found, pa.binary())], names=names)

        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                sets = [shingle_set(x, words) for x in batch.column(2).to_pylist()]
                at, many = np.unique(np.concatenate(sets) & mask, return_counts=True)
                cells[at] = np.minimum(cells[at] + many, 65535)
                n = [len(s) for s in sets]
                yield rows(0, batch.column(0), batch.column(1), n, [class_id(s) if len(s) else None for s in sets], [None] * len(n), [None] * len(n))
        if id_type is not None and cells.any():
            for i in range(0, len(cells), chunk):
                part = cells[i : i + chunk].astype("<u2", copy=False)
                if part.any():
                    yield rows(1, pa.nulls(1, id_type), pa.nulls(1, pa.int64()), [None], [None], [i // chunk], [zlib.compress(part.tobytes(), 1)])

    return run


def grades(counts: np.ndarray, load: float) -> np.ndarray:
    """Counts as ranks in a byte: fine around the mean load of a counter, where rare shingles are told from
    shared ones, by logarithm far above it."""
    step = max(1.0, np.sqrt(load) / 4)
    fine = np.clip((counts - load + 4 * np.sqrt(load)) / step, 0, 160)
    far = np.log2(np.maximum(counts / (load + 40 * step), 1))
    return np.minimum(fine + 8 * far, 255).astype(np.uint8)


def _grades(load: float):
    """Sum of a chunk's counts over tasks, as grades."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), "<u2").astype(np.int64) for x in group.column("cells").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "grade": pa.array([zlib.compress(grades(total, load).tobytes(), 1)], pa.binary())})

    return run


def _postings(shared, words: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("ngram_join")
        bits, packed = shared.value
        grade = np.frombuffer(zlib.decompress(packed), np.uint8)
        mask = np.uint64((1 << bits) - 1)
        seen: set[int] = set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for raw in batch.column(0).to_pylist():
                s = shingle_set(raw, words)
                if not len(s):
                    continue
                sid = class_id(s)
                if sid in seen:  # a copy of a text of this task
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                g = grade[s & mask]
                if g.any():
                    s = s[np.argsort(g, kind="stable")]
                p = s[: prefix_length(len(s), share)]
                tokens.append(p)
                sids.append(np.full(len(p), sid))
                sizes.append(np.full(len(p), len(s)))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes).astype(np.int32))],
                    names=["token", "sid", "n"],
                )

    return run


def _led(share: tuple[int, int]):
    """Sorted postings to (leader, its size, member, its size); reads lists of any length as a stream."""
    a, b = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        step = np.log(b / a)
        for batch in batches:
            token, sid, n = (batch.column(c).to_numpy() for c in ("token", "sid", "n"))
            if held is not None:
                token, sid, n = (np.concatenate([h, x]) for h, x in zip(held, (token, sid, n), strict=True))
            if not len(token):
                continue
            size_class = np.floor(np.log(n) / step + 1e-9).astype(np.int64)
            new_list = np.diff(token, prepend=token[0] - 1) != 0
            start = np.flatnonzero(new_list | (np.diff(size_class, prepend=-1) != 0))
            segment = np.searchsorted(start, np.arange(len(token)), "right") - 1
            own = start[segment]
            before = start[np.maximum(segment - 1, 0)]
            # sizes within the factor are in the same or in neighbouring classes
            near = (segment > 0) & (token[before] == token[own]) & (size_class[own] - size_class[before] <= 1)
            at = np.arange(len(token))
            pairs = [(own, at), (before[near], at[near])]
            lead = np.concatenate([p[0] for p in pairs])
            member = np.concatenate([p[1] for p in pairs])
            other = sid[lead] != sid[member]
            lead, member = lead[other], member[other]
            if len(lead):
                key = np.unique(np.stack([sid[lead], sid[member]], axis=1), axis=0, return_index=True)[1]
                lead, member = lead[key], member[key]
                yield pa.RecordBatch.from_arrays([pa.array(sid[lead]), pa.array(n[lead]), pa.array(sid[member]), pa.array(n[member])], names=["leader", "leader_n", "sid", "n"])
            # the first set of the last two blocks of the last list go on as leaders
            last = segment[-1]
            keep = [start[last]]
            if last > 0 and token[start[last - 1]] == token[-1]:
                keep.insert(0, start[last - 1])
            held = tuple(x[keep] for x in (token, sid, n))

    return run


class Linker:
    """Links among the sets of one group, in order of size."""

    def __init__(self, sets: list[np.ndarray], share: tuple[int, int]):
        self.share = share
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = ids.ravel()
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(int(self.ids.max()) + 1, dtype=bool)
        self.label = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []
        self.computed = 0

    def least(self, i: int, j: np.ndarray) -> np.ndarray:
        """The least overlap that links: |x & y| >= share * |x | y|."""
        a, b = self.share
        return -(-a * (self.n[i] + self.n[j]) // (a + b))

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        sizes = self.n[others]
        ends = np.cumsum(sizes)
        flat = np.repeat(self.at[others] - ends + sizes, sizes) + np.arange(ends[-1])
        out = np.add.reduceat(self.mark[self.ids[flat]].astype(np.int64), ends - sizes)
        self.mark[own] = False
        self.computed += len(others)
        return out

    def join(self, i: int, j: int) -> None:
        if self.label[i] != self.label[j]:
            self.edges.append((i, j))
            self.label[self.label == self.label[j]] = self.label[i]

    def run(self, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges of a spanning forest of all links; with ``cross``, only links between True and False."""
        a, b = self.share
        pivots: list[tuple[int, np.ndarray]] = []
        m = len(self.n)
        for i in range(m - 1):
            end = int(np.searchsorted(a * self.n, b * self.n[i], "right"))
            open_ = np.arange(i + 1, end)
            open_ = open_[self.label[open_] != self.label[i]]
            if cross is not None:
                open_ = open_[cross[open_] != cross[i]]
            if not len(open_):
                continue
            need = self.least(i, open_)
            for p, known in pivots:  # what a computed set says about this one
                if known[i] < 0:
                    continue
                have = known[open_]
                told = have >= 0
                sure = told & (have - (self.n[p] - known[i]) >= need)
                for j in open_[sure]:
                    self.join(i, int(j))
                left = ~(told & (have + (self.n[i] - known[i]) < need)) & (self.label[open_] != self.label[i])
                open_, need = open_[left], need[left]
                if not len(open_):
                    break
            if not len(open_):
                continue
            found = self.overlaps(i, open_)
            for j in open_[found >= need]:
                self.join(i, int(j))
            known = np.full(m, -1, dtype=np.int64)
            known[open_] = found
            known[i] = self.n[i]
            pivots = [(i, known), *pivots[:7]]
        return self.edges


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys of a sorted stream, each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[x] for c in columns)
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield pa.concat_batches(held)


def _bitmap(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[group.column("at").to_numpy()] = 1
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _in_bitmap(shared):
    def found(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return found


def _linked(words: int, share: tuple[int, int], cross: bool):
    """Sorted (leader, block, n, sid, raw, extra) to edges (kind 0) and, of cut groups, members not linked to the leader (kind 1)."""
    names = ["kind", "a", "b", "n", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, int]] = []

        def flush():
            found = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(found, names=names)

        for group in _groups(batches, ("leader", "block", "part")):
            sid = group.column("sid").to_numpy()
            if sid.min() == sid.max():
                continue
            extra = group.column("extra").to_numpy(zero_copy_only=False).astype(bool)
            if cross and (extra.all() or not extra.any()):
                continue
            # a class is in a group once, and once more on the other side; of several texts under its id, its own counts
            every = [shingle_set(x, words) for x in group.column("raw").to_pylist()]
            first: dict[tuple[int, bool], int] = {}
            for i, s in enumerate(every):
                if len(s) and class_id(s) == sid[i]:
                    first.setdefault((int(sid[i]), bool(extra[i])), i)
            keep = sorted(first.values())
            sid, extra, sets = sid[keep], extra[keep], [every[i] for i in keep]
            if len(sets) < 2:
                continue
            linker = Linker(sets, share)
            out += [(0, int(sid[i]), int(sid[j]), 0, 0) for i, j in linker.run(extra if cross else None)]
            blocks = int(group.column("blocks")[0].as_py())
            if blocks > 1 and not cross:
                leader = group.column("leader")[0].as_py()
                top = np.flatnonzero(sid == leader)
                with_leader = linker.label == (linker.label[top[0]] if len(top) else -1)
                out += [(1, leader, int(sid[i]), len(sets[i]), blocks) for i in np.flatnonzero(~with_leader)]
            if len(out) > 50_000:
                yield flush()
        if out:
            yield flush()

    return run


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b): the least vertex that it reaches."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{folder}/both")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "v"), f"{folder}/labels0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.withColumnsRenamed({"v": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        lower = labels.join(seen.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "l").alias("l"))
        # pointer jump: the label of the label
        jumped = lower.join(labels.withColumnsRenamed({"v": "l", "label": "far"}), "l", "left")
        new = jumped.select("v", F.least("l", F.coalesce("far", "l")).alias("label"), (F.least("l", F.coalesce("far", "l")) != F.col("label")).cast("int").alias("moved"))
        new = written(new, f"{folder}/labels{step}")
        if not new.where("moved = 1").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")


def join(
    docs: DataFrame, share: tuple[int, int] = (4, 5), words: int = WORDS, doc_col: str = "doc_id", text_col: str = "text",
    sketch_bits: int = 24, block_shingles: int = 1_500_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id (and sid, the class of equal sets; label, the component, null without
    words; digest, a hash of the text) of each document row.

    ``share``: two sets link when |x & y| >= share * |x | y|, a fraction. ``sketch_bits``: the sketch has
    2**bits counters, whatever the corpus; more bits tell frequent shingles apart in larger corpora.
    ``block_shingles``: shingles of a leader's members that one task holds.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "ngram-join")
    kind = docs.schema[doc_col].dataType.simpleString()
    body = docs.select(F.col(doc_col).alias("doc_id"), _digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("raw"))
    first = written(body.mapInArrow(_sets(sketch_bits, words), f"kind int, doc_id {kind}, digest bigint, n bigint, sid bigint, chunk int, cells binary"), f"{folder}/sets")
    rows = first.where("kind = 0").select("doc_id", "digest", "n", "sid")
    total = rows.agg(F.sum("n")).first()[0] or 0
    # a fixed number of chunks, whatever the corpus
    graded = first.where("kind = 1").select("chunk", "cells").groupBy("chunk").applyInArrow(_grades(total / (1 << sketch_bits)), "chunk int, grade binary")
    grade = np.zeros(1 << sketch_bits, dtype=np.uint8)
    for r in graded.collect():
        part = np.frombuffer(zlib.decompress(bytes(r["grade"])), np.uint8)
        grade[r["chunk"] << 16 : (r["chunk"] << 16) + len(part)] = part
    shared = spark.sparkContext.broadcast((sketch_bits, zlib.compress(grade.tobytes(), 1)))

    postings = body.select("raw").mapInArrow(_postings(shared, words, share), "token bigint, sid bigint, n int")
    lists = postings.repartition("token").sortWithinPartitions("token", "n", "sid")
    led = lists.mapInArrow(_led(share), "leader bigint, leader_n int, sid bigint, n int")
    led = written(led.distinct(), f"{folder}/led")
    # a candidate component that one task can hold is one group, so that each text travels once
    whole = components(led.select(F.col("leader").alias("a"), F.col("sid").alias("b")), f"{folder}/candidates").withColumnRenamed("v", "sid")
    each = led.select("sid", "n").union(led.select("leader", "leader_n")).distinct().join(whole, "sid")
    size = written(each.groupBy("label").agg(F.sum("n").alias("held")), f"{folder}/candidate_sizes")
    small = each.join(size.where(F.col("held") <= block_shingles), "label").select(F.col("label").alias("leader"), "sid", "n")
    # larger ones keep a group for each leader
    large = whole.join(size.where(F.col("held") > block_shingles), "label").select(F.col("sid").alias("leader"))
    rest = led.join(large, "leader", "left_semi")
    rest = rest.select("leader", "sid", "n").union(rest.select("leader", F.col("leader").alias("sid"), F.col("leader_n").alias("n")).distinct())
    members = written(small.union(rest), f"{folder}/members")
    sizes = members.groupBy("leader").agg(F.sum("n").alias("shingles"))
    blocks = F.ceil(F.col("shingles") / block_shingles).cast("int")
    cut = members.join(sizes, "leader").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    cut = cut.select("leader", F.explode(everywhere).alias("block"), "blocks", "sid", "n")

    # one document of each class that has a candidate lends its text
    lenders = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id")).alias("lender")).select("sid", "lender.doc_id")
    asked = written(members.select("sid").distinct().join(lenders, "sid"), f"{folder}/asked")
    # only texts that a bitmap of the asked ids lets through are shuffled; the join decides
    some = _perhaps(body.select("doc_id", "raw"), asked.select("doc_id")).withColumnRenamed("doc_id", "lent")

    def gathered(wanted: DataFrame) -> DataFrame:
        """Texts go to their groups at once: one shuffle by id, one by group. What is wanted grows with the corpus: no broadcast."""
        who = wanted.join(asked, "sid").hint("merge")
        full = who.join(some, who["doc_id"].eqNullSafe(some["lent"])).select("leader", "block", "part", "blocks", "n", "sid", "extra", "raw")
        return full.repartition("leader", "block", "part").sortWithinPartitions("leader", "block", "part", "n", "sid")

    out_schema = "kind bigint, a bigint, b bigint, n bigint, blocks bigint"
    wanted = cut.select("leader", "block", F.lit(0).alias("part"), "blocks", "n", "sid", F.lit(False).alias("extra"))
    found = written(gathered(wanted).mapInArrow(_linked(words, share, False), out_schema), f"{folder}/links")
    edges = found.where("kind = 0").select("a", "b")
    loose = found.where("kind = 1").select(F.col("a").alias("leader"), F.col("b").alias("sid"), "n", "blocks").distinct()
    if loose.limit(1).count():
        # members not linked to the leader meet every block, in parts of a bounded size
        parts = F.ceil(F.col("more") / block_shingles).cast("int")
        loose = loose.join(loose.groupBy("leader").agg(F.sum("n").alias("more")), "leader").withColumn("parts", parts)
        loose = loose.withColumn("part", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int"))
        counts = loose.select("leader", "parts").distinct()
        left = loose.select("leader", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "part", F.col("blocks").cast("int").alias("blocks"), F.col("n").cast("int").alias("n"), "sid", F.lit(True).alias("extra"))
        right = cut.join(counts, "leader").select("leader", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "blocks", "n", "sid", F.lit(False).alias("extra"))
        more = gathered(left.union(right)).mapInArrow(_linked(words, share, True), out_schema)
        edges = edges.union(written(more, f"{folder}/more").where("kind = 0").select("a", "b"))
    labels = components(edges.distinct(), folder).withColumnRenamed("v", "sid")
    # classes before rows, and the least ids written: a join of a large component's rows can then be split
    firsts = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first")).join(labels, "sid", "left")
    least = firsts.groupBy(F.coalesce("label", "sid").alias("label")).agg(F.min("first").alias("least"))
    least = written(least, f"{folder}/least")
    placed = rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    out = placed.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "sid", "label", "digest")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("binary"))


def _perhaps(rows: DataFrame, keys: DataFrame, apart: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows that a bitmap of ``keys`` lets through: all that hold one and some others; ``apart``: also the rest.

    ``keys`` has the columns to compare, which ``rows`` has too. The bitmap's size is fixed; it only saves work.
    """
    spark = rows.sparkSession
    place = F.xxhash64(*keys.columns).bitwiseAND(F.lit((1 << ASKED_BITS) - 1))
    cells = keys.select(F.shiftright(place, 16).cast("int").alias("chunk"), place.bitwiseAND(F.lit(65535)).cast("int").alias("at")).distinct()
    bitmap = np.zeros(1 << ASKED_BITS - 3, dtype=np.uint8)
    for r in cells.groupBy("chunk").applyInArrow(_bitmap, "chunk int, bits binary").collect():  # at most 2**(ASKED_BITS - 16) chunks
        bitmap[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = np.frombuffer(bytes(r["bits"]), np.uint8)
    inside = F.pandas_udf(_in_bitmap(spark.sparkContext.broadcast(bitmap)), BooleanType())(place)
    return (rows.where(inside), rows.where(~inside)) if apart else rows.where(inside)


def kept(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: one with the component's least id; its columns stay as they are.

    Of a component's rows that share that id, the text with the least digest stays, and of rows that agree in
    both, one. A null id comes after all others. Rows without words are components of their own: all stay.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = f"c{names.index(doc_col)}", f"c{names.index(text_col)}"
    folder = work_dir(docs.sparkSession, "kept")
    marks = join(inner, doc_col=id_, text_col=text, **options).where("label is not null")
    marks = written(marks.groupBy("label", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), f"{folder}/marks")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = marks.groupBy("label").agg(F.min(rank).alias("best")).select("label", "best.doc_id", "best.digest").withColumn("best", F.lit(True))
    of = marks.alias("m").join(best.alias("b"), (F.col("m.label") == F.col("b.label")) & F.col("m.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("m.digest") == F.col("b.digest")), "left")
    # rows that go, and rows that stay once of several: few, so that other texts are not shuffled
    some = of.where(F.col("b.best").isNull() | (F.col("m.n") > 1)).select(F.col("m.doc_id").alias(id_), F.col("m.digest").alias("digest"), F.col("b.best").isNotNull().alias("one"))
    some = written(some, f"{folder}/some")
    keyed = inner.withColumn("digest", _digest(text))
    asked, sure = _perhaps(keyed, some.select(id_, "digest"), apart=True)

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left[id_].eqNullSafe(right[id_]) & (left["digest"] == right["digest"])

    free = asked.join(some, same(asked, some), "left_anti")
    repeated = some.where("one")
    one = asked.join(repeated, same(asked, repeated), "left_semi").groupBy(F.col(id_).alias("key"), F.col("digest").alias("text")).agg(F.min_by(F.struct(*inner.columns), F.xxhash64(*inner.columns)).alias("row")).select("row.*")
    return sure.select(*inner.columns).union(free.select(*inner.columns)).union(one).toDF(*names)


def report(docs: DataFrame, **options) -> DataFrame:
    return join(docs, **options).drop("sid", "label", "digest")

