"""Toxicity: Levenshtein automata over a lexicon trie, with context windows around the hits.

The lexicon is a short written list plus words and stems whose share among toxic documents of the
labelled sample is far above chance. Terms form a trie; the Levenshtein automaton of all terms is
run on it by lazy subset construction: a state is a set of (trie node, edits), and each word walks
it once, dying after a few letters if nothing is near. Longer terms allow more edits, stems none.
Fuzzy surfaces that clean sample documents use are taken out.

Words are split at typographic marks too, and zero-width characters are left out of them. Each hit is
read in its context: a pair of quotation marks of one kind around it, within the line, or a word of
reporting in the window before it, make it a quotation, else it is abuse. Counts of exact, fuzzy and quoted hits, their
density and their variety go into a logistic model fitted on the sample.

Near copies in the sample would make any word of theirs look telling, so one document for each of
three min-hashes is used. Defined results: null and empty texts have no hit and score as any text
without; repeated rows are scored each; a null id counts as the empty text for the split; without
labels the written list decides with prior weights; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import alnum_words, crc_mod, entered, work_dir, written
from newsloom.llm.training import labelled_sample, logistic

#: Insults known beforehand.
LEXICON = (
    "bastard", "bigot", "clown", "creep", "dimwit", "disgusting", "dumbass", "filthy", "freak", "garbage", "halfwit", "idiot", "imbecile",
    "jerk", "liar", "loser", "lowlife", "moron", "nitwit", "parasite", "pathetic", "pervert", "retard", "scum", "scumbag", "stupid", "trash",
    "vermin", "weirdo", "worthless", "wretch",
)
#: Words that report speech.
REPORTS = frozenset("said says say wrote writes quoted quote quotes called calls cited reported according dijo escribió llamó dit écrit appelé sagte schrieb nannte zitat".split())
#: Quotations by their kind of marks, none across lines.
_QUOTATION = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|‹[^›\n]*›|「[^」\n]*」')
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters over 0x7F that end a word: punctuation, symbols, spaces, controls; and those of no width.
_MARKS = regex.compile(r"[^\P{P}\x00-\x7F]|[^\P{S}\x00-\x7F]|[^\P{Z}\x00-\x7F]|[\x80-\x9F]")
_NO_WIDTH = regex.compile(r"\p{Cf}")
WINDOW = 3
FEATURES = 7


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """All words within the edits of some term, or starting with a stem; states are built when first met."""

    def __init__(self, words: list[str] | dict[str, int], stems: list[str] = ()):
        self.edits = words if isinstance(words, dict) else {w: edits_for(w) for w in words}
        self.next: list[dict[str, int]] = [{}]
        self.most: list[int] = [-1]  # edits allowed to any term below the node
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for term, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node, k = 0, 0 if stem else self.edits[term]
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(-1)
                    self.word.append(None)
                    self.stem.append(None)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            if stem:
                self.stem[node] = term
            else:
                self.word[node] = term
        self.states: list[frozenset[tuple[int, int]]] = []
        self.ids: dict[frozenset[tuple[int, int]], int] = {}
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[int, str] | None] = []
        self.stems: list[str | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Adds letters of terms that the word leaves out; keeps the fewest edits for each node."""
        best: dict[int, int] = {}
        todo = sorted(pairs, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset[tuple[int, int]]) -> int:
        if pairs in self.ids:
            return self.ids[pairs]
        self.ids[pairs] = len(self.states)
        self.states.append(pairs)
        self.steps.append({})
        ends = [(e, self.word[n]) for n, e in pairs if self.word[n] and e <= self.edits[self.word[n]]]
        self.accept.append(min(ends, default=None))
        self.stems.append(min((self.stem[n] for n, e in pairs if self.stem[n] and not e), default=None))
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            for letter, child in self.next[node].items():
                after.add((child, e + (letter != c)))
            after.add((node, e + 1))
        found = self._closed(after)
        to = self._state(found) if found else -1
        if len(self.states) < 200_000:
            self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term or stem; ties go to the first by name."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
            if self.stems[state]:
                return self.stems[state], 0
        end = self.accept[state]
        return (end[1], end[0]) if end else None


def parts_of(word: str) -> list[tuple[int, str]]:
    """(place, lower-case part) of each part of a word between typographic marks."""
    if word.isascii():
        return [(0, word.lower())]
    out, at = [], 0
    for piece in _MARKS.split(word):
        if part := _NO_WIDTH.sub("", piece).lower():
            out.append((at, part))
        at += len(piece) + 1
    return out


class Scanner(dict):
    """Words (bytes) to their hit (term, edits, place in the word), or None; remembers up to ``most`` words."""

    def __init__(self, automaton: Automaton, stop: frozenset[str] = frozenset(), most: int = 400_000):
        super().__init__()
        self.automaton, self.stop, self.most = automaton, stop, most

    def __missing__(self, raw: bytes) -> tuple[str, int, int] | None:
        best = None
        for at, part in parts_of(raw.decode("utf-8", "replace")):
            hit = self.automaton.match(part)
            if hit and not (hit[1] and part in self.stop) and (best is None or hit[1] < best[1]):
                best = (*hit, at)
        if len(self) < self.most:
            self[raw] = best
        return best

    def features(self, raw: bytes | None) -> np.ndarray:
        words = alnum_words(raw)
        hits = [(i, h) for i, h in enumerate([self[w] for w in words]) if h]
        out = np.zeros(FEATURES)
        if not hits:
            return out
        quoted = _quoted(raw.decode("utf-8", "replace"), [(i, h[2]) for i, h in hits])
        exact = sum(not q and not h[1] for (_, h), q in zip(hits, quoted, strict=True))
        fuzzy = sum(not q and h[1] > 0 for (_, h), q in zip(hits, quoted, strict=True))
        out[:] = (
            exact > 0, np.log1p(exact), fuzzy > 0, np.log1p(fuzzy), np.log1p(sum(quoted)) / 2,
            min(1.0, 20 * (exact + fuzzy) / len(words)), np.log1p(len({h[0] for _, h in hits})),
        )
        return out


def _quoted(text: str, hits: list[tuple[int, int]]) -> list[bool]:
    """For each hit (number of the word, place in it): is it inside a quotation, or reported just before?"""
    spans = [m.span() for m in _WORD.finditer(text)]
    quotations = [m.span() for m in _QUOTATION.finditer(text)]
    ends = [b for _, b in quotations]
    out = []
    for i, place in hits:
        if i >= len(spans):  # bytes that are no UTF-8
            out.append(False)
            continue
        at = spans[i][0] + place
        k = bisect_right(ends, at)
        inside = k < len(quotations) and quotations[k][0] <= at
        before = _MARKS.sub(" ", " ".join(text[a:b] for a, b in spans[max(0, i - WINDOW) : i])).lower().split()[-WINDOW:]
        out.append(inside or any(w in REPORTS for w in before))
    return out


# --- learning ----------------------------------------------------------------------------------


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least hashes of word triples of each sample document."""
    entered("toxicity")
    salts = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
    for batch in batches:
        rows = []
        for raw in batch.column("raw").to_pylist():
            w = np.array([xxhash.xxh3_64_intdigest(x) for x in alnum_words(raw)] or [0], dtype=np.uint64)
            t = w if len(w) < 3 else (w[:-2] * np.uint64(31) + w[1:-1]) * np.uint64(31) + w[2:]
            rows.append([int(((t ^ s) * np.uint64(0xFF51AFD7ED558CCD)).min() >> np.uint64(1)) for s in salts])
        h = np.array(rows, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(h[:, i]) for i in range(3))], names=["doc_id", "y", "h0", "h1", "h2"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, pos, neg): documents of this task with each word, and with each start of a word."""
    entered("toxicity")
    counts: dict[tuple[bool, str], list[int]] = {}
    for batch in batches:
        for raw, y in zip(batch.column("raw").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = {part for w in set(alnum_words(raw)) for _, part in parts_of(w.decode("utf-8", "replace"))}
            seen = {(False, w) for w in words if len(w) >= 3}
            seen |= {(True, w[:k]) for w in words for k in range(4, 11) if len(w) > k}
            for t in seen:
                counts.setdefault(t, [0, 0])[y] += 1
        if len(counts) > 500_000:
            yield _term_rows(counts)
            counts = {}
    if counts:
        yield _term_rows(counts)


def _term_rows(counts: dict[tuple[bool, str], list[int]]) -> pa.RecordBatch:
    keys, n = list(counts), list(counts.values())
    return pa.RecordBatch.from_arrays(
        [pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys]), pa.array([x[1] for x in n], pa.int64()), pa.array([x[0] for x in n], pa.int64())],
        names=["term", "stem", "pos", "neg"],
    )


def _least_gain(tallies: list[tuple[int, int]], share: float, alpha: float = 0.05) -> float:
    """The gain that chance reaches in ``alpha`` of all samples, over the terms that could reach it at all."""
    reach = sorted(((total * -np.log(share), n) for total, n in tallies), reverse=True)
    able = 0
    for most, n in reach:
        if able and np.log(able / alpha) > most:
            break
        able += n
    return float(np.log(max(able, 1) / alpha))


def _chosen(telling: list[tuple[str, bool, int]]) -> tuple[list[str], list[str]]:
    """Words and stems from (term, stem, documents), the most telling first.

    A stem is taken where it says more than the words that start with it: not after a word with most of
    its documents; what starts with a stem is not taken again.
    """
    words: dict[str, int] = {}
    stems: list[str] = []
    for term, stem, n in telling:
        if any(term.startswith(s) for s in stems) or (stem and any(s.startswith(term) for s in stems)):
            continue
        if stem:
            if all(m < 0.75 * n for w, m in words.items() if w.startswith(term)):
                stems.append(term)
        else:
            words[term] = n
    return [w for w in words if not any(w.startswith(s) for s in stems)], stems


def _surfaces(words: dict[str, int], stems: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words, stems)
        for batch in batches:
            hit = [automaton.match(t) for t in batch.column("term").to_pylist()]
            near = pa.array([bool(h and h[1]) for h in hit], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("term").filter(near), pa.array([h[0] for h in hit if h and h[1]], pa.string())], names=["term", "near"])

    return run


def _feature_rows(shared, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, stop, *_ = shared.value
        scanner = Scanner(Automaton(words, stems), stop)
        for batch in batches:
            x = [scanner.features(raw).tolist() for raw in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("toxicity")
        words, stems, stop, weights, bias = shared.value
        scanner = Scanner(Automaton(words, stems), stop)
        for batch in batches:
            x = np.array([scanner.features(raw) for raw in batch.column("raw").to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: tuple[int, int], doc_col: str, text_col: str, max_terms: int):
    """(words, stems, stopped surfaces, weights, bias)."""
    folder = work_dir(docs.sparkSession, "toxicity")
    sample, weight = labelled_sample(docs, labels, "toxic", folds, held, per_class, folder, doc_col, text_col)
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("text").cast("binary").alias("raw"), "y")
    seen: set[tuple[int, int]] = set()
    once, sizes = [], Counter()
    # at most the rows of the sample, whose number is a parameter
    for r in rows.mapInArrow(_min_hashes, f"doc_id {kind}, y int, h0 bigint, h1 bigint, h2 bigint").orderBy("doc_id", "h0").collect():
        keys = {(i, r[f"h{i}"]) for i in range(3)}
        if not keys & seen:
            once.append((r["doc_id"],))
            sizes[r["y"]] += 1
        seen |= keys
    words, stems, stop = {w: edits_for(w) for w in LEXICON}, [], frozenset()
    if sizes[0] and sizes[1]:
        names = docs.sparkSession.createDataFrame(once, f"once {kind}")
        distinct = rows.join(F.broadcast(names), F.col("doc_id") == F.col("once"), "left_semi")
        terms = distinct.mapInArrow(_terms, "term string, stem boolean, pos bigint, neg bigint")
        terms = written(terms.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), f"{folder}/terms")
        # log-likelihood ratio against the sample's share, above the number of candidates
        share = sizes[1] / (sizes[0] + sizes[1])
        total = F.col("pos") + F.col("neg")
        gain = F.col("pos") * F.log(F.col("pos") / (total * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (total * (1 - share)))).otherwise(0.0)
        odds = ((F.col("pos") + 0.5) / (sizes[1] + 1)) / ((F.col("neg") + 0.5) / (sizes[0] + 1))
        tallies = terms.groupBy(total.alias("total")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most one a sample row
        least = _least_gain([(r["total"], r["n"]) for r in tallies], share)
        telling = terms.where((F.col("pos") >= 5) & (gain >= least) & (odds >= 40)).orderBy(F.desc(gain), F.desc(F.length("term")), "stem", "term").limit(max_terms).collect()
        found, stems = _chosen([(r["term"], r["stem"], r["pos"]) for r in telling])
        words |= {w: edits_for(w) for w in found if w not in words}
        near = terms.where(~F.col("stem") & (F.col("neg") > 0)).select("term").mapInArrow(_surfaces(words, stems), "term string, near string").collect()
        stop = frozenset(r["term"] for r in near)  # words of clean sample documents near a term
        # learned terms that clean words are near to are taken as they are
        words |= {r["near"]: 0 for r in near if r["near"] not in LEXICON}
        spoilt = [r["term"] for r in terms.where(~F.col("stem") & F.col("term").isin(list(LEXICON)) & (odds < 1) & (F.col("neg") >= 5)).collect()]
        words = {w: k for w, k in words.items() if w not in spoilt}
    context = docs.sparkSession.sparkContext.broadcast((words, stems, stop))
    found = rows.mapInArrow(_feature_rows(context, ("y",)), "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in found]).reshape(-1, FEATURES), np.array([r["y"] for r in found], dtype=float)
    # prior cases, so that what the sample lacks has a sign: abuse, fuzzy abuse, quotation, nothing
    prior_x = np.array([[1, 1.1, 0, 0, 0, 0.3, 1.1], [0, 0, 1, 0.7, 0, 0.1, 0.7], [0, 0, 0, 0, 0.5, 0, 0.7], [0] * 7], dtype=float)
    prior_y = np.array([1.0, 1.0, 0.0, 0.0])
    w = np.where(y > 0, weight[1], weight[0])
    mass = max(1.0, w.sum())
    w = np.concatenate([w, np.full(4, 0.002 * mass)])
    weights, bias = logistic(np.concatenate([x, prior_x]), np.concatenate([y, prior_y]), w, ridge=1e-4)
    return words, stems, stop, weights, bias


def score(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, per_class: tuple[int, int] = (5000, 3000),
    doc_col: str = "doc_id", text_col: str = "text", max_terms: int = 2000,
) -> DataFrame:
    """doc_id, held_out, score, predicted of each document row.

    ``per_class``: the most label rows (clean, toxic) that are learned from; ``max_terms``: of learned terms.
    """
    model = fit(docs, labels, folds, held, per_class, doc_col, text_col, max_terms)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(F.col(doc_col).alias("doc_id"), (crc_mod(doc_col, folds) == held).alias("held_out"), F.col(text_col).cast("binary").alias("raw"))
    out = rows.mapInArrow(_score_rows(shared), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they are."""
    per_class = options.pop("per_class", (5000, 3000))
    model = fit(docs, labels, options.pop("folds", 4), options.pop("held", 2), per_class, doc_col, text_col, options.pop("max_terms", 2000))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = inner.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered("toxicity")
        words, stems, stop, weights, bias = shared.value
        scanner = Scanner(Automaton(words, stems), stop)
        text = names.index(text_col)
        for batch in batches:
            raw = batch.column(text).cast(pa.binary()).to_pylist()
            x = np.array([scanner.features(t) for t in raw]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return inner.mapInArrow(keep, schema).toDF(*names)
