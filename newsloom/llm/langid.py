"""Language of texts by a linear-chain conditional random field over words.

Each word has hashed features: its prefixes and suffixes of one to three letters, its letter bigrams
and trigrams, and whether it is among the words that the training sample shows to be typical of a
language. A chain over the words of a text, in blocks of ``BLOCK`` words, has learned transitions.
Forward-backward gives each word's language probabilities, also where a text switches languages; the
text's language has the largest expected share of its words, and the score is that share.

A word is a run of letters; a run of more than ``PIECE``, as scripts without spaces have them, is cut
into pieces of that length, each a word.

Training: the words of the sample's texts are cut into stretches, and stretches of different languages
spliced into sequences, so words have known labels and switches occur; the conditional likelihood is
raised by stochastic gradients. The sample is bounded, its rows of each language a parameter; of these
rows whole texts are learned from. Emissions depend on the word alone and are remembered.

Defined results: a text that is null or has no letter is ``und`` with score 0 (letters are of the
general category L: no digits, fractions or numerals in circles); repeated rows are
predicted each; a null id counts as the empty text for the split; without labelled texts every text
is ``und`` with score 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import crc_mod, work_dir, written

PIECE = 40
#: Word characters that are neither letters nor decimal digits: superscripts, fractions, numerals. Few texts have any.
_NUMERALS = regex.compile(r"\p{No}|\p{Nl}|[^\W\d_\p{L}]")
_LETTERS = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")
BLOCK = 64
BITS = 16
LEXICON = 2000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, those over ``PIECE`` in pieces."""
    if not text:
        return []
    return _LETTERS.findall(_NUMERALS.sub(" ", text.lower()))


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed features of a lower-case word."""
    w = f"^{word}$"
    grams = {f"n{w[i : i + k]}" for k in (2, 3) for i in range(len(w) - k + 1)}
    grams |= {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3)}
    grams |= {f"l{i}" for i in lexicon.get(word, ())}
    return sorted(xxhash.xxh3_64_intdigest(g) & ((1 << BITS) - 1) for g in grams)


class Model:
    def __init__(self, langs: list[str], lexicon: dict[str, tuple[int, ...]]):
        self.langs, self.lexicon = langs, lexicon
        k = len(langs)
        self.emission = np.zeros((1 << BITS, k), dtype=np.float32)
        self.transition = np.log(np.where(np.eye(k) > 0, 0.95, 0.05 / max(1, k - 1)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids = [features(w, self.lexicon) for w in words]
        ends = np.cumsum([len(x) for x in ids])
        if not len(ends):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        flat = self.emission[np.concatenate(ids)]
        return np.add.reduceat(flat, np.concatenate([[0], ends[:-1]]), axis=0)


def forward_backward(scores: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lanes, places, labels) and summed pair marginals; masked places lie behind a chain's end."""
    lanes, places, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    e = np.where(mask[:, :, None], e, 1.0)
    t = np.exp(transition)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, places):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(places - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1]
        b = right @ t.T
        beta[:, i] = np.where(mask[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        joint_norm = np.einsum("li,ij,lj->l", alpha[:, i], t, right)
        scale = np.where(mask[:, i + 1], 1 / np.maximum(joint_norm, 1e-300), 0)
        pairs += t * (alpha[:, i].T @ (right * scale[:, None]))
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), pairs


def marginals(scores: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """As forward_backward, without pairs: what predictions need."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    e = np.where(mask[:, :, None], e, 1.0)
    t = np.exp(transition).astype(e.dtype)
    alpha = np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, e.shape[1]):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    b = np.ones_like(alpha[:, 0])
    for i in range(e.shape[1] - 2, -1, -1):
        b = (e[:, i + 1] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        b[~mask[:, i + 1]] = 1.0  # nothing follows the last word
        alpha[:, i] *= b
    return alpha / alpha.sum(axis=2, keepdims=True)


def train(samples: list[tuple[str, str]], seed: int = 7, epochs: int = 3, lanes: int = 128) -> Model | None:
    """A model from (text, language) pairs."""
    texts = [(words_of(t), lang) for t, lang in samples]
    texts = [(w, lang) for w, lang in texts if w]
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return None
    index = {lang: i for i, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for words, lang in texts:
        counts[index[lang]].update(set(words))
    whole = sum(counts, Counter())
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):  # words of many texts of one language, mostly of that one
        common = [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= 3 and n >= 0.6 * whole[w]]
        for w in common[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    model = Model(langs, {w: tuple(x) for w, x in lexicon.items()})
    rng = np.random.default_rng(seed)
    known: dict[str, list[int]] = {}
    # all words of a text in stretches of 8 to 32 words, which are spliced to blocks
    stretches = []
    for words, lang in texts:
        a = 0
        while a < len(words):
            b = a + int(rng.integers(8, 33))
            stretches.append((words[a:b], index[lang]))
            a = b
    k = len(langs)
    squares, t_squares = np.full(model.emission.shape, 1e-6, dtype=np.float32), np.full((k, k), 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(stretches))
        blocks, at = [], 0
        while at < len(order):
            block: list[tuple[str, int]] = []
            while at < len(order) and len(block) < BLOCK:
                words, label = stretches[order[at]]
                block += [(w, label) for w in words]
                at += 1
            blocks += [block[a : a + BLOCK] for a in range(0, len(block), BLOCK)]
        for a in range(0, len(blocks), lanes):
            part = blocks[a : a + lanes]
            flat, rows, cells, gold = [], [], [], np.full((len(part), BLOCK), -1)
            for i, block in enumerate(part):
                for j, (w, label) in enumerate(block):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = features(w, model.lexicon)
                    flat += ids
                    rows += [len(cells)] * len(ids)
                    cells.append(i * BLOCK + j)
                    gold[i, j] = label
            flat_, rows_, cells_ = np.array(flat), np.array(rows), np.array(cells)
            summed = np.stack([np.bincount(rows_, model.emission[flat_, c], len(cells_)) for c in range(k)], axis=1)
            scores = np.zeros((len(part) * BLOCK, k))
            scores[cells_] = summed
            mask = gold >= 0
            gamma, pairs = forward_backward(scores.reshape(len(part), BLOCK, k), mask, model.transition)
            target = np.eye(k)[np.maximum(gold, 0)]
            error = (target - gamma).reshape(-1, k)[cells_]
            both = mask[:, 1:] & mask[:, :-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            size = len(cells_)
            touched, inverse = np.unique(flat_, return_inverse=True)
            g = np.stack([np.bincount(inverse.ravel(), error[rows_, c], len(touched)) for c in range(k)], axis=1) / size
            g -= 1e-6 * model.emission[touched]
            squares[touched] += g * g
            model.emission[touched] += (0.5 * g / np.sqrt(squares[touched] + 1e-10)).astype(np.float32)
            tg = (seen - pairs) / size
            t_squares += tg * tg
            model.transition += 0.05 * tg / np.sqrt(t_squares)
    return model


class Predictor:
    """Texts to (language, score); remembers the emissions of up to ``most`` words."""

    def __init__(self, model: Model, most: int = 600_000):
        self.model, self.most = model, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(model.langs)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        """Emissions of new words into the table."""
        missing = list({w for w in words if w not in self.rows})
        if len(self.rows) + len(missing) > self.most:
            self.rows.clear()
            missing = list(set(words))
        n = len(self.rows)
        while len(self.table) < n + len(missing):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(missing)] = self.model.word_scores(missing)
        self.rows.update(zip(missing, range(n, n + len(missing)), strict=True))

    def _words(self, text: str | None) -> list[str]:
        """As ``words_of``; runs that were met before hold no numerals and are not looked at again."""
        words = _LETTERS.findall(text.lower()) if text else []
        rows = self.rows
        if any(w not in rows and not w.isascii() and _NUMERALS.search(w) for w in words):
            return words_of(text)
        return words

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text its language and score."""
        out: list[tuple[str, float]] = []
        part: list[list[str]] = []
        size = 0
        for t in texts:
            words = self._words(t)
            part.append(words)
            size += len(words)
            if size > 200_000:
                out += self._part(part)
                part, size = [], 0
        return out + (self._part(part) if part else [])

    def _part(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        k = len(self.model.langs)
        lengths = np.array([len(d) for d in docs])
        flat = [w for d in docs for w in d]
        if not flat:
            return [("und", 0.0)] * len(docs)
        scores = self.table_of(flat)
        # blocks of a document lie one after another; the last one of each is filled up
        blocks = -(-lengths // BLOCK)
        first = np.cumsum(blocks) - blocks
        starts = np.cumsum(lengths) - lengths
        cell = np.repeat(first * BLOCK - starts, lengths) + np.arange(len(flat))
        total = int(blocks.sum())
        padded = np.zeros((total * BLOCK, k), dtype=np.float32)
        mask = np.zeros(total * BLOCK, dtype=bool)
        padded[cell] = scores
        mask[cell] = True
        gamma = marginals(padded.reshape(total, BLOCK, k), mask.reshape(total, BLOCK), self.model.transition).reshape(-1, k)
        own = np.flatnonzero(lengths)
        share = np.add.reduceat(gamma[cell].astype(np.float64), starts[own], axis=0) / lengths[own][:, None]
        best = share.argmax(axis=1)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(docs)
        for i, b, s in zip(own.tolist(), best.tolist(), share.max(axis=1).tolist(), strict=True):
            out[i] = (self.model.langs[b], min(1.0, s))
        return out

    def table_of(self, words: list[str]) -> np.ndarray:
        self._learn(words)
        rows = self.rows
        return self.table[np.array([rows[w] for w in words], dtype=np.int64)]


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        predictor = Predictor(model) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = predictor.predict(texts) if predictor else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def sample(docs: DataFrame, folds: int, held: int, per_lang: int, doc_col: str, text_col: str, lang_col: str) -> DataFrame:
    """text, lang of at most ``per_lang`` different training rows of each language, the first by a hash of id and text."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (crc_mod(doc_col, folds) != held))
    known = known.select(F.xxhash64(F.col(doc_col).cast("string"), text_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # keys alone are ranked, at most per_lang a language and task are shuffled
    first = Window.partitionBy("lang").orderBy("key")
    picked = known.select("key", "lang").withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_lang).select("key", "lang").distinct()
    return known.join(F.broadcast(picked), ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"]).select("lang", "key", "text")


def predict(
    docs: DataFrame, folds: int = 3, held: int = 1, per_lang: int = 150, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document row.

    Learned from at most ``per_lang`` training rows of each language, whole texts, the first by a hash.
    """
    spark = docs.sparkSession
    rows = written(sample(docs, folds, held, per_lang, doc_col, text_col, lang_col), f"{work_dir(spark, 'language')}/sample")
    rows = sorted((r["lang"], r["key"], r["text"]) for r in rows.toLocalIterator())
    shared = spark.sparkContext.broadcast(train([(text, lang) for lang, _, text in rows]))
    kind = docs.schema[doc_col].dataType.simpleString()
    body = docs.select(F.col(doc_col).alias("doc_id"), (crc_mod(doc_col, folds) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return body.mapInArrow(_predictions(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
