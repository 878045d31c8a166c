"""Quality: a sparse ensemble of rules over document statistics, compiled into Spark columns.

Statistics are Spark expressions over the whole text. On a bounded labelled sample, small trees are
boosted over binned statistics; every path from a root is a rule, a conjunction of bounds. A logistic
model with a lasso penalty weighs the rules, most of them to zero; what stays becomes one sum of
``when`` expressions, so that scoring is a projection over the scan, without Python or a shuffle.

Defined results: null and empty texts have all statistics 0 and score by the rules that hold there;
repeated rows are scored each; a null id counts as the empty text for the split; without labels every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import crc_mod, work_dir
from newsloom.llm.training import labelled_sample, logistic

STATISTICS = (
    "n_chars", "n_words", "word_length", "longest", "upper", "digits", "symbols", "bangs", "bars", "ends", "distinct", "half_distinct", "lines", "line_distinct", "pairs",
)


def _without(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Columns ``keep`` and the statistics, each a double."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = rows.select(*keep, "__t", F.filter(F.split(F.lower("__t"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("__w"), F.split("__t", "\n").alias("__l"))
    chars, words = F.greatest(F.length("__t"), F.lit(1)), F.greatest(F.size("__w"), F.lit(1))
    half = F.slice("__w", 1, F.greatest(F.ceil(F.size("__w") / 2).cast("int"), F.lit(1)))
    follow = F.zip_with("__w", F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1))), lambda a, b: (a.eqNullSafe(b)).cast("int"))
    made = {
        "n_chars": F.log1p(F.length("__t")),
        "n_words": F.log1p(F.size("__w")),
        "word_length": F.length("__t") / words,
        "longest": F.log1p(F.coalesce(F.array_max(F.transform("__w", lambda w: F.length(w))), F.lit(0))),
        "upper": _without("__t", r"\p{Lu}") / chars,
        "digits": _without("__t", r"[0-9]") / chars,
        "symbols": _without("__t", r"[#$%&*+=<>@^_~{}\[\]\\|/]") / chars,
        "bangs": _without("__t", r"[!?]") / chars,
        "bars": _without("__t", r" \| ") / chars,
        "ends": _without("__t", r"[.]") / words,
        "distinct": F.size(F.array_distinct("__w")) / words,
        "half_distinct": F.size(F.array_distinct(half)) / F.greatest(F.size(half), F.lit(1)),
        "lines": F.size("__l") / words,
        "line_distinct": F.size(F.array_distinct("__l")) / F.greatest(F.size("__l"), F.lit(1)),
        "pairs": F.aggregate(follow, F.lit(0), lambda s, x: s + x) / words,
    }
    return rows.select(*keep, *[c.cast("double").alias(n) for n, c in made.items()])


# --- learning ----------------------------------------------------------------------------------

#: A rule: (statistic, least or None, below or None) bounds that all hold, least <= x < below.
Rule = tuple[tuple[int, float | None, float | None], ...]


def _tree(binned: np.ndarray, gradient: np.ndarray, w: np.ndarray, depth: int, bins: int) -> list[tuple[list[tuple[int, int, bool]], np.ndarray, float]]:
    """Nodes below the root: their path of (statistic, bin, right side?), rows, and mean gradient."""
    out = []
    todo = [([], np.arange(len(gradient)))]
    while todo:
        path, own = todo.pop()
        if len(path) >= depth or len(own) < 10:
            continue
        best = None
        g, h = gradient[own], w[own]
        for j in range(binned.shape[1]):
            sums = np.bincount(binned[own, j], g, bins)[:-1].cumsum()
            mass = np.bincount(binned[own, j], h, bins)[:-1].cumsum()
            gain = sums**2 / (mass + 1e-3) + (g.sum() - sums) ** 2 / (h.sum() - mass + 1e-3)
            gain[(mass < 1e-3 * w.sum()) | (h.sum() - mass < 1e-3 * w.sum())] = -1
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0] + 1e-12):
                best = (gain[k], j, k)
        if best is None or best[0] <= g.sum() ** 2 / (h.sum() + 1e-3) * (1 + 1e-6) + 1e-9:
            continue
        right = binned[own, best[1]] > best[2]
        for side, rows in ((False, own[~right]), (True, own[right])):
            step = [*path, (best[1], best[2], side)]
            out.append((step, rows, float(gradient[rows].sum() / (w[rows].sum() + 1e-3))))
            todo.append((step, rows))
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48) -> list[Rule]:
    """Distinct rules of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)
    w = w / w.mean()
    base = np.log((w * y).sum() / (w * (1 - y)).sum())
    score = np.full(len(y), base)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes = _tree(binned, w * (y - p), w * np.maximum(p * (1 - p), 1e-3), depth, bins)
        if not nodes:
            break
        for path, rows, value in nodes:
            if len(path) == depth or not any(q[0][: len(path)] == path and len(q[0]) > len(path) for q in nodes):
                score[rows] += 0.3 * np.clip(value, -4, 4)
            bounds: dict[int, list[float | None]] = {}
            for j, k, right in path:
                b = bounds.setdefault(j, [None, None])
                cut = float(cuts[j][k])
                if right:
                    b[0] = cut if b[0] is None else max(b[0], cut)
                else:
                    b[1] = cut if b[1] is None else min(b[1], cut)
            rules[tuple((j, *b) for j, b in sorted(bounds.items()))] = None
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, least, below in rule:
        if least is not None:
            out &= x[:, j] >= least
        if below is not None:
            out &= x[:, j] < below
    return out


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, lasso: float = 3e-4) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with weights that are not zero, and the intercept."""
    if not len(y) or y.min() == y.max():
        return [], float(logistic(np.zeros((len(y), 0)), y, w)[1]) if len(y) else 0.0
    rules = learn_rules(x, y, w)
    if not rules:
        return [], float(logistic(np.zeros((len(y), 0)), y, w)[1])
    matrix = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    weights, bias = logistic(matrix, y, w, lasso=lasso, steps=800)
    return [(r, float(b)) for r, b in zip(rules, weights, strict=True) if abs(b) > 1e-6], bias


def compiled(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score as one column expression over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        condition = F.lit(True)
        for j, least, below in rule:
            c = F.col(STATISTICS[j])
            if least is not None:
                condition &= c >= least
            if below is not None:
                condition &= c < below
        total += F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def model(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: tuple[int, int], doc_col: str, text_col: str) -> tuple[list[tuple[Rule, float]], float]:
    folder = work_dir(docs.sparkSession, "quality")
    sample, weight = labelled_sample(docs, labels, "quality", folds, held, per_class, folder, doc_col, text_col)
    rows = with_statistics(sample, ("y",), "text").collect()  # at most the sample's rows, without texts
    x = np.array([[r[c] for c in STATISTICS] for r in rows]).reshape(-1, len(STATISTICS))
    y = np.array([r["y"] for r in rows], dtype=float)
    order = np.lexsort([*x.T, y])  # the fit does not depend on how rows came
    x, y = x[order], y[order]
    return fit(x, y, np.where(y > 0, weight[1], weight[0]))


def score(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, per_class: tuple[int, int] = (4000, 4000),
    doc_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of each document row.

    ``per_class``: the most label rows (label 0, label 1) that are learned from.
    """
    rules, bias = model(docs, labels, folds, held, per_class, doc_col, text_col)
    inner = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(doc_col, folds) == held).alias("held_out"))
    out = with_statistics(inner, ("doc_id", "held_out"), "text").withColumn("score", compiled(rules, bias))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, per_class: tuple[int, int] = (4000, 4000),
    doc_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they are."""
    rules, bias = model(docs, labels, folds, held, per_class, doc_col, text_col)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = with_statistics(inner, tuple(inner.columns), f"c{names.index(text_col)}")
    return out.where(compiled(rules, bias) >= threshold).select(*inner.columns).toDF(*names)
