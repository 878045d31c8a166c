"""Bounded labelled samples and small linear models for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import crc_mod, written


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, per_class: tuple[int, int], folder: str,
    doc_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, dict[int, float]]:
    """A written table (doc_id, text, y) of labelled training rows and the weight of each class.

    At most ``per_class`` (label 0, label 1) label rows, the first by a hash of the id, whatever the table;
    their ids are broadcast to find the texts. Rows of the held-out remainder, with a null id or a
    null label are not used; an id with several labels has the largest. A class weighs as many label
    rows as it stands for.
    """
    known = labels.where(F.col(doc_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod(doc_col, folds) != held))
    known = known.groupBy(F.col(doc_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y, most in enumerate(per_class):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    weights = {y: sizes.get(y, 0) / max(1, min(sizes.get(y, 0), per_class[y])) for y in (0, 1)}
    return written(rows, f"{folder}/sample"), weights


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.0, lasso: float = 0.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a weighted logistic regression, by accelerated proximal gradient.

    The intercept is not penalised. Columns of ``x`` should have a scale near 1.
    """
    w = w / w.sum()
    n, d = x.shape
    if not n or y.min() == y.max():
        p = float(np.clip((w * y).sum(), 1e-3, 1 - 1e-3)) if n else 0.5
        return np.zeros(d), float(np.log(p / (1 - p)))
    full = np.concatenate([x, np.ones((n, 1))], axis=1)
    bound = 0.25 * float(np.linalg.eigvalsh((full * w[:, None]).T @ full)[-1]) + ridge
    b = np.zeros(d + 1)
    b[-1] = np.log((w * y).sum() / (w * (1 - y)).sum())
    z, t = b.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        gradient = full.T @ (w * (p - y))
        gradient[:-1] += ridge * z[:-1]
        new = z - gradient / bound
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - lasso / bound, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - b)
        b, t = new, t_new
    return b[:-1], float(b[-1])
