"""The operators as named queries over the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontam, langid, licenses, lm_mix, ngram_join, packing, quality, topk, toxicity, warc
from newsloom.llm.common import table, tune


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file; installed with the libraries and never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"), revisit_from=1000).drop("url")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("findings")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return lm_mix.score(table(spark, sf_dir, "documents"), folds=10, held=0)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return ngram_join.report(table(spark, sf_dir, "documents"), share=(4, 5))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return langid.predict(table(spark, sf_dir, "documents"), folds=3, held=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_licenses, op3_quality, op4_lm_scores, op5_topk, op6_ngram_join, op7_decontamination, op8_packing, op9_language, op10_toxicity)
}

OP1_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), b AS (SELECT d, n, max(page_id) AS best, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN b.c > 1 AND b.best IS NOT NULL AND b.best IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.c > 1 AND b.best IS DISTINCT FROM p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN b ON p.d = b.d AND p.n = b.n
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT item_id, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM bw
), ks AS (SELECT DISTINCT k FROM win), dw AS (
  SELECT doc_id, ks.k AS k, unnest(range(1, len(w) - ks.k + 2)) AS i, w FROM d, ks WHERE len(w) >= ks.k
), hits AS (
  SELECT dw.doc_id, dw.i, dw.k, win.item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM dw) dw JOIN win ON dw.k = win.k AND dw.t = win.t
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op5_topk": OP5_SQL, "op6_ngram_join": OP6_SQL, "op7_decontamination": OP7_SQL}
