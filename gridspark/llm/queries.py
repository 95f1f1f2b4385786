"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, filter_audit, importance, language_id, line_rules, lm_scoring, main_text, near_duplicates, packing, quality, substring_dedup, token_counts, vector_search
from gridspark.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_held_out(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB. sum(q * x) is taken as a product of integer lists.
OP8_SQL = """
WITH v AS (
  SELECT vec_id, min([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(x.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.c) = len(x.c)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: DuckDB. A filter's step in an order is its letter's place in the order's name; 6 stands for never.
OP11_SQL = """
WITH marks AS (
  SELECT doc_id, CAST(bool_or(coalesce(quality = 1, false)) AS BIGINT) AS good, CAST(bool_or(coalesce(toxic = 1, false)) AS BIGINT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts LEFT JOIN marks USING (doc_id)
), profiles AS (
  SELECT part, a, b, c, d, e, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flagged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), removed_at AS (
  SELECT p.*, filter_order, least(CASE WHEN a THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN c THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN e THEN instr(filter_order, 'E') ELSE 6 END) AS r
  FROM profiles p, orders
), steps AS (
  SELECT *, substr(filter_order, step, 1) AS f, CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails
  FROM removed_at, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), counted AS (
  SELECT part, filter_order, step, f, CAST(sum(CASE WHEN r > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN r = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND r < step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN r = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN r = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_suffix_dedup": op2_suffix_dedup, "op3_token_counts": op3_token_counts, "op4_quality": op4_quality, "op5_byte_bpe": op5_byte_bpe, "op6_lm_scoring": op6_lm_scoring, "op7_quality_rules": op7_quality_rules, "op8_exact_topk": op8_exact_topk, "op9_near_duplicates": op9_near_duplicates, "op10_language_id": op10_language_id, "op11_filter_audit": op11_filter_audit, "op12_main_text": op12_main_text, "op13_importance_resampling": op13_importance_resampling}
ORACLE_SQL = {"op8_exact_topk": OP8_SQL, "op11_filter_audit": OP11_SQL}
