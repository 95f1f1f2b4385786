"""A pipeline over documents: quality rules, language, near duplicates, repeated passages, packing.

A row without a doc_id cannot be followed through the stages and is rejected by the first one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.llm import language_id, line_rules, near_duplicates, packing, substring_dedup
from gridspark.llm.common import save, short_batches


#: Score from which a predicted language may contradict the recorded one; README gives its figures.
CLEAR = 0.05
#: Least Jaccard similarity of near duplicates' 5-word shingles, in per cent.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines."""
    short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_rules.judge_lines(docs.where("doc_id is not null"), labels, carry=True).where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language that does not clearly contradict the recorded one."""
    found = language_id.identify_held_out(docs, carry=True)
    contradicts = F.coalesce(F.col("row.lang") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= CLEAR)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~contradicts).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each doc_id: that of the least digest of its text."""
    kept = near_duplicates.near_duplicate_components(docs, NEAR).where("kept").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return stay.select(docs.columns)
    order = W.Window.partitionBy("doc_id").orderBy(F.sha2("text", 256), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return stay.withColumn("_first", F.row_number().over(order)).where("_first = 1").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; documents of which nothing is left go."""
    found = substring_dedup.remove_repeats(docs, with_text=True, carry=True).where("kept_text <> ''")
    return found.select("row.*", F.col("kept_text").alias("text")).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("near duplicates", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the first's base rules can be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{i}")
    return docs
