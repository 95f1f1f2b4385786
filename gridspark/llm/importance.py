"""Importance resampling towards a target distribution, with bit-sliced sums.

Texts are bags of hashed features. A bucket's gain says how much likelier it is in the target than in the corpus; a document's
weight is the mean of its features' gains. Counts of a document become bit planes, one bit a bucket, and so do the gains, the
positive and the negative ones apart; the sum of count times gain is the sum over pairs of planes of their common bits, times
a power of two, which is exact. Documents are then drawn without replacement by Gumbel top-k: weight plus noise.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.llm.common import arrow_schema, save, slices, text_or_empty

#: Buckets of features; a document needs LEAST_WORDS words to be drawn; drawn are SHARE per cent.
BUCKETS, LEAST_WORDS, SHARE = 10_000, 20, 10
WEIGHED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
#: Fixed: everything but ASCII letters, digits and what is beyond ASCII parts words; capitals become small.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Distinct features whose buckets a task remembers.
REMEMBERED = 1 << 18


class Buckets(dict):
    """The bucket of a feature's bytes; remembers up to REMEMBERED of them."""

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % BUCKETS
        if len(self) < REMEMBERED and len(feature) < 64:
            self[feature] = bucket
        return bucket


def features(text: str, most_words: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to most_words of them."""
    words = text.encode().translate(TO_WORDS).split()
    runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, most_words + 1))]
    return len(words), list(chain.from_iterable(runs)) if most_words > 1 else words


def bit_planes(at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Planes x 64-bit words: bit at[i] of plane k is bit k of numbers[i], which isn't negative; other buckets are 0."""
    bits = np.zeros((max(1, int(numbers.max(initial=0)).bit_length()), -(-BUCKETS // 64) * 64), np.uint8)
    for k, row in enumerate(bits):
        row[at] = numbers >> k & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def weighted_sum(counts: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> int:
    """The sum of count times gain, from the planes of counts and of positive and negative gains; exact at any size."""
    total = 0
    for sign, gains in ((1, plus), (-1, minus)):
        common = np.bitwise_count(counts[:, None, :] & gains[None]).sum(axis=2, dtype=np.int64)
        total += sign * sum(n << (k + j) for k, row in enumerate(common.tolist()) for j, n in enumerate(row))
    return total


def bucket_counts(texts: DataFrame, text_col: str, most_words: int) -> np.ndarray:
    """How often each bucket occurs in all texts: each task adds up its own texts, at most BUCKETS rows go to the driver."""

    def run(batches):
        bucket, total = Buckets(), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                found = features(text, most_words)[1]
                total += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat, rounded down; every bucket counts as seen once more on both sides."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: str) -> int:
    """Gumbel noise of a document in thousandths, rounded down: the same for the same seed and id wherever it runs."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: str, most_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight (0 without features) and score (null without doc_id) of every whole text."""
    schema = arrow_schema(WEIGHED)
    plus, minus = (bit_planes(np.arange(BUCKETS), np.maximum(x, 0)) for x in (gains, -gains))

    def run(batches):
        bucket = Buckets()
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words, found = features(text, most_words)
                at, counts = np.unique(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), return_counts=True)
                weight = weighted_sum(bit_planes(at, counts), plus, minus) // len(found) if found else 0
                rows.append((doc_id, words, len(found), weight, None if doc_id is None else weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, WEIGHED)


def ranked(rows: DataFrame, order: list, rows_a_part: int = 1 << 20) -> DataFrame:
    """rows with their rank (from 1) in an order over all of them: sorted ranges of about rows_a_part rows, each numbered from its own start."""
    parts = max(1, -(-rows.count() // rows_a_part))
    dealt = save(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.Window.orderBy("_part")) - F.col("_n")).drop("_n")
    numbered = dealt.withColumn("_at", F.row_number().over(W.Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, seed: str = "2024", share: int = SHARE, least_words: int = LEAST_WORDS, most_words: int = 1, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (longs), one row per row of docs; rank is null for those that aren't drawn.

    Drawn are share per cent (rounded down) of the rows with at least least_words words and a doc_id, those of the highest
    scores, equal ones by doc_id, then by weight and features (rows equal in all of these are alike). Null and empty texts have
    no features and weight 0. Rows without doc_id have a weight, but no score, and aren't drawn. An empty target or corpus has
    counts of 0, which are smoothed like others.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, most_words), bucket_counts(target, target_text_col, most_words))
    weighed = save(weigh(docs, gains, seed, most_words, id_col, text_col), "weighed")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # scores are whole thousandths in a range that grows with the logarithm of the tables only, so these are few rows at any size
    levels = weighed.where(may).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    drawn = share * sum(r["n"] for r in levels) // 100
    least, above = None, 0
    for r in levels:
        if above >= drawn:
            break
        least, above = r["score"], above + r["n"]
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if least is None:
        return weighed.withColumn("rank", F.lit(None).cast("bigint")).select(columns)
    chosen = F.coalesce(may & (F.col("score") >= least), F.lit(False))
    top = ranked(weighed.where(chosen), [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.asc("n_features")]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.select(columns).unionByName(weighed.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")).select(columns))
