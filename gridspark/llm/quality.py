"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its own mean variance; a document's score follows from the difference
of the classes' log densities, Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_schema, crc_bucket, save, slices, text_or_empty

#: Share of a class covariance that goes to a multiple of the identity.
SHRINKAGE = 0.1
#: Words that a text's own statistics weigh as much as the average text's: short texts say little.
SHORT_WORDS = 30
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
N_STATISTICS = 14

_UPPER, _LOWER, _DIGIT, _MARK = (re.compile(x) for x in (r"[A-ZÀ-ÖØ-Þ]+", r"[a-zß-öø-ÿ]+", r"[0-9]+", r"[.,;:?]+"))


def statistics(text: str) -> tuple:
    """Transformed statistics of a whole text; an empty one has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * N_STATISTICS
    distinct = len(set(words))
    letters = sum(map(len, words))
    span = lambda pattern: len("".join(pattern.findall(text))) / size
    repeats = sum([a == b for a, b in zip(words, words[1:])])
    lines = [x for x in text.split("\n") if x]
    bare = text.replace(" ", "")
    return (
        np.log1p(n),
        np.log(letters / n),
        np.log(distinct / n) / np.log1p(n),
        np.sqrt(repeats / n),
        np.sqrt(span(_UPPER)),
        span(_LOWER),
        np.sqrt(span(_DIGIT)),
        np.sqrt(span(_MARK)),
        np.sqrt(sum(map(text.count, "#*$%&|<>")) / size),
        np.sqrt(text.count("!") / size),
        np.log1p(len(lines)) - np.log1p(n),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(sum(map(bare.count, "()[]{}@/\\_=+~^")) / size),
        np.log1p(max(map(len, words))),
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (the statistics of every whole text) and weight (of its own statistics, from 0 to 1); null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64())), ("weight", pa.float64())])

    def run(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            words = np.array([len(t.split()) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in texts], schema.field(1).type), pa.array(words / (words + SHORT_WORDS))], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, "doc_id bigint, x array<double>, weight double")


def drawn_in(x: pa.Array, weight: pa.Array, average: np.ndarray) -> np.ndarray:
    """Statistics drawn to the average by what a text's own don't weigh."""
    own = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), N_STATISTICS)
    return average + (own - average) * weight.to_numpy(zero_copy_only=False)[:, None]


def average_statistics(rows: DataFrame) -> np.ndarray:
    """Weighted average of x over all rows; zeros without any."""
    sums = rows.agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * F.get("x", i)).alias(f"x{i}") for i in range(N_STATISTICS))).first()
    return np.array(sums[1:], float) / sums["w"] if sums["w"] else np.zeros(N_STATISTICS)


def class_moments(rows: DataFrame, average: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the drawn-in x by label, over all rows (columns x, weight, label); one small row per task and label."""
    schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("moments", pa.list_(pa.float64()))])

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            x = drawn_in(batch.column(0), batch.column(1), average)
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(labels):
                own = x[labels == k]
                n, moments = total.get(int(k), (0, 0.0))
                total[int(k)] = n + len(own), moments + np.concatenate([own.sum(0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_pylist([{"label": k, "n": n, "moments": m.tolist()} for k, (n, m) in total.items()], schema=schema)

    parts = rows.select("x", "weight", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, n bigint, moments array<double>")
    summed = parts.select("label", "n", F.posexplode("moments").alias("i", "m")).groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
    found = {}
    for k in {r["label"] for r in summed}:
        own = sorted((r["i"], r["n"], r["m"]) for r in summed if r["label"] == k)
        m, d = np.array([x[2] for x in own]), N_STATISTICS
        found[k] = own[0][1], m[:d], m[d:].reshape(d, d)
    return found


class QuadraticDiscriminant:
    """Class 1 against class 0."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.parts = []
        total = sum(n for n, _, _ in moments.values())
        if not total:
            return
        mean = sum(s for _, s, _ in moments.values()) / total
        spread = np.sqrt(np.maximum(np.diag(sum(o for _, _, o in moments.values())) / total - mean**2, 1e-9))
        for k in (0, 1):
            if k in moments:
                n, s, outer = moments[k]
                centre = s / n
                covariance = (outer / n - np.outer(centre, centre)) / np.outer(spread, spread)
                covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / len(s), 1e-3) * np.eye(len(s))
                lower = np.linalg.cholesky(covariance)
                self.parts.append((k, centre, spread, np.linalg.inv(lower), np.log(np.diag(lower)).sum(), np.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; 0.5 without any label, 0 or 1 with one class only."""
        if len(self.parts) < 2:
            return np.full(len(x), 0.5 if not self.parts else float(self.parts[0][0]))
        logs = []
        for _, centre, spread, inverse, half_determinant, prior in self.parts:
            z = ((x - centre) / spread) @ inverse.T
            logs.append(prior - half_determinant - 0.5 * np.square(z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, one row per row of docs.

    Learns from the labels of all rows that aren't held out, by sums over statistics only; labels other than 0 and 1 and labels
    without a document teach nothing, and a document of both counts as 1. Repeated rows of a document are learnt from each, and
    get equal scores. held_out is a column over doc_id. Null and empty texts get the score of average statistics.
    """
    rows = save(document_statistics(docs), "quality-statistics")
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    learnt = rows.where(~held_out).join(marks, "doc_id")
    average = average_statistics(learnt)
    model = QuadraticDiscriminant(class_moments(learnt, average))
    schema = arrow_schema(SCORED)

    def run(batches):
        for batch in batches:
            score = model.score(drawn_in(batch.column(2), batch.column(3), average))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return rows.select("doc_id", held_out.alias("held_out"), "x", "weight").mapInArrow(run, SCORED)


def classify_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """classify() with one fold of crc32(doc_id) held out."""
    return classify(docs, labels, crc_bucket(F.col("doc_id"), folds) == fold)
