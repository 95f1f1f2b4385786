"""Quality rules by labelling a document's lines with a linear-chain conditional random field.

Each line is described by a few statistics; the field scores content or boilerplate from them and from the step between
neighbouring labels. Viterbi decoding gives the labels of a whole text, and the share of its characters in content lines
decides whether it is kept.

Only documents are labelled, so lines' labels are latent: good documents are mostly content, bad ones mix both. The field's
parts are trained one by one (piecewise): expectation and maximisation in turn give each line a share of content and fit the
emissions to it by Newton's method; steps follow from the labels of neighbouring lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_schema, carried, slices, text_or_empty

#: Bounds of the labelled sample: documents, and characters of all of them, whole documents only; rounds of the fit.
SAMPLE_DOCS, SAMPLE_CHARS, ROUNDS = 3000, 16_000_000, 12
#: Share of content lines in good documents, and at most in bad ones; weight of the penalty on emissions; weight of steps
#: beside emissions, below 1 as parts that are trained apart count what they share twice.
GOOD_CONTENT, BAD_CONTENT, PENALTY, STEP_WEIGHT = 0.98, 0.5, 0.3, 0.5
#: A document is kept if at least this share of its characters is in content lines.
CONTENT_SHARE = 0.5
#: Fixed values of the base rules: symbols, fewest words, most repeated words in per cent.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 10, 20
WHITE_SPACE = " \t\n\x0b\x0c\r"

VERDICTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"
N_FEATURES = 11


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """Words in windows of span words that occur twice or more."""
    if len(words) <= span:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - span + 1
    windows = np.zeros(n, np.uint64)
    for i in range(span):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + span, -1)
    return int((np.cumsum(step) > 0).sum())


_upper: list[np.ndarray] = []


def upper_case(text: str, span: int = 1 << 20) -> int:
    """Upper-case characters of a whole text, counted by a table of code points, span characters at a time."""
    if not _upper:
        _upper.append(np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000))
    codes = (np.frombuffer(text[at : at + span].encode("utf-32-le", "surrogatepass"), np.uint32) for at in range(0, len(text), span))
    return sum(int(np.count_nonzero(_upper[0][c])) for c in codes)


def line_features(lines: list[str]) -> np.ndarray:
    """Statistics of each line, in ranges near 0 to 1; the last is constant."""
    rows = np.zeros((len(lines), N_FEATURES))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        distinct = len(set(words))
        letters = sum(map(len, words)) or 1
        rows[i] = (
            n == 0,
            min(n, 40) / 40,
            n > 0 and line in seen,
            distinct / (n or 1),
            upper_case(line) / size,
            min(1.0, 4 * sum(map(line.count, SYMBOLS)) / letters),
            min(1.0, 4 * line.count("!") / letters),
            min(1.0, sum(map(line.count, "0123456789")) * 4 / letters),
            line.rstrip()[-1:] in (".", "?", "!", ":", '"'),
            min(1.0, letters / (n or 1) / 12),
            1.0,
        )
        seen.add(line)
    return rows


def logistic(x: np.ndarray, share: np.ndarray, weights: np.ndarray, penalty: float = PENALTY, steps: int = 8) -> np.ndarray:
    """Weights of greatest penalised likelihood of shares between 0 and 1, by Newton's method."""
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share - p) - penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(weights))
        change = np.linalg.solve(curve, slope)
        weights = weights + change
        if np.abs(change).max() < 1e-6:
            break
    return weights


def fit(chains: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x labels) and steps (labels x labels) from chains of line features, each with its document's label.

    Every chain counts as a whole. Without chains of both labels everything is content.
    """
    if len({label for _, label in chains}) < 2:
        weights = np.zeros((N_FEATURES, 2))
        weights[-1, 1] = 1.0
        return weights, np.zeros((2, 2))
    x = np.concatenate([c for c, _ in chains]).astype(np.float64)
    good = np.repeat([label > 0 for _, label in chains], [len(c) for c, _ in chains])
    share, weights, bad = np.where(good, GOOD_CONTENT, 0.1), np.zeros(N_FEATURES), 0.1
    log_odds = lambda p: np.log(p / (1 - p))
    for _ in range(ROUNDS):  # what a line looks like, against how common content is in documents of its label
        weights = logistic(x, share, weights)
        evidence = x @ weights - log_odds(share.mean())
        share = 1 / (1 + np.exp(-np.clip(evidence + np.where(good, log_odds(GOOD_CONTENT), log_odds(bad)), -30, 30)))
        bad = float(np.clip(share[~good].mean(), 0.02, BAD_CONTENT))
    labels = (x @ weights > 0).astype(int)
    last = np.cumsum([len(c) for c, _ in chains])[:-1] - 1
    inside = np.ones(len(labels) - 1, bool)
    inside[last] = False
    pairs = np.bincount((2 * labels[:-1] + labels[1:])[inside], minlength=4).reshape(2, 2) + 1.0
    step = np.log(pairs / pairs.sum()) - np.log(np.outer(pairs.sum(1), pairs.sum(0)) / pairs.sum() ** 2)
    return np.stack([np.zeros(N_FEATURES), weights], axis=1), STEP_WEIGHT * step


def viterbi(emission: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Most likely labels (1: content) of a chain."""
    (best0, best1), back = emission[0].tolist(), []
    (s00, s01), (s10, s11) = step.tolist()
    for e0, e1 in emission[1:].tolist():
        stay0, turn0, turn1, stay1 = best0 + s00, best1 + s10, best0 + s01, best1 + s11
        back.append((turn0 > stay0, stay1 >= turn1))
        best0, best1 = max(stay0, turn0) + e0, max(turn1, stay1) + e1
    labels = [int(best1 >= best0)]
    for from0, from1 in reversed(back):
        labels.append(int(from1 if labels[-1] else from0))
    return np.array(labels[::-1])


def labelled_chains(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[tuple[np.ndarray, int]]:
    """Line features of a bounded sample of labelled documents, those of the smallest text hash, each distinct text once for a label.

    A document of several labels has its highest one. Texts are chosen by ids, hashes and lengths alone, SAMPLE_DOCS at most and
    together SAMPLE_CHARS; of those the features of all lines go to the driver.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.length(text_col).cast("bigint").alias("n"))
    found = texts.select("id", "h", "n").join(marks, "id").groupBy("h", "quality").agg(F.min("id").alias("id"), F.min("n").alias("n")).orderBy("h", "quality").limit(SAMPLE_DOCS).collect()
    chosen, size = [], 0
    for r in found:
        if size + r["n"] <= SAMPLE_CHARS:
            size += r["n"]
            chosen.append((r["id"], r["h"], r["quality"]))
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame(chosen, f"id {dict(texts.dtypes)['id']}, h bigint, quality int")
    rows = texts.join(F.broadcast(few), ["id", "h"]).select("h", "text", "quality")
    schema = pa.schema([("h", pa.int64()), ("quality", pa.int32()), ("flat", pa.list_(pa.float32()))])

    def run(batches):
        for part in slices(batches):
            flat = [line_features(t.split("\n")).reshape(-1).astype(np.float32) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(flat, schema.field(2).type)], schema=schema)

    rows = rows.mapInArrow(run, "h bigint, quality int, flat array<float>").dropDuplicates(["h", "quality"]).orderBy("h", "quality").collect()
    return [(np.array(r["flat"], np.float32).reshape(-1, N_FEATURES), int(r["quality"] > 0)) for r in rows]


def judge_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id (with carry: row, a struct of all columns), base counts, base_failed, kept and content_share of every whole text, one row per row of docs.

    Words are runs without ASCII white space. A text fails the base rules with fewer than LEAST_WORDS words or more than
    MOST_REPEATED per cent of its words in repeated 5-word windows; it is kept if it doesn't fail them and at least
    CONTENT_SHARE of its characters are in lines that the field calls content. Null and empty texts have no words and fail.
    """
    weights, step = fit(labelled_chains(docs, labels, id_col, text_col))
    first, first_ddl = carried(docs, id_col, carry)
    schema = arrow_schema(VERDICTS)

    def run(batches):
        for part in slices(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in part.column(1).to_pylist():
                words = text.encode().split()
                lines = text.split("\n")
                marked = [line for line in lines if line.strip(WHITE_SPACE)]
                repeated = repeated_words(words)
                failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
                content = viterbi(line_features(lines) @ weights, step)
                sizes = np.array([len(line) for line in lines])
                share = float(sizes[content == 1].sum() / max(1, sizes.sum()))
                row = (len(words), len(text) - sum(map(text.count, WHITE_SPACE)), sum(map(text.count, SYMBOLS)), len(marked) - len(set(marked)), repeated, failed, not failed and share >= CONTENT_SHARE, share)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(columns, schema, strict=True))], names=[part.schema.names[0], *schema.names])

    return docs.select(first, text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, f"{first_ddl}, {VERDICTS}")
