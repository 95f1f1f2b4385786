"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

Documents are reduced to profiles, one for each part and set of failed filters, with weights (how many documents, how many of
them good or toxic). A min-plus product of the profiles' mask matrix (0 where a filter fails, else infinite) with the orders'
inverse permutations (the step at which an order applies a filter) gives the step that removes a profile; the weights are then
scattered to orders and steps.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import save, text_or_empty

#: Fixed values of the five text filters: fewest words, distinct words and capitals in per cent, symbols; words' pattern.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS, WORD = 100, 80, 10, "[#$%&*|]", r"[^\x20\x09-\x0D]+"
#: Names of the five text filters in the order of their bits.
FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES)


def orders(filters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the inverse permutations: filters x orders, the step (from 1) of a filter in an order."""
    names = sorted("".join(p) for p in permutations(filters))
    return names, np.array([[name.index(f) + 1 for name in names] for f in filters])


def removal_steps(fails: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Min-plus product: for profiles x filters (true: fails) and filters x orders, the step that removes a profile, one past the last if none does."""
    never = len(steps) + 1
    mask = np.where(fails, 0, never)
    return np.minimum((mask[:, :, None] + steps[None]).min(axis=1), never)


def scatter(fails: np.ndarray, weights: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """The measures as orders x steps, from profiles x filters and the profiles' documents, good and toxic ones (columns of weights)."""
    names, places = orders(filters)
    n, f = len(names), len(filters)
    removed_at = removal_steps(fails, places)
    cells = (np.arange(n) * (f + 1) + removed_at - 1).reshape(-1)  # the last of f + 1 steps: kept by all
    lost = [np.bincount(cells, np.broadcast_to(w[:, None], removed_at.shape).reshape(-1), n * (f + 1)).astype(np.int64).reshape(n, f + 1)[:, :f] for w in weights.T.astype(np.float64)]
    owner = np.array([[filters.index(x) for x in name] for name in names])  # the filter of a step
    failing = (fails * weights[:, :1]).sum(axis=0)
    alone = (fails & (fails.sum(axis=1, keepdims=True) == 1)) * weights[:, :1]
    total = np.bincount(owner.reshape(-1), lost[0].reshape(-1).astype(np.float64), f).astype(np.int64)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(lost[0], axis=1), "removed": lost[0], "redundant": failing[owner] - lost[0],
        "unique_fails": alone.sum(axis=0)[owner], "good_lost": lost[1], "toxic_lost": lost[2], "shapley": total[owner],
    }


def audit(profiles: DataFrame, filters: str) -> DataFrame:
    """The audit of profiles: part, mask (bit i: filter i fails), n, good, toxic; one row per part, order and step.

    Counts of up to 2^53 documents are exact. Profiles of equal part and mask are added up first, so that a part is one group
    of at most 2^len(filters) rows.
    """
    names, _ = orders(filters)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fails = (part["mask"].to_numpy()[:, None] >> np.arange(len(filters)) & 1).astype(bool)
        found = scatter(fails, part[["n", "good", "toxic"]].to_numpy(np.int64), filters)
        steps = len(filters)
        columns = {"part": part["part"].iloc[0], "filter_order": np.repeat(names, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))}
        return pd.DataFrame(columns | {m: found[m].reshape(-1) for m in MEASURES})

    summed = profiles.groupBy("part", "mask").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")))
    return summed.groupBy("part").applyInPandas(run, AUDIT)


def text_failures(text: Column) -> Column:
    """The bits of A to D for a text: few words, few distinct words, many capitals, a symbol."""

    def bits(words: Column) -> Column:
        n = F.size(words)
        few, alike = n < LEAST_WORDS, F.lit(100) * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n
        capitals = F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text)
        return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate((few, alike, capitals, text.rlike(SYMBOLS)))), F.lit(0))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), bits)[0]


def document_profiles(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic of documents under the five text filters, with labels (doc_id, quality, toxic).

    Texts are told apart by their SHA-256. A document fails E if a smaller id has its text; rows of the smallest id never do,
    nor do rows without an id. An id with several labels is good (toxic) if one of them says so. Texts' facts, a few bytes
    each, are written once; what is joined has the id in its key, so that many copies of a text are many keys.
    """
    text = text_or_empty(F.col(text_col))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    facts = save(docs.select(F.col(id_col).cast("bigint").alias("id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("bits")), "filter-facts")
    first = facts.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(0).alias("copy"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    named = facts.where("id is not null").join(first, ["digest", "id"], "left").join(marks, "id", "left")
    named = named.select("part", "bits", F.coalesce("copy", F.lit(1 << FILTERS.index("E"))).alias("copy"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = named.unionByName(facts.where("id is null").select("part", "bits", *(F.lit(0).alias(c) for c in ("copy", "good", "toxic"))))
    return rows.groupBy("part", (F.col("bits") + F.col("copy")).alias("mask")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and MEASURES (longs) of the five text filters over whole documents.

    Null texts count as empty and null languages as the part ''. Empty texts have no words: they fail A, not B or C. All 120
    orders and 5 steps of a part are given, with zeros; an empty table has no parts.
    """
    return audit(document_profiles(docs, labels), FILTERS)
