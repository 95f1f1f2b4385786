"""Nearest vectors by cosine for many questions at once, exactly, without meeting blocks that are too far away.

On unit vectors the cosine is 1 - d*d / 2 of the distance d, so that the triangle inequality holds for d. Rows and questions are put into
blocks around pivots; a block knows the least and greatest distance of its members to each pivot. From two blocks' envelopes follow
bounds on all distances between them. Only pairs of blocks that can hold one of a question's nearest rows are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.lineage import cut

#: Pivots; rows of a block of questions and of vectors; width of the rings around a pivot. None of them changes results.
PIVOTS, QUERY_ROWS, VECTOR_ROWS, RING = 32, 256, 2048, 0.1
#: Keys that a ring's rows are dealt to.
SALTS = 64
#: Blocks' summaries that meet in one task.
QUERY_SUMMARIES, VECTOR_SUMMARIES = 1024, 4096
#: Digits by which similarities are ranked, and what bounds allow for rounding: of distances, and of similarities.
DIGITS, SLACK, LOOSE = 9, 1e-7, 1e-8


def usable(v: Column) -> Column:
    """Whether an array is a vector: neither null nor empty, no null, NaN or infinite component."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(v: Column, spare: tuple[float, float]) -> Column:
    """A vector at length 1 with two more components, zeros but for a vector without length: that gets `spare`, at right angles to all others."""

    @F.pandas_udf("array<double>")
    def unit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = [None] * len(part)
            sizes = part.map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.stack(part.iloc[at].to_list())
                most = np.abs(x).max(1, keepdims=True)  # first scaled, so that squares neither vanish nor overflow
                x = np.divide(x, most, out=np.zeros_like(x), where=most > 0)
                norm = np.sqrt(np.square(x).sum(1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                for i, row in zip(at, np.hstack([x, np.where(norm > 0, 0.0, np.array([spare]))]), strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return unit(F.when(usable(v), v.cast("array<double>")).otherwise(F.array(F.lit(0.0))))


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """n different vectors of the commonest size, those with the least hashes: a bounded sample that changes work only, not results."""
    sizes = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)
    some = rows.join(sizes.select("size"), "size", "left_semi").select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n)
    return np.array([r.v for r in some.collect()], np.float64)


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with their distances to the pivots (`far`, empty for other sizes), the nearest one (`cell`) and the ring around it."""

    @F.pandas_udf("array<double>")
    def far(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = [[]] * len(part)
            fit = [i for i, v in enumerate(part) if len(pivots) and len(v) == pivots.shape[1]]
            if fit:
                got = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (np.stack(part.iloc[fit].to_list()) @ pivots.T)))
                for i, x in zip(fit, got, strict=True):
                    out[i] = x
            yield pd.Series(out, dtype=object)

    near = F.array_min("far")
    return rows.withColumn("far", far("v")).withColumns({"cell": F.coalesce(F.array_position("far", near), F.lit(0)).cast("int"), "ring": F.coalesce(F.floor(near / RING), F.lit(0)).cast("int")})


def _blocks(rows: DataFrame, most: int, p: str) -> DataFrame:
    """Blocks of about `most` members of one cell and ring: scope, size, key, n, ids, v (all vectors in a row), low and high (to each pivot).

    A full ring is dealt by ids' hashes, so that a cell that holds everything is many blocks; its rows also meet their number of
    blocks under SALTS keys, not under one.
    """
    at = ["scope", "size", "cell", "ring"]
    ways = rows.groupBy(*at).agg(F.ceil(F.count("*") / most).cast("int").alias("ways"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.lit(SALTS)).cast("int"))
    dealt = salted.join(ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*at, "salt"]).withColumn("way", F.pmod(F.xxhash64("id"), "ways"))
    x = F.sort_array(F.collect_list(F.struct("id", "v", "far")))
    packed = dealt.groupBy(*at, "way").agg(x.alias("x"))
    count = F.size(F.col("x")[0]["far"])
    edge = lambda f: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: f(F.transform("x", lambda m: m["far"][i])))).otherwise(F.array().cast("array<double>"))
    key = F.xxhash64(*at, "way")
    return packed.select("scope", "size", F.struct(*at[2:], "way").alias(f"{p}_at"), key.alias(f"{p}_key"), F.size("x").alias(f"{p}_n"), F.col("x.id").alias(f"{p}_ids"), F.flatten("x.v").alias(f"{p}_v"), edge(F.array_min).alias(f"{p}_low"), edge(F.array_max).alias(f"{p}_high"))


def _bounded(q: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs of blocks of a scope with bounds on all distances between them; summaries meet in pairs of bounded groups."""
    n_q, n_r = (max(1, -(-df.count() // most)) for df, most in ((q, QUERY_SUMMARIES), (r, VECTOR_SUMMARIES)))
    own = lambda key, n: F.pmod(F.col(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("scope", "size", "q_at", "q_key", "q_low", "q_high", own("q_key", n_q).alias("qb")).withColumn("rb", every(n_r))
    right = r.select("scope", "size", "r_at", "r_key", "r_n", "r_low", "r_high", own("r_key", n_r).alias("rb")).withColumn("qb", every(n_q))
    apart = F.array_max(F.concat(F.zip_with("q_low", "r_high", lambda a, b: a - b), F.zip_with("r_low", "q_high", lambda a, b: a - b)))
    least = F.greatest(F.coalesce(apart, F.lit(0.0)) - SLACK, F.lit(0.0))
    most = F.least(F.coalesce(F.array_min(F.zip_with("q_high", "r_high", lambda a, b: a + b)), F.lit(2.0)) + SLACK, F.lit(2.0))
    return left.join(right, ["scope", "size", "qb", "rb"]).select("scope", "size", "q_at", "r_at", "q_key", "r_key", "r_n", (1 - least * least / 2 + LOOSE).alias("best"), (1 - most * most / 2 - LOOSE).alias("sure"))


def _scored(pairs: DataFrame, q: DataFrame, r: DataFrame, top_k: int, same: bool) -> DataFrame:
    """query_id, vec_id, similarity: of each pair of blocks the top_k rows of each question. Row blocks travel once, questions with their pairs."""
    on = lambda p: ["scope", "size", f"{p}_at", f"{p}_key"]
    met = pairs.select("scope", "size", "q_at", "q_key", "r_at", "r_key").join(q.select(*on("q"), "q_ids", "q_v"), on("q")).join(r.select(*on("r"), "r_ids", "r_v"), on("r"))
    kinds = {name: dict(df.select(F.col(f"{p}_ids")[0].alias("x")).dtypes)["x"] for name, df, p in (("query_id", q, "q"), ("vec_id", r, "r"))}

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = {p: batch.column(f"{p}_ids")[i].values for p in "qr"}
                a, b = (batch.column(f"{p}_v")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids[p]), -1) for p in "qr")
                got = np.round(a @ b.T, DIGITS) + 0.0
                if same:  # a question's own row is no answer
                    place = {x: j for j, x in enumerate(ids["r"].to_pylist())}
                    for row, x in enumerate(ids["q"].to_pylist()):
                        if x in place:
                            got[row, place[x]] = -np.inf
                some = np.argsort(-got, axis=1, kind="stable")[:, :top_k]
                value = np.take_along_axis(got, some, 1).reshape(-1)
                keep = np.flatnonzero(value > -np.inf)
                at_q, at_r = np.repeat(np.arange(len(a)), some.shape[1])[keep], some.reshape(-1)[keep]
                yield pa.RecordBatch.from_arrays([ids["q"].take(pa.array(at_q)), ids["r"].take(pa.array(at_r)), pa.array(value[keep])], ["query_id", "vec_id", "similarity"])

    return met.select("q_ids", "q_v", "r_ids", "r_v").mapInArrow(score, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, similarity double")


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top_k)


def nearest(queries: DataFrame, rows: DataFrame, top_k: int, same: bool = False, figures: list | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: each question's top_k rows by cosine within its scope, rounded to DIGITS; ties by vec_id.

    queries: scope, query_id, embedding; rows: scope, vec_id, embedding. Vectors of a different size don't meet. A vector without
    length has cosine 0 with all; null and empty vectors, those with a null, NaN or infinite component, and rows with a null id or scope
    take no part. Fewer than top_k rows in a scope are all returned. same: both sides are one table, a question's own row is left out.
    Ids are unique within their table. figures, if given, gets the numbers of block pairs: all, first ones, and those met in the end.
    """
    def prepared(df: DataFrame, name: str, spare: tuple[float, float]) -> DataFrame:
        fine = df.where(usable(F.col("embedding")) & F.col(name).isNotNull() & F.col("scope").isNotNull())
        return fine.select("scope", F.size("embedding").alias("size"), F.col(name).alias("id"), _unit(F.col("embedding"), spare).alias("v"))

    every = prepared(rows, "vec_id", (1.0, 0.0))
    pivots = _pivots(every, PIVOTS)
    q = cut(_blocks(_placed(prepared(queries, "query_id", (0.0, 1.0)), pivots), QUERY_ROWS, "q"))
    r = cut(_blocks(_placed(every, pivots), VECTOR_ROWS, "r"))
    pairs = cut(_bounded(q, r))
    # first the blocks that are sure to hold enough rows nearby; with them each question has a floor
    block = ["scope", "size", "q_at", "q_key"]
    nearby = W.Window.partitionBy(*block).orderBy(F.desc("sure"), F.desc("best"), "r_key", "r_at")
    wanted = top_k + int(same)
    ordered = pairs.withColumn("before", F.sum("r_n").over(nearby.rowsBetween(W.Window.unboundedPreceding, -1)))
    marked = ordered.withColumn("first", F.coalesce(F.col("before"), F.lit(0)) < wanted).drop("before")
    first = cut(_best(_scored(marked.where("first"), q, r, top_k, same), top_k))
    kth = first.where(F.col("rank") == top_k).select("query_id", F.col("similarity").alias("floor"))
    members = q.select(*block, F.explode("q_ids").alias("query_id"))
    floors = members.join(kth, "query_id", "left").groupBy(*block).agg(F.min(F.coalesce("floor", F.lit(-2.0))).alias("floor"))
    left = cut(marked.where("not first").join(floors, block).where(F.col("best") >= F.col("floor")).select(*block, "r_at", "r_key"))
    if figures is not None:
        n, n_first = pairs.count(), marked.where("first").count()
        figures += [n, n_first, n_first + left.count()]
    return _best(reduce(DataFrame.unionByName, [first.drop("rank"), _scored(left, q, r, top_k, same)]), top_k).select("query_id", "vec_id", "similarity", "rank")
