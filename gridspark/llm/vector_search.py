"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector's segment means and deviations bound its inner product with another from above (equivalently its distance from
below): within a segment of l components, <q, x> <= l * mean_q * mean_x + l * dev_q * dev_x by Cauchy-Schwarz. Bounds are
taken coarse to fine: first a few long segments, then more and more segments of one component and a last long one. Each level is
computed for the survivors of the level before; only what survives them all gets an exact integer product.

Segments are of vectors turned so that what varies most comes first. That changes no inner product, and makes the first
segments say most; exact products are of the integer components themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Vectors of a candidate block and of a query block, and candidates that are looked at between two rises of the floors.
CANDIDATES, QUERIES, STEP = 16384, 4096, 1024
#: Vectors that the turn is taken from and that give queries their first floors: a bounded sample by hash.
SAMPLE = 1024
#: Resolutions, coarse to fine: share of the components that are segments of their own, and segments of the rest.
LEVELS = ((0.0, 4), (0.25, 4), (0.75, 1), (0.875, 1))
#: Share of pairs below which a level's bounds are taken for the survivors alone.
DENSE_SHARE = 0.05

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def turned(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns hold less and less of the sample's spread."""
    x = sample.astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1].copy()


def segment_features(vectors: np.ndarray, level: tuple[float, int]) -> np.ndarray:
    """Rows whose inner product with another row's features bounds the (turned) vectors' inner product from above."""
    dim = vectors.shape[1]
    single = int(level[0] * dim)
    columns = [vectors[:, :single]]
    for part in np.array_split(vectors[:, single:], min(level[1], max(1, dim - single)), axis=1):
        if part.shape[1]:
            root = np.sqrt(part.shape[1])
            columns += [(part.mean(axis=1) * root)[:, None], (part.std(axis=1) * root)[:, None]]
    return np.concatenate(columns, axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows with each other; by floating point where no sum can leave what that holds exactly."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**52:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def exact_pairs(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", q[row[i : i + 65536]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0, np.int64)])


def top_k_block(query_ids, queries, floors, vec_ids, vectors, axes, k: int, survivors: list | None = None):
    """Each query's k best of one candidate block, by segment bounds and exact products of the survivors.

    floors: scores that a query's k-th best is known to reach; they rise as candidates are seen. survivors, if given, gets the
    number of pairs and of those that survive each level.
    """
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[order], vectors[order]
    turn = lambda x: x.astype(np.float64) @ axes
    of_query, of_vector = turn(queries), turn(vectors)
    reach = np.sqrt(np.square(of_query).sum(1)) * np.sqrt(np.square(of_vector).sum(1)).max(initial=0)
    slack = 1e-9 * reach + 1e-6
    levels = [(segment_features(of_query, level), segment_features(of_vector, level)) for level in LEVELS]
    best_score = np.full((len(query_ids), k), np.iinfo(np.int64).min)
    best_id = np.full((len(query_ids), k), -1)
    taken = np.zeros(len(query_ids), np.int64)
    floors = floors.astype(np.float64).copy()
    counts = np.zeros(len(LEVELS) + 1, np.int64)
    for start in range(0, len(vec_ids), STEP):
        own, ids = slice(start, start + STEP), vec_ids[start : start + STEP]
        limit = floors - slack
        alive = query_ids[:, None] != ids[None, :]
        counts[0] += alive.size
        row, col = None, None
        for i, (of_q, of_x) in enumerate(levels, 1):
            if row is None:  # bounds of all pairs at once, until few are left
                alive &= of_q @ of_x[own].T >= limit[:, None]
                counts[i] += (left := int(alive.sum()))
                if left < DENSE_SHARE * alive.size or i == len(levels):
                    row, col = np.nonzero(alive)
            else:
                keep = [np.einsum("ij,ij->i", of_q[row[at : at + 65536]], of_x[own][col[at : at + 65536]]) >= limit[row[at : at + 65536]] for at in range(0, len(row), 65536)]
                keep = np.concatenate(keep or [np.zeros(0, bool)])
                row, col = row[keep], col[keep]
                counts[i] += len(row)
        if not len(row):
            continue
        score = exact_pairs(queries, vectors[own], row, col)
        # the best so far and the new ones, in order of score and then of id
        some = np.unique(row)
        held, place = np.nonzero(np.arange(k)[None, :] < taken[some][:, None])
        all_row = np.concatenate([row, some[held]])
        all_score, all_id = np.concatenate([score, best_score[some[held], place]]), np.concatenate([ids[col], best_id[some[held], place]])
        at = np.lexsort((all_id, -all_score, all_row))
        all_row, all_score, all_id = all_row[at], all_score[at], all_id[at]
        rank = np.arange(len(all_row)) - np.searchsorted(all_row, all_row)
        first = rank < k
        best_score[all_row[first], rank[first]], best_id[all_row[first], rank[first]] = all_score[first], all_id[first]
        taken[some] = np.minimum(k, np.bincount(all_row, minlength=len(query_ids))[some])
        full = some[taken[some] == k]
        floors[full] = np.maximum(floors[full], best_score[full, k - 1])
    if survivors is not None:
        survivors.append(counts)
    row, rank = np.nonzero(np.arange(k)[None, :] < taken[:, None])
    return query_ids[row], best_id[row, rank], best_score[row, rank]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of highest integer inner product for every query row, exact: query_id, rank, vec_id, score.

    Components become floor(scale * x). Null ids, null vectors and vectors with a null or non-finite component take no part;
    vectors are compared with those of equal length only, empty ones with none. Rows of one id are one vector, the least by its
    components in order, which is a query if one of the rows is. A row is not a candidate for a query of its own id.
    Ties go to the smaller id; a query with fewer candidates gets all of them.

    Query rows and candidate rows meet in pairs of bounded blocks, so no task holds more than one block of each. A query starts
    from its k-th best score among a bounded sample of rows, the same in all blocks.
    """
    clean = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = clean.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite).select(
        "vec_id", "is_query", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("components")
    )
    rows = whole.groupBy("vec_id").agg(F.min("components").alias("components"), F.bool_or("is_query").alias("is_query")).select("vec_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.size("components").alias("dim"), "components")
    n = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    c_blocks, q_blocks = max(1, -(-n["n"] // CANDIDATES)), max(1, -(-n["q"] // QUERIES))
    axes: dict[int, np.ndarray] = {}
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE).collect():  # at most SAMPLE rows
        by_dim.setdefault(r["dim"], []).append(r)
    for dim, found in by_dim.items():
        seeds[dim] = np.array([r["vec_id"] for r in found], np.int64), np.array([r["components"] for r in found], np.int64)
        axes[dim] = turned(seeds[dim][1])

    def first_floors(batches):
        for batch in batches:
            ids, dims, flat = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            floors = np.full(batch.num_rows, -np.inf)
            for dim in set(dims) & set(seeds):
                at = np.flatnonzero(np.array(dims) == dim)
                seed_ids, seed = seeds[dim]
                score = exact_scores(np.array(flat.take(pa.array(at)).to_pylist(), np.int64), seed).astype(np.float64)
                score[ids[at][:, None] == seed_ids[None, :]] = -np.inf
                if len(seed_ids) >= k:
                    floors[at] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], names=["vec_id", "dim", "components", "floor"])

    queries = rows.where("is_query").select("vec_id", "dim", "components").mapInArrow(first_floors, "vec_id bigint, dim int, components array<bigint>, floor double")
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = rows.select("dim", own(c_blocks).alias("cb"), every(q_blocks).alias("qb"), "vec_id", "components")
    asked = queries.select("dim", every(c_blocks).alias("cb"), own(q_blocks).alias("qb"), "vec_id", "components", "floor")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        dim = left["dim"][0].as_py()
        q, x = _matrix(right["components"], right.num_rows), _matrix(left["components"], left.num_rows)
        found = top_k_block(right["vec_id"].to_numpy(), q, right["floor"].to_numpy(), left["vec_id"].to_numpy(), x, axes.get(dim, np.eye(dim)), k)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], schema=FOUND)

    keys = ["dim", "cb", "qb"]
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
