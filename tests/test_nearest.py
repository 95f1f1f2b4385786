import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import nearest as N


def brute(questions, rows, k, same=False):
    out = {}
    for s, i, v in questions:
        if v is None or not all(x is not None and np.isfinite(x) for x in v) or not v:
            continue
        got = []
        for t, j, w in rows:
            if s != t or w is None or len(w) != len(v) or (same and i == j) or not all(x is not None and np.isfinite(x) for x in w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            got.append((-(round(float(a @ b / norm), 9) if norm else 0.0), j))
        for rank, (score, j) in enumerate(sorted(got)[:k], 1):
            out[i, rank] = (j, round(-score, 6))
    return out


def made(spark, rows, name):
    rows = [(s, i, v if v is None else [x if x is None else float(x) for x in v]) for s, i, v in rows]
    return spark.createDataFrame(rows, f"scope string, {name} long, embedding array<double>")


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, round(r.similarity, 6)) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("QUERY_ROWS", 8), ("VECTOR_ROWS", 16), ("PIVOTS", 12), ("QUERY_SUMMARIES", 4), ("VECTOR_SUMMARIES", 8)):
        monkeypatch.setattr(N, name, value)


def test_clusters_are_pruned_and_exact(spark, small_blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [("a", i, (centres[i % 12] + rng.normal(size=24) * 0.05).tolist()) for i in range(600)]
    asked = [r for r in rows if r[1] % 25 == 0]
    figures = []
    got = found(N.nearest(made(spark, asked, "query_id"), made(spark, rows, "vec_id"), 5, same=True, figures=figures))
    assert got == brute(asked, rows, 5, same=True)
    assert figures[2] < 0.3 * figures[0], figures


def test_spread_vectors_ties_and_faults(spark, small_blocks):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [("a", 300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(60)]  # repeated rows: ties by id, over several blocks
    rows += [("a", 400, [0.0] * 6), ("a", 401, None), ("a", 402, []), ("a", 403, [1.0, None, 0, 0, 0, 0]), ("a", 404, [float("nan")] * 6), ("a", 405, [1.0, 2.0]), ("a", 406, [1e-200] * 6), ("a", 407, [float("inf")] * 6)]
    asked = [("a", 1, [1.0, 0, 0, 0, 0, 0]), ("a", 2, [0.0] * 6), ("b", 3, rng.normal(size=6).tolist()), ("a", 4, [2.0, 1.0]), ("c", 5, [1.0] * 6), ("a", 6, None), ("a", 7, [1e200] * 6)]
    got = found(N.nearest(made(spark, asked, "query_id"), made(spark, rows, "vec_id"), 7))
    plain = [(s, i, v if v is None or i not in (406, 7) else [1.0] * 6) for s, i, v in rows]
    assert got == brute([(s, i, [1.0] * 6 if i == 7 else v) for s, i, v in asked], plain, 7)
    assert [got[1, k][0] for k in range(1, 8)] == list(range(300, 307))
    assert got[4, 1] == (405, round(4 / 5, 6)) and (4, 2) not in got


def test_empty_tables_and_few_rows(spark, small_blocks):
    none = made(spark, [], "vec_id")
    asked = made(spark, [("a", 1, [1.0, 0.0])], "query_id")
    assert N.nearest(asked, none, 3).count() == 0
    two = made(spark, [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0])], "vec_id")
    assert N.nearest(made(spark, [], "query_id"), two, 3).count() == 0
    assert found(N.nearest(asked, two, 3, same=True)) == {(1, 1): (2, 0.0)}
    ids = two.select("scope", F.struct("vec_id", F.lit("x").alias("name")).alias("vec_id"), "embedding")
    assert [r.vec_id.name for r in N.nearest(asked, ids, 1).collect()] == ["x"]
