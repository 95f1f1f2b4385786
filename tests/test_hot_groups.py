"""Operators on groups that hold everything: runs over band borders, names that are all alike, medians of one group."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridspark.operators import relational, relations, sourcing
from gridspark.operators.reads import BAND


def plain_runs(places):
    """Runs of two or more down, then across what is left, cell by cell."""
    left, out = set(places), []
    for row, col in sorted(places, key=lambda p: (p[1], p[0])):
        if (row - 1, col) not in places and (row + 1, col) in places:
            end = row
            while (end + 1, col) in places:
                end += 1
            out.append((row, col, end, col, "rows"))
            left -= {(r, col) for r in range(row, end + 1)}
    for row, col in sorted(left):
        if (row, col - 1) not in left:
            end = col
            while (row, end + 1) in left:
                end += 1
            out.append((row, col, row, end, "columns" if end > col else "single"))
    return sorted(out)


def test_runs_over_bands(spark):
    rng = random.Random(6)
    places = {(r, 1) for r in range(5, 4 * BAND + 3)} | {(r, 2) for r in range(BAND, 2 * BAND)} | {(r, 3) for r in (BAND - 1, BAND, 2 * BAND - 1, 3 * BAND)} | {(BAND - 1, 4), (BAND, 5), (BAND, 6), (0, 7), (1, 7)}
    places |= {(rng.randint(BAND - 30, BAND + 30), rng.randint(8, 14)) for _ in range(250)}
    cells = spark.createDataFrame([("k", *p) for p in places] + [("k", 5, 1)], "k string, row bigint, col bigint")
    found = sorted((r.r1, r.c1, r.r2, r.c2, r["shape"]) for r in relations.runs(cells, ["k"]).collect())
    assert found == plain_runs(places)


def plain_ids(names, stem="sheet"):
    used, out = set(), []
    for name in names:
        base = re.sub(r"[^0-9A-Za-z]+", "_", name or "").strip("_").lower() or stem
        base = f"{stem}_{base}" if base[0].isdigit() else base
        made, n = base, 2
        while made in used:
            made, n = f"{base}_{n}", n + 1
        used.add(made)
        out.append(made)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_ids(spark, seed):
    rng = random.Random(seed)
    books = {w: [rng.choice(("x", "X", "x_2", "x 2", "x_2_2", "x_2_3", "x_3", "y", "y_10", "Y!", "", None, "2", "sheet", "sheet_2", "é", "z_1_2", "z", "_z_")) for _ in range(40)] for w in ("a", "b", None)}
    books["c"] = ["same"] * 300
    rows = [(w, i, name) for w, names in books.items() for i, name in enumerate(names)]
    found = sourcing.unique_ids(spark.createDataFrame(rows, "wb string, ord int, name string").repartition(3), ["wb"], "name", "ord").collect()
    for w, names in books.items():
        assert [r.id for r in sorted((r for r in found if r.wb == w), key=lambda r: r.ord)] == plain_ids(names)
    assert len(found) == len(rows)


@pytest.mark.parametrize("most", [1, 50])
def test_medians_in_rounds(spark, most):
    """One group of nearly all rows, one of a heavy value, few values, blanks; whatever bound sends groups to the rounds."""
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4001)] + [("even", float(rng.randint(0, 9))) for _ in range(1000)] + [("heavy", 5.0)] * 700 + [("heavy", float(i)) for i in range(60)] + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: r.v for r in relational.exact_medians(df, ["k"], "v", most_rows=most).collect()}
    want = {r.k: r.v for r in df.groupBy("k").agg(F.median("v").alias("v")).collect()}
    assert found == want
    table = relational.groupby_table(df, "k", {"v": ["median", "count"]}, most_median_rows=most).collect()
    assert {r.k: r.v_median for r in table} == want and table[0].asDict().keys() == {"k", "v_median", "v_count"}
