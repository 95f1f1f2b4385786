"""Tables seen as sheets are longer than a workbook file's 1,048,576 rows."""

import random

from pyspark.sql import functions as F

from gridspark.functions import addressing as A
from gridspark.functions import formulas as X
from gridspark.operators import reads, relations


def test_addresses_beyond_a_files_last_row(spark):
    box = lambda text, **most: A.parse_box(F.lit(text), **most)
    got = spark.range(1).select(box("'a'!$B$1200001", last_row=A.ANY_ROW).alias("cell"), box("C72000000:A8", last_row=A.ANY_ROW).alias("range"), box("B1200001").alias("file")).first()
    assert tuple(got.cell) == ("a", 1200001, 2, 1200001, 2) and tuple(got.range) == (None, 8, 1, 72000000, 3) and got.file is None


def test_references_of_eight_digits():
    assert X.relative('=SUM(B72000001:E$72000001)&"D12345678"', 72000001, 7) == '=SUM([col_offset=-5,row_offset=0]:[col_offset=-2,$72000001])&"D12345678"'
    assert X.pieces_of("=D10000034*2")[0] == {"text": "D10000034", "r1": 10000034, "c1": 4, "r2": 10000034, "c2": 4}


def test_formulas_move_beyond_a_files_last_row(spark):
    moved = lambda raw, rows, cols: relations.shifted(F.lit(raw), F.lit(rows), F.lit(cols))
    got = spark.range(1).select(moved("=C1048576*B$2", 2, 1).alias("down"), moved("=A1", -1, 0).alias("up"), moved("=XFD1", 0, 1).alias("right")).first()
    assert tuple(got) == ("=D1048578*C$2", None, None)


def test_rows_in_areas_of_any_length(spark):
    """An area of 10^15 rows would be 10^12 bands of 1,024."""
    rng = random.Random(7)
    ends = [(1, 10**15), (5, 5), (1024, 65536 + 1023), (1, 4194304), (70000, 80000), *(tuple(sorted(rng.randint(1, 10 ** rng.randint(1, 15)) for _ in "ab")) for _ in range(40))]
    rows = sorted({max(1, e + d) for pair in ends for e in pair for d in (-1, 0, 1)})
    points = spark.createDataFrame([("w", r) for r in rows], "wb_id string, row bigint")
    areas = spark.createDataFrame([("w", i, a, b) for i, (a, b) in enumerate(ends)], "wb_id string, area int, r1 bigint, r2 bigint")
    found = sorted((r.row, r.area) for r in reads.rows_in_areas(points, areas, ["wb_id"]).collect())
    assert found == sorted((r, i) for r in rows for i, (a, b) in enumerate(ends) if a <= r <= b)
    assert reads.rows_in_areas(points, areas.where("area < 0"), ["wb_id"]).count() == 0


def test_formulas_of_a_table_of_any_length(spark):
    cells = spark.createDataFrame([("w", "s", 10**15 + i, 6, f"=D{10**15 + i}") for i in range(7)] + [("w", "s", 2, 9, "=A1")], "wb_id string, sheet string, row bigint, col int, raw string")
    tables = spark.createDataFrame([("w", "s", "t", 1, 2, 10**15, 5)], "wb_id string, sheet string, table_id string, r1 bigint, c1 int, r2 bigint, c2 int")
    found = sorted((r.row - 10**15, r.col) for r in relations.assign_formulas(cells, tables).collect())
    assert found == [(i, 6) for i in range(6)]


def test_relations_of_a_table_of_any_length(spark):
    """Runs over borders of bands and blocks, down and across, single and broken formulas of two tables that share cells."""
    last = 64 * 1024 * 1024
    cells = [(r, 6, f"=D{r}*2") for r in (*range(1020, 1030), *range(last - 3, last + 2), 10**9)] + [(7, c, f"=SUM({x}1:{x}5)") for c, x in ((3, "C"), (4, "D"), (5, "E"))] + [(9, 5, "=#REF!+1"), (8, 5, "=#REF!+1"), (10**9, 4, "=SUM(A1:A3)")]
    frame = spark.createDataFrame([("w", "s", *c) for c in [*cells, cells[0]]], "wb_id string, sheet string, row bigint, col int, raw string")
    tables = spark.createDataFrame([("w", "s", "t", 1, 2, 10**15, 5), ("w", "s", "u", 1, 2, 20, 5)], "wb_id string, sheet string, table_id string, r1 bigint, c1 int, r2 bigint, c2 int")
    found = sorted((r.table_id, r.category, r.relation_id, r.r1, r.c1, r.r2, r.c2, r.raw) for r in relations.extract_relations(frame, tables).collect())
    same = [("invalid", "rel_invalid_ref_1", 8, 5, 8, 5, "=#REF!+1"), ("invalid", "rel_invalid_ref_2", 9, 5, 9, 5, "=#REF!+1")]
    assert found == [
        ("t", "aggregate", "rel_aggregate_sum_1", 10**9, 4, 10**9, 4, "=SUM(A1:A3)"), ("t", "cell", "rel_single_arithmetic_formula_1", 10**9, 6, 10**9, 6, "=D1000000000*2"), *(("t", *x) for x in same),
        ("t", "normal", "rel_repeat_column_formula_7_1", 7, 3, 7, 5, "=SUM(C1:C5)"), ("t", "normal", "rel_repeat_row_arithmetic_f_2", 1020, 6, 1029, 6, "=D1020*2"), ("t", "normal", "rel_repeat_row_arithmetic_f_3", last - 3, 6, last + 1, 6, f"=D{last - 3}*2"),
        *(("u", *x) for x in same), ("u", "normal", "rel_repeat_column_formula_7_1", 7, 3, 7, 5, "=SUM(C1:C5)"),
    ]


def test_tables_of_relations_in_tables_of_any_length(spark):
    """A known table's name wins; else tables of both block sizes that hold the range, of one sheet or of any."""
    tables = spark.createDataFrame([("w", "s", "long", 1, 1, 10**15, 9), ("w", "s", "short", 5, 1, 90, 9), ("w", "z", "other", 1, 1, 20, 9)], "wb_id string, sheet string, table_id string, r1 bigint, c1 int, r2 bigint, c2 int")
    asked = [("a", "w", "s", "gone", 10, 2, 12, 3), ("b", "w", None, None, 10, 2, 12, 3), ("c", "w", "s", "other", 10, 2, 12, 3), ("d", "w", "s", None, 10**14, 2, 10**14, 3), ("e", "w", "s", None, 80, 2, 91, 12), ("f", "w", "s", "gone", None, None, None, None)]
    asked = spark.createDataFrame(asked, "relation_key string, wb_id string, sheet string, table_id string, r1 bigint, c1 int, r2 bigint, c2 int")
    found = {r.relation_key: r.table_ids for r in relations.relation_tables(asked, tables).collect()}
    assert found == {"a": ["long", "short"], "b": ["long", "other", "short"], "c": ["other"], "d": ["long"], "e": [], "f": []}
