"""Operators against literal cases and simple properties."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import addressing as A
from gridspark.functions import text as T
from gridspark.operators import aggregates, filters, reads, relational, relations, retrieval, structures
from gridspark.sources import tables, workbooks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def boxes(spark, rows):
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(rows)], "i int, a1 int, a2 int, a3 int, a4 int, b1 int, b2 int, b3 int, b4 int")
    box = lambda p: A.box(*(F.col(f"{p}{k}") for k in range(1, 5)))
    return df.select("i", box("a").alias("a"), box("b").alias("b"))


def cells_of(b):
    return {(r, c) for r in range(b.r1, b.r2 + 1) for c in range(b.c1, b.c2 + 1)}


def test_a1(spark):
    rows = spark.range(1, 16385).select("id", A.column_letters(F.col("id")).alias("l")).select("id", "l", A.column_number(F.col("l")).alias("n")).collect()
    assert all(r.id == r.n for r in rows) and rows[0].l == "A" and rows[26].l == "AA" and rows[-1].l == "XFD"
    got = one(spark, *(A.parse_box(F.lit(x)).alias(f"x{i}") for i, x in enumerate(("C4:A2", "'a b'!$B$3", "B:D", "2:5", "x", "A1048577"))))
    assert tuple(got.x0)[1:] == (2, 1, 4, 3) and tuple(got.x1) == ("a b", 3, 2, 3, 2)
    assert tuple(got.x2)[1:] == (1, 2, A.LAST_ROW, 4) and tuple(got.x3)[1:] == (2, 1, 5, A.LAST_COLUMN) and got.x4 is None and got.x5 is None
    assert one(spark, A.box_a1(A.box(F.lit(2), F.lit(1), F.lit(4), F.lit(28))).alias("x")).x == "A2:AB4"


def test_range_algebra_keeps_cells(spark):
    rng = random.Random(1)
    side = lambda: rng.randint(1, 6)
    rows = [((side(), side(), side(), side()), (side(), side(), side(), side())) for _ in range(300)]
    made = boxes(spark, rows).select("a", "b", A.intersection(F.col("a"), F.col("b")).alias("x"), A.union(F.col("a"), F.col("b")).alias("u"), A.difference(F.col("a"), F.col("b")).alias("d"))
    for r in made.collect():
        a, b = cells_of(r.a), cells_of(r.b)
        assert (cells_of(r.x) if r.x else set()) == a & b
        assert set().union(*map(cells_of, r.u)) == a | b
        assert sum(len(cells_of(x)) for x in r.d) == len(a - b) and set().union(*map(cells_of, r.d)) == a - b


def people(spark):
    rows = [(3, 2, "text", "Iris"), (3, 4, "text", "Núñez"), (4, 2, "text", "Omar"), (4, 4, "text", "Løv"), (5, 2, "text", "Iris"), (5, 4, "text", "NUNEZ"), (3, 5, "time", None), (4, 5, "time", None), (5, 5, "time", None)]
    df = spark.createDataFrame(rows, "row bigint, col int, kind string, s string")
    born = F.when(F.col("kind") == "time", F.element_at(F.array(F.lit("1998-07-11"), F.lit("1998-07-30"), F.lit("1998-02-05")), (F.col("row") - 2).cast("int")))
    return df.select(F.lit("w").alias("wb_id"), F.lit("p").alias("sheet"), "row", "col", "kind", "s", F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), born.cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("formula"))


def test_filters(spark):
    cells = people(spark)
    pos = lambda s: sorted(r.pos for r in s.collect())
    named = filters.filter_values(cells, 3, 4, 5, 4, contains="nunez", ignore_accents=True)
    july = filters.filter_values(cells, 3, 5, 5, 5, predicate=lambda: F.month("ts") == 7)
    assert pos(named) == [3, 5] and pos(july) == [3, 4]
    assert pos(filters.combine("intersection", named, july)) == [3]
    assert pos(filters.combine("union", named, july)) == [3, 4, 5] and pos(filters.combine("difference", july, named)) == [4]
    assert [r.s for r in filters.read_selection(filters.combine("intersection", named, july), cells, 3, 2, 5, 2).collect()] == ["Iris"]
    assert pos(filters.filter_values(cells, 3, 5, 5, 5, between=("1998-07-01", "31/07/1998"))) == [3, 4]
    with pytest.raises(ValueError):
        filters.filter_values(cells, 3, 2, 5, 4, equals="x")
    with pytest.raises(ValueError):
        filters.filter_values(cells, 3, 2, 5, 2)
    with pytest.raises(Exception, match="compared"):
        filters.filter_values(cells, 3, 2, 5, 2, gt=3, strict=True).collect()


def test_relational(spark):
    plots = spark.createDataFrame([("k7", "oak"), ("k8", "elm"), ("k9", "yew")], "plot_id string, tree string")
    heights = spark.createDataFrame([("k8", 41), ("k9", 12), ("k5", 3)], "plot_id string, height int")
    assert sorted(map(tuple, relational.join_tables(plots, heights).collect())) == [("k8", "elm", 41), ("k9", "yew", 12)]
    crossed = relational.join_tables(plots, heights, how="cross")
    assert crossed.count() == 9 and crossed.columns == ["plot_id_left", "tree", "plot_id_right", "height"]
    with pytest.raises(ValueError, match="keys"):
        relational.join_tables(plots, heights, on="plot_id", how="cross")
    first, second = spark.createDataFrame([("dock a", 40)], "place string, crates int"), spark.createDataFrame([(65, "dock a")], "crates int, place string")
    both = relational.union_tables([first, second], source_column="source_table")
    assert sorted(map(tuple, both.collect())) == [("dock a", 40, "table_1"), ("dock a", 65, "table_2")]
    assert [tuple(r) for r in relational.groupby_table(both, "place", {"crates": "sum"}).collect()] == [("dock a", 105)]
    with pytest.raises(ValueError, match="incompatible schema"):
        relational.union_tables([first, plots])
    with pytest.raises(ValueError):
        relational.join_tables(both, both.withColumnRenamed("source_table", "x"))
    with pytest.raises(ValueError, match="unique"):
        relational.join_tables(both, both, on="place", validate="1:1")
    nulls = spark.createDataFrame([(None, 1)], "k string, v int")
    assert relational.join_tables(nulls, nulls, on="k").count() == 1
    sums = relational.groupby_table(spark.createDataFrame([("a", None)], "k string, v int"), "k", {"v": ["sum", "mean"]}).first()
    assert tuple(sums) == ("a", 0, None)


def test_subtotal_raises(spark):
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([(7, 1.0, 1, 1, 1.0, 1.0, 1.0)], "code int, average double, count bigint, counta bigint, max double, min double, sum double").select(aggregates.subtotal(F.col("code"))).collect()


FORMULAS = [
    ("D5", "=C5/$K$2"), ("D6", "=C6/$K$2"), ("G5", "=SUM(E5:F5)"), ("G6", "=SUM(E6:F6)"), ("G7", "=SUM(E7:F7)"), ("H5", '=IF(C5>3,"far","near")'), ("H6", "=C6+#DIV/0!"),
    ("E9", "=E5*E6"), ("F9", "=F5*F6"), ("C10", "=MAX(C5:C7)"), ("D10", "=C5-C6"),
]


def test_relations(spark):
    df = spark.createDataFrame(FORMULAS, "a1 string, raw string").withColumn("x", A.parse_box(F.col("a1")))
    formulas = df.select(F.lit("w").alias("wb_id"), F.lit("s").alias("sheet"), F.col("x.r1").alias("row"), F.col("x.c1").alias("col"), "raw")
    bounds = spark.createDataFrame([("w", "s", "t", 5, 2, 8, 6)], "wb_id string, sheet string, table_id string, r1 int, c1 int, r2 int, c2 int")
    names = [("dist", 3), ("time", 4), ("wet", 5), ("dry", 6), ("all", 7)]
    headers = spark.createDataFrame([("t", n, i, 5, c, 7, c, False) for i, (n, c) in enumerate(names)], "table_id string, header_id string, ord int, r1 bigint, c1 bigint, r2 bigint, c2 bigint, by_row boolean")
    rows = {r.relation_id: r for r in relations.extract_relations(formulas, bounds, headers).collect()}
    place = lambda r: (r.r1, r.c1, r.r2, r.c2)
    normal = {i: (place(r), r.pattern, r.expression) for i, r in rows.items() if r.category == "normal"}
    assert normal == {
        "rel_repeat_row_arithmetic_d_1": ((5, 4, 6, 4), "D{row} = C{row} / $K$2", "time = dist / $K$2"),
        "rel_repeat_row_sum_g_2": ((5, 7, 7, 7), "G{row} = SUM(E{row}:F{row})", "all = SUM(E5:F5)"),
        "rel_repeat_column_formula_9_3": ((9, 5, 9, 6), "{col}9 = {col}5 * {col}6", "summary_wet = wet * wet"),
    }
    rest = {i: (r.cell, [e.type for e in r.errors], r.expression) for i, r in rows.items() if r.category != "normal"}
    assert rest == {
        "rel_aggregate_max_1": ("C10", [], "max_dist = MAX(dist)"), "rel_single_cell_formula_1": ("H5", [], "H5 = IF(dist > 3, 'far', 'near')"),
        "rel_single_arithmetic_formula_2": ("D10", [], "summary_time = dist - dist"), "rel_invalid_ref_1": ("H6", ["division_by_zero"], None),
    }
    said = {i: r.description for i, r in rows.items()}
    assert said["rel_repeat_row_arithmetic_d_1"] == "Repeated row-wise arithmetic formula using an absolute reference."
    assert said["rel_invalid_ref_1"] == "Formula contains error(s): division_by_zero (Formula attempts to divide by zero.)."
    moved = one(spark, relations.shifted(F.lit('=LOG10(C11)*D$11&"C1"'), F.lit(2), F.lit(1)).alias("x")).x
    assert moved == '=LOG10(D13)*E$11&"C1"' and one(spark, relations.shifted(F.lit("=A1"), F.lit(-1), F.lit(0)).alias("x")).x is None


def test_runs_cover_every_cell_once(spark):
    rng = random.Random(2)
    cells = {(rng.randint(1, 8), rng.randint(1, 6)) for _ in range(30)}
    rows = relations.runs(spark.createDataFrame([("k", *c) for c in cells], "k string, row bigint, col bigint"), ["k"]).collect()
    parts = [c for r in rows for c in cells_of(r)]
    assert len(parts) == len(cells) and set(parts) == cells


def test_recalculation(spark):
    edges = spark.createDataFrame([(0, "G4", "D4", 2.5), (0, "H4", "G4", 0.04), (0, "X", "Y", 1.0), (0, "Y", "X", 1.0)], "scenario int, cell string, ref string, weight double")
    constants = spark.createDataFrame([(0, "D4", 350.0)], "scenario int, cell string, value double")
    found = {r.cell: (r.value, r.state) for r in relations.recalculate_graph(edges, constants).collect()}
    assert found["H4"][0] == pytest.approx(35.0) and found["X"] == found["Y"] == (None, "circular")


def test_long_chains_resolve(spark):
    """A running total down 150 rows, a sum over two of its rows, a self-reference and references to it and to a blank."""
    rows = [x for i in range(1, 151) for x in ((f"B{i}", f"B{i - 1}", 1.0), (f"B{i}", f"A{i}", 1.0))]
    rows += [("D", "B120", 2.0), ("D", "B150", -1.0), ("S", "S", 1.0), ("S", "A1", 1.0), ("T", "S", 1.0), ("U", "blank", 1.0), ("U", "B3", 1.0), ("V", "U", 0.0), ("V", "D", 1.0)]
    edges = spark.createDataFrame([(0, *r) for r in rows], "scenario int, cell string, ref string, weight double")
    constants = spark.createDataFrame([(0, "B0", 5.0), *((0, f"A{i}", float(i)) for i in range(1, 151))], "scenario int, cell string, value double")
    found = {r.cell: (r.value, r.state) for r in relations.recalculate_graph(edges, constants).collect()}
    total = lambda n: 5.0 + n * (n + 1) / 2
    assert all(found[f"B{i}"] == (total(i), "value") for i in range(151)) and found["D"] == (2 * total(120) - total(150), "value")
    assert {c for c, (_, state) in found.items() if state == "circular"} == {"S", "T", "U", "V"} and len(found) == 306
    with pytest.raises(RuntimeError):
        relations.recalculate_graph(edges, constants, most_levels=2)


def test_growing_goes_on(spark):
    area = spark.createDataFrame([("w", "s", 1, 1, 1, 1)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    stairs = spark.createDataFrame([("w", "s", i, i, i + 1, i + 1) for i in range(1, 26)], area.schema)
    assert tuple(reads.grow_to_merges(area, stairs).first())[2:] == (1, 1, 26, 26)
    with pytest.raises(RuntimeError):
        reads.grow_to_merges(area, stairs, most_rounds=3)


def test_merged_cells(spark):
    grid = [("Group", 1, 1), ("Group A", 2, 1), ("Shared", 2, 2), ("B3", 3, 2), ("C3", 3, 3)]
    cells = spark.createDataFrame([("w", "s", r, c, "text", v, None, None, None, None) for v, r, c in grid], "wb_id string, sheet string, row bigint, col int, kind string, s string, n double, b boolean, ts timestamp, formula string")
    merges = spark.createDataFrame([("w", "s", 2, 1, 4, 1), ("w", "s", 2, 2, 2, 3)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    found = {(r.row, r.col): r.s for r in reads.expand_merges(cells, merges).collect()}
    assert found[4, 1] == found[3, 1] == "Group A" and found[2, 3] == "Shared" and found[3, 3] == "C3" and len(found) == 8
    area = spark.createDataFrame([("w", "s", 3, 2, 3, 2)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    wide = spark.createDataFrame([("w", "s", 3, 2, 4, 3), ("w", "s", 4, 3, 5, 5)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    assert tuple(reads.grow_to_merges(area, wide).first())[2:] == (3, 2, 5, 5)


def test_coverage_by_union(spark):
    targets = spark.createDataFrame([(1, 1, 1, 3, 4), (2, 1, 1, 3, 4)], "target_id int, r1 int, c1 int, r2 int, c2 int")
    ranges = spark.createDataFrame([(1, 1, 1, 3, 2), (1, 1, 3, 3, 4), (2, 1, 1, 3, 2), (2, 1, 3, 2, 4)], "target_id int, r1 int, c1 int, r2 int, c2 int")
    assert {r.target_id: r.covered for r in structures.covered(targets, ranges).collect()} == {1: True, 2: False}


def test_ranking(spark):
    cards = spark.createDataFrame([(0, 1, "revenue of north region", 1), (0, 2, "staff list", 2), (0, 3, "revenue revenue plan", 3)], "scope int, card_id int, card string, ord int")
    asked = spark.createDataFrame([(0, 9, "What is the revenue of the north?"), (0, 8, "nothing here")], "scope int, query_id int, text string")
    ranked = retrieval.hybrid_rank(asked, cards).collect()
    assert [r.card_id for r in sorted(ranked, key=lambda r: r.rank) if r.query_id == 9] == [1, 3, 2]
    assert {r.score for r in ranked if r.query_id == 8} == {1.0}
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("x")).x == 0.0
    assert one(spark, T.alias(F.lit("Đà Nẵng-2018")).alias("x")).x == "danang2018"


def test_sources():
    html = "<table><tr><td>x</td><td colspan='3'>wide</td></tr><tr><td rowspan='2'>tall</td><td>p</td></tr><tr><td>q</td></tr></table>"
    assert tables.html_rows(html) == [(1, 1, "x", 1, 1), (1, 2, "wide", 1, 3), (2, 1, "tall", 2, 1), (2, 2, "p", 1, 1), (3, 2, "q", 1, 1)]
    latex = r"\begin{tabular}{ll} \multicolumn{2}{l}{Tide \emph{tables}} \\ \begin{tabular}{l}high\\water\end{tabular} & \textit{5 \% up} \\ \end{tabular}"
    assert [(r, c, s) for r, c, s, *_ in tables.latex_rows(latex)] == [(1, 1, "Tide tables"), (1, 2, ""), (2, 1, "high water"), (2, 2, "5 % up")]
    assert tables.json_rows('{"texts": [["a", 1], ["b", null]], "merged_regions": [{"first_row": 0, "last_row": 1, "first_column": 0, "last_column": 0}]}')[0] == (1, 1, "a", 2, 1)
    assert [c[2] for c in tables.json_rows('[{"k": 1}, {"k": "v"}]')] == ["k: 1", "k: v"]


def test_long_texts_keep_all_lines(spark):
    """More lines than the 1,999 that the SQL of text_table_cells enumerates."""
    docs = spark.createDataFrame([(1, "\n".join(f"| a{i} | b{i} |" for i in range(5000)))], "doc_id bigint, text string")
    rows = sorted((r.row, r.col, r.s) for r in tables.text_cells(docs).collect())
    assert rows == [(i + 1, c, f"{x}{i}") for i in range(5000) for c, x in ((1, "a"), (2, "b"))]


def test_workbook_file(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c><c r="AA1" t="b"><v>1</v></c><c r="C1"><f>B1*2</f><v>5</v></c></row></sheetData></worksheet>')
    rows = {(r.row, r.col): (r.kind, r.s, r.n, r.b, r.formula) for r in workbooks.read_workbooks(spark, str(tmp_path)).collect()}
    assert rows == {(1, 1): ("text", "Name", None, None, None), (1, 2): ("number", None, 2.5, None, None), (1, 27): ("bool", None, None, True, None), (1, 3): ("formula", None, 5.0, None, "=B1*2")}


def test_retriever_and_guards(spark):
    asked = spark.createDataFrame([(0, 1, "What does sheet Harbur, say"), (0, 2, "tab Fleet and Fleets"), (0, 3, "the Harbour sheet of tide 2021 log")], "scope int, query_id int, text string")
    sheets = spark.createDataFrame([(0, "Harbour"), (0, "Fleet"), (0, "Crew")], "scope int, sheet string")
    found = {r.query_id: (r.sheet, r.match) for r in retrieval.sheet_guard(asked, sheets).collect()}
    assert found == {1: ("Harbour", "close_alias"), 2: ("Fleet", "exact"), 3: ("Harbour", "exact")}
    books = spark.createDataFrame([(0, "tide-2021-log.xlsx"), (0, "tide-2022-log.xlsx")], "scope int, workbook string")
    guard = retrieval.workbook_guard(asked.where("query_id = 3"), books).collect()
    assert [(r.workbook, r.match) for r in guard] == [] or guard[0].match == "boost"
    tables = spark.createDataFrame([(0, "t1", "Tides", "")], "scope int, table_id string, name string, description string")
    headers = spark.createDataFrame([], "scope int, table_id string, header_id string, label string, description string")

    def unable(queries, tables):
        raise NotImplementedError

    got = retrieval.search_tables(spark.createDataFrame([(0, 1, "all tides")], "scope int, query_id int, text string"), tables, headers, retriever=unable).collect()
    assert [(r.table_id, r.reason, r.score) for r in got] == [("t1", "lexical", 23.0)]


def test_embedded_ranking_is_brute_force(spark):
    """Cards by blocks and postings against every score worked out one by one."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["tide", "moor", "quay", "buoy", "reef", "mast"]) for _ in range(n))
    vector = lambda: [rng.gauss(0, 1) for _ in range(5)]
    cards = [(0, i, say(rng.randint(0, 6)), i // 2, vector() if i % 7 else None) for i in range(60)]
    asked = [(0, 1, "tide moor", vector()), (0, 2, "nothing", vector()), (0, 3, "quay quay reef", vector())]
    c = spark.createDataFrame(cards, "scope int, card_id int, card string, ord int, embedding array<double>")
    q = spark.createDataFrame(asked, "scope int, query_id int, text string, embedding array<double>")
    lexical = {(r.query_id, r.card_id): r.bm25 for r in retrieval.bm25(q, c).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for _, query_id, _, emb in asked:
        raw = [lexical.get((query_id, i), 0.0) for _, i, *_ in cards]
        low, high = min(raw), max(raw)
        scores = []
        for (_, i, _, order, v), x in zip(cards, raw, strict=True):
            own = 1.0 if high == low else (x - low) / (high - low)
            scores.append((-round(own if v is None else 0.3 * own + 0.7 * cosine(emb, v), 9), order, i))
        want = [i for _, _, i in sorted(scores)[:8]]
        got = sorted((r.rank, r.card_id) for r in retrieval.hybrid_rank(q, c, 8).where(F.col("query_id") == query_id).collect())
        assert [i for _, i in got] == want


def test_workbook_dates_merges_and_shared_formulas(spark):
    from gridspark.plans.document_queries import _xlsx

    import pandas as pd

    content = _xlsx(pd.DataFrame({"key": [4, 5], "name": ["a", "b"], "nation": [1, 2], "day": [45000, 45001]}))
    files = spark.createDataFrame([("w", "n.xlsx", bytearray(content))], "wb_id string, name string, content binary")
    rows = {(r.row, r.col): r for r in workbooks.workbook_cells(files).collect()}
    assert str(rows[1, 3].ts) == "2023-03-15 00:00:00" and rows[2, 4].formula == "=A2*2" and rows[2, 4].n == 10.0 and rows[1, 5].b is True
    assert [tuple(r)[1:] for r in workbooks.workbook_merges(files).collect()] == [("Rows", 1, 6, 2, 7)]
    assert {(r.row, r.col): r.kind for r in workbooks.workbook_cells(files, data_only=True).collect()}[2, 4] == "number"
    meta = workbooks.workbook_metadata(files).first()
    assert (meta.sheet_names, meta.author, meta.date_created, meta.size_bytes) == (["Rows", "Blank"], "Author 1", "2024-01-02T03:04:05", len(content))


def test_records_go_out_and_come_back(spark, tmp_path):
    rows = [("r1", "w1", "s", "t", 'a "card", of two\nlines'), ("r2", "w2", "s", "t", "b")]
    cards = spark.createDataFrame([(*r, r[1]) for r in rows], "id string, workbook string, sheet string, table_id string, retrieval_card string, wb_id string")
    workbooks.write_records(cards, str(tmp_path))
    schema = "id string, workbook string, sheet string, table_id string, retrieval_card string"
    back = workbooks.read_records(spark, [f"{tmp_path}/json/wb_id=w1", f"{tmp_path}/json/wb_id=w2"], schema)
    assert sorted(map(tuple, back.collect())) == rows
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert csv.columns == workbooks.RECORD_COLUMNS and sorted(r.retrieval_card for r in csv.collect()) == sorted(r[4] for r in rows)


def test_documents_that_are_yaml(spark):
    from gridspark.sources import documents

    text = "sea:\n  name: Sea\n  headers:\n  - {id: a, label: A, description: d, orientation: column, header_range: A1, sub_headers: [{id: b, label: B, description: d, orientation: row, data_range: null}]}\nrelations:\n  normal_formulas:\n  - {id: r1, formula_example: '=A1*2'}\n"
    docs = spark.createDataFrame([(1, text), (2, "[oops"), (3, None)], "doc_id bigint, text string")
    rows = documents.structure_headers(docs).orderBy("ord").collect()
    assert [(r.table_id, r.sheet, r.header_id, r.parent_id, r.is_leaf, r.header_range) for r in rows] == [("sea", "Sea", "a", None, False, "A1"), ("sea", "Sea", "b", "a", True, None)]
    assert [(r.category, r.relation_id, r.raw, r.table_id) for r in documents.relations(docs).collect()] == [("normal_formulas", "r1", "=A1*2", None)]


def test_axes_do_not_mix(spark):
    cells = people(spark)
    down, across = filters.filter_values(cells, 3, 4, 5, 4, contains="n"), filters.filter_values(cells, 3, 2, 3, 5, contains="i")
    with pytest.raises(ValueError, match="axis"):
        filters.combine("union", down, across)


def test_invalid_bounds_raise(spark):
    cells = people(spark)
    with pytest.raises(Exception, match="invalid worksheet bounds"):
        reads.sheet_frame(cells, reads.sheet_bounds(cells), 9, 3).collect()


def test_single_values_keep_their_type(spark):
    cells = spark.createDataFrame([("w", "s", 2, 1, "number", None, 2.5, None, None, None), ("w", "s", 2, 2, "number", None, 2.5, None, None, None), ("w", "s", 3, 1, "text", "x", None, None, None, None), ("w", "s", 3, 2, "number", None, 1.0, None, None, None)], "wb_id string, sheet string, row bigint, col int, kind string, s string, n double, b boolean, ts timestamp, formula string")
    box = "struct<r1:bigint,c1:bigint,r2:bigint,c2:bigint>"
    headers = spark.createDataFrame([("w", "s", "t", "h", 1, (1, 1, 1, 2), (2, 1, 3, 2))], f"wb_id string, sheet string, table_id string, header_id string, ord int, hr {box}, dr {box}")
    rows = {r.row: (r.kind, r.n, r.s, r.value) for r in reads.logical_rows(cells, headers).collect()}
    assert rows == {2: ("number", 2.5, None, "2.5"), 3: ("text", None, "x\n1", "x\n1")}


def test_boosts_lift_a_workbooks_cards(spark):
    cards = spark.createDataFrame([(0, i, "tide table", f"w{i // 4}", i) for i in range(12)], "scope int, card_id int, card string, workbook string, ord int")
    asked = spark.createDataFrame([(0, 1, "tide")], "scope int, query_id int, text string")
    guards = spark.createDataFrame([(1, "w2", "boost")], "query_id int, workbook string, match string")
    plain = [r.card_id for r in retrieval.hybrid_rank(asked, cards, 3).orderBy("rank").collect()]
    lifted = retrieval.hybrid_rank(asked.join(retrieval.boosts(guards), "query_id", "left"), cards, 3).orderBy("rank").collect()
    assert plain == [0, 1, 2] and [r.card_id for r in lifted] == [8, 9, 10] and lifted[0].score == 2.0


def test_headers_move_off_a_merge_that_says_something_else(spark):
    text = lambda r, c, s: ("w", "s", r, c, "text", s, None, None, None, None)
    cells = spark.createDataFrame([text(1, 1, "Group"), text(1, 3, "Depth"), text(2, 3, "7"), text(3, 4, "z")], "wb_id string, sheet string, row bigint, col int, kind string, s string, n double, b boolean, ts timestamp, formula string")
    merges = spark.createDataFrame([("w", "s", 1, 1, 1, 2)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    box = "struct<sheet:string,r1:bigint,c1:bigint,r2:bigint,c2:bigint>"
    rows = [("w", "s", "t", "d", None, ["d"], 1, "Depth", "column", (None, 1, 2, 1, 2), (None, 2, 2, 3, 2)), ("w", "s", "t", "e", None, ["e"], 2, "Group", "column", (None, 1, 1, 1, 2), (None, 3, 1, 3, 2))]
    headers = spark.createDataFrame(rows, f"wb_id string, sheet string, table_id string, header_id string, parent_id string, path array<string>, ord int, label string, orientation string, hr {box}, dr {box}")
    found = {(r.header_id, r.rule): r.detail for r in structures.verify(headers, cells, merges).collect()}
    assert found == {("d", "header_moved"): "C1", ("d", "data_realigned"): "C2:C3", ("e", "data_blank"): "A3:B3"}
