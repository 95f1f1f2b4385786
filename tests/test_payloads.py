"""Captions and payloads of several tables."""

from gridspark.sources import tables

DOCS = "doc_id bigint, text string"


def test_captions(spark):
    rows = [(1, "<table><caption> Sales <b>of</b>\n2020 </caption><tr><td>1</td></tr></table>"), (2, "<table><tr><td>1</td></tr></table><table><caption>later</caption></table>"), (3, None), (4, "<table><tr><td><table><caption>inner</caption></table></td></tr></table>")]
    docs = spark.createDataFrame(rows, DOCS)
    assert [tuple(r) for r in tables.captions(docs).collect()] == [(1, "Sales of 2020")]
    assert [(r.doc_id, r.s) for r in tables.parsed_cells(docs.where("doc_id = 1"), tables.html_rows).collect()] == [(1, "1")]


def test_payload_cells(spark):
    one, two = '{"title": "First", "texts": [["a", "b"], ["c", "d"]]}', '{"texts": [["e"]]}'
    docs = spark.createDataFrame([(1, f'{{"tables": [{one}, {two}]}}'), (2, f" [{two}, {one}]"), (3, one), (4, None), (5, "no json"), (6, '{"tables": []}')], DOCS)
    titles = {(r.doc_id, r.ord): r.title for r in tables.payload_tables(docs).collect()}
    assert titles == {(1, 1): "First", (1, 2): "Table 2", (2, 1): "Table 1", (2, 2): "First"}
    cells = tables.payload_cells(docs)
    assert sorted((r.doc_id, r.ord, r["row"], r.col, r.s) for r in cells.collect()) == sorted(
        [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b"), (1, 1, 2, 1, "c"), (1, 1, 2, 2, "d"), (1, 2, 1, 1, "e"), (2, 1, 1, 1, "e"), (2, 2, 1, 1, "a"), (2, 2, 1, 2, "b"), (2, 2, 2, 1, "c"), (2, 2, 2, 2, "d")]
    )
    below = {(r.doc_id, r["row"], r.col): r.s for r in tables.stacked(cells.select("doc_id", "ord", "row", "col", "s"), tables.payload_tables(docs).select("doc_id", "ord", "title"), "doc_id").collect()}
    assert below[1, 1, 1] == "First" and below[1, 2, 1] == "a" and below[1, 6, 1] == "Table 2" and below[1, 7, 1] == "e"
