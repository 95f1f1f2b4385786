"""Queries over documents and files that Spark builds from rows: structures, relations, workbooks, records and cards; and over sheets' frames."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions import addressing as A
from gridspark.functions import formulas as X
from gridspark.functions.lineage import shared_folder
from gridspark.operators import cards, reads, relations, retrieval
from gridspark.plans.cell_queries import BOXES, boxes, customer_cells, customer_headers, merged_sheet, tiles
from gridspark.plans.register import Register, Tables
from gridspark.plans.relation_queries import FORMULAS, TABLES, formulas, formulas_once, tables_of
from gridspark.sources import documents, runs, tables, workbooks

REGISTER = query = Register()


def structure_documents(t: Tables):
    """A structure document for each customer: a table of a parent over two headers and one beside them, and relations under the reserved key."""
    k = F.col("c_custkey").cast("string")
    leaf = lambda i, label, hr, dr: F.struct(F.lit(i).alias("id"), label.alias("label"), F.lit("d").alias("description"), F.lit("column").alias("orientation"), F.lit(hr).alias("header_range"), F.lit(dr).alias("data_range"))
    below = F.array(leaf("name", F.col("c_name"), "B2", "B3:B9"), leaf("nation", F.col("c_nationkey").cast("string"), "C2", None))
    parent = F.struct(F.lit("who").alias("id"), F.lit("Who").alias("label"), F.lit("d").alias("description"), F.lit("column").alias("orientation"), F.lit("B1:C1").alias("header_range"), F.lit("null").alias("data_range"), below.alias("sub_headers"))
    flat = F.struct(F.lit("seg").alias("id"), F.col("c_mktsegment").alias("label"), F.lit("d").alias("description"), F.lit("row").alias("orientation"), F.lit("D1").alias("header_range"), F.lit(" ").alias("data_range"), F.array().cast(f"array<{'struct<id:string,label:string,description:string,orientation:string,header_range:string,data_range:string>'}>").alias("sub_headers"))
    table = F.struct(F.concat(F.lit("t"), k).alias("id"), F.lit("People").alias("name"), F.array(parent, flat).alias("headers"))
    empty = F.struct(F.lit("bare").alias("name"), F.lit("S2").alias("sheet"))
    total = F.struct(F.lit("rel_aggregate_sum_1").alias("id"), F.concat(F.lit("total = sum "), k).alias("expression"), F.struct(F.lit("B9").alias("cell"), F.lit("=SUM(B2:B8)").alias("raw")).alias("formula"))
    lost = F.struct(F.lit("rel_invalid_ref_1").alias("id"), F.struct(F.lit("C9").alias("cell"), F.lit("=#REF!").alias("raw")).alias("formula"), F.array(F.struct(F.lit("#REF!").alias("token"))).alias("errors"))
    own = F.struct(F.struct(F.array(total).alias("aggregate_formulas"), F.array(lost).alias("invalid_formulas")).alias("table"), F.lit("ignored").alias("note"))
    document = F.to_json(F.struct(table.alias("table"), empty.alias("other"), own.alias("relations"), F.lit(1).alias("version")))
    return t.customer.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 10 != 9, document).otherwise("{broken: [").alias("text"))


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 9), h AS (
  SELECT c_custkey, 't' || c_custkey AS table_id, 'who' AS header_id, NULL AS parent_id, 'who' AS path, 0 AS ord, 'Who' AS label, 'B1:C1' AS header_range, NULL AS data_range, false AS is_leaf FROM c
  UNION ALL SELECT c_custkey, 't' || c_custkey, 'name', 'who', 'who/name', 1, c_name, 'B2', 'B3:B9', true FROM c
  UNION ALL SELECT c_custkey, 't' || c_custkey, 'nation', 'who', 'who/nation', 2, CAST(c_nationkey AS VARCHAR), 'C2', NULL, true FROM c
  UNION ALL SELECT c_custkey, 't' || c_custkey, 'seg', NULL, 'seg', 3, c_mktsegment, 'D1', NULL, true FROM c
  UNION ALL SELECT c_custkey, 'other', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c)
SELECT c_custkey AS doc_id, table_id, CASE WHEN table_id = 'other' THEN 'S2' ELSE 'People' END AS sheet, header_id, parent_id, path, CAST(ord AS INTEGER) AS ord, label, header_range, data_range, is_leaf FROM h""")
def structure_headers(t: Tables):
    found = documents.structure_headers(structure_documents(t))
    return found.select("doc_id", "table_id", "sheet", "header_id", "parent_id", F.array_join("path", "/").alias("path"), "ord", "label", "header_range", "data_range", "is_leaf")


RELATION_ROWS = """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 9) SELECT c_custkey AS doc_id, 'table' AS table_id, 'aggregate_formulas' AS category, 'rel_aggregate_sum_1' AS relation_id, 'total = sum ' || c_custkey AS expression, 'B9' AS cell, '=SUM(B2:B8)' AS raw, false AS broken FROM c
UNION ALL SELECT c_custkey, 'table', 'invalid_formulas', 'rel_invalid_ref_1', NULL, 'C9', '=#REF!', true FROM c"""


@query(RELATION_ROWS)
def relation_documents(t: Tables):
    return documents.relations(structure_documents(t)).select("doc_id", "table_id", "category", "relation_id", "expression", "cell", "raw", F.col("errors").isNotNull().alias("broken"))


@query(RELATION_ROWS)
def run_relations(t: Tables):
    """Relations written as a run's documents and read back through its manifest."""
    found = documents.relations(structure_documents(t)).withColumnRenamed("doc_id", "wb_id")
    path = f"{shared_folder(t.spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    runs.write_run(t.spark, path, "relations", {"relations": runs.relation_documents(found)})
    tables, _ = runs.read_run(t.spark, path, "relations")
    return documents.relations(tables["relations"], "wb_id").select("doc_id", "table_id", "category", "relation_id", "expression", "cell", "raw", F.col("errors").isNotNull().alias("broken"))


@query("""SELECT '/run/' || source || '/' || lang AS folder FROM documents GROUP BY source, lang HAVING bool_or(doc_id % 2 = 0) AND bool_or(doc_id % 2 = 1)""")
def artifact_folders(t: Tables):
    name = F.when(F.col("doc_id") % 2 == 0, "structure.yaml").otherwise("metadata.json")
    files = t.documents.select(F.concat_ws("/", F.lit("/run"), "source", "lang", name).alias("path")).unionByName(t.documents.select(F.concat_ws("/", F.lit("/run"), "source", F.lit("notes.txt")).alias("path")))
    return documents.artifact_folders(files)


def _xlsx(rows: pd.DataFrame) -> bytes:
    """A small workbook file: a text, a number, a date, a formula with its value and one that shares it, and a merged area."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    lines = []
    for i, (key, name, nation, day) in enumerate(zip(rows["key"], rows["name"], rows["nation"], rows["day"], strict=True), 1):
        formula = f'<f t="shared" si="0" ref="D1:D{len(rows)}">A{i}*2</f>' if i == 1 else '<f t="shared" si="0"/>'
        lines.append(f'<row r="{i}"><c r="A{i}"><v>{key}</v></c><c r="B{i}" t="inlineStr"><is><t>{name}</t></is></c><c r="C{i}" s="1"><v>{day}</v></c><c r="D{i}">{formula}<v>{key * 2}</v></c><c r="E{i}" t="b"><v>{nation % 2}</v></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Rows" sheetId="1" r:id="r1"/><sheet name="Blank" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>{"".join(lines)}</sheetData><mergeCells><mergeCell ref="F1:G2"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("docProps/core.xml", f'<p xmlns:dc="d" xmlns:dcterms="t"><dc:creator>Author {rows["nation"].iloc[0]}</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></p>')
    return out.getvalue()


#: Workbook files hold so many customers each.
FILE_ROWS = 50
FILES = f"f AS (SELECT *, c_custkey // {FILE_ROWS} AS wb, CAST(row_number() OVER (PARTITION BY c_custkey // {FILE_ROWS} ORDER BY c_custkey) AS BIGINT) AS row FROM customer)"


def files(t: Tables):
    rows = t.customer.select(F.floor(F.col("c_custkey") / FILE_ROWS).cast("string").alias("wb_id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (45000 + F.col("c_custkey") % 1000).alias("day"))

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"wb_id": [frame["wb_id"].iloc[0]], "name": ["book.xlsx"], "content": [_xlsx(frame.sort_values("key"))]})

    return rows.groupBy("wb_id").applyInPandas(made, "wb_id string, name string, content binary")


@query(f"""WITH {FILES} SELECT CAST(wb AS VARCHAR) AS wb_id, row, CAST(1 AS INTEGER) AS col, 'number' AS kind, CAST(c_custkey AS VARCHAR) AS value FROM f UNION ALL SELECT CAST(wb AS VARCHAR), row, 2, 'text', c_name FROM f
UNION ALL SELECT CAST(wb AS VARCHAR), row, 3, 'time', strftime(DATE '2023-03-15' + CAST(c_custkey % 1000 AS INTEGER), '%Y-%m-%d 00:00:00') FROM f UNION ALL SELECT CAST(wb AS VARCHAR), row, 4, 'formula', '=A' || row || '*2' FROM f
UNION ALL SELECT CAST(wb AS VARCHAR), row, 5, 'bool', CASE WHEN c_nationkey % 2 = 1 THEN 'True' ELSE 'False' END FROM f""")
def workbook_scan(t: Tables):
    return workbooks.workbook_cells(files(t)).select("wb_id", "row", "col", "kind", reads.cell_text().alias("value"))


@query(f"WITH {FILES} SELECT CAST(wb AS VARCHAR) AS wb_id, row, CAST(2 * c_custkey AS DOUBLE) AS n FROM f")
def workbook_values(t: Tables):
    return workbooks.workbook_cells(files(t), data_only=True).where("col = 4").select("wb_id", "row", "n")


@query(f"WITH {FILES} SELECT DISTINCT CAST(wb AS VARCHAR) AS wb_id, 'Rows' AS sheet, CAST(1 AS BIGINT) AS r1, CAST(6 AS BIGINT) AS c1, CAST(2 AS BIGINT) AS r2, CAST(7 AS BIGINT) AS c2 FROM f")
def workbook_merges(t: Tables):
    return workbooks.workbook_merges(files(t))


@query(f"WITH {FILES} SELECT CAST(wb AS VARCHAR) AS wb_id, 'book.xlsx' AS name, 'Rows;Blank' AS sheets, 'Author ' || arg_min(c_nationkey, c_custkey) AS author, '2024-01-02T03:04:05' AS date_created, CAST(NULL AS VARCHAR) AS date_modified, true AS sized FROM f GROUP BY wb")
def workbook_properties(t: Tables):
    made = workbooks.workbook_metadata(files(t))
    return made.select("wb_id", "name", F.array_join("sheet_names", ";").alias("sheets"), "author", "date_created", "date_modified", (F.col("size_bytes") > 400).alias("sized"))


@query("""WITH r AS (SELECT doc_id, i FROM documents, range(0, 2) x(i) WHERE doc_id % 4 < 3) SELECT 'r' || (doc_id // 4 * 2 + i) AS id, 's' || doc_id % 4 AS sheet, 'c' || doc_id AS retrieval_card FROM r""")
def records_read(t: Tables):
    """Records of four documents at a time: as lists, wrapped, as lines, and the first again with other cards."""
    k = F.col("doc_id") % 4
    record = lambda i: F.struct(F.concat(F.lit("r"), (F.floor(F.col("doc_id") / 4) * 2 + i).cast("string")).alias("id"), F.lit("wb").alias("workbook"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("sheet"), F.lit("t").alias("table_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("retrieval_card"))
    both = F.array(record(0), record(1))
    text = F.when(k == 0, F.to_json(both)).when(k == 1, F.to_json(F.struct(both.alias("artifacts")))).when(k == 2, F.concat(F.to_json(record(0)), F.lit("\n"), F.to_json(record(1)), F.lit("\n"))).otherwise(F.to_json(both))
    docs = t.documents.select("doc_id", text.alias("text"))
    return workbooks.unwrapped(docs, "id:string,workbook:string,sheet:string,table_id:string,retrieval_card:string", ["doc_id"]).select("id", "sheet", "retrieval_card")


@query("""WITH o AS (SELECT o_custkey AS wb_id, string_agg(o_orderkey || ' ' || o_orderstatus, ' ' ORDER BY o_orderkey) AS sheet_text FROM orders GROUP BY 1) SELECT CAST(wb_id AS VARCHAR) AS wb_id, sheet_text FROM o""")
def sheet_text(t: Tables):
    row = F.col("o_orderkey")
    both = F.array(F.struct(F.lit(1).alias("col"), row.cast("string").alias("s")), F.struct(F.lit(2).alias("col"), F.col("o_orderstatus").alias("s")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    cells = t.orders.select(F.col("o_custkey").cast("string").alias("wb_id"), F.lit("orders").alias("sheet"), row.alias("row"), F.inline(both)).select("wb_id", "sheet", "row", "col", F.lit("text").alias("kind"), "s", none("double", "n"), none("boolean", "b"), none("timestamp", "ts"), none("string", "formula"))
    return reads.sheet_text(cells).select("wb_id", "sheet_text")


@query("""SELECT c_custkey AS doc_id, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, c_name AS s FROM customer UNION ALL SELECT c_custkey, 1, 2, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 2, 1, CAST(c_nationkey AS VARCHAR) FROM customer""")
def any_cells(t: Tables):
    """One table for each customer, as HTML, LaTeX, JSON or plain text by key."""
    name, seg, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    html = F.concat(F.lit("<table><tr><td>"), name, F.lit("</td><td>"), seg, F.lit("</td></tr><tr><td>"), nation, F.lit("</td></tr></table>"))
    latex = F.concat(F.lit("\\begin{tabular}{ll} "), F.regexp_replace(name, "#", r"\\#"), F.lit(" & "), seg, F.lit(" \\\\ "), nation, F.lit(" \\\\ \\end{tabular}"))
    pipes = F.concat(F.lit("| "), name, F.lit(" | "), seg, F.lit(" |\n|---|---|\n"), nation)
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, html).when(k == 1, latex).when(k == 2, F.to_json(F.struct(F.array(F.array(name, seg), F.array(nation)).alias("rows")))).otherwise(pipes)
    return tables.any_cells(t.customer.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).select("doc_id", "row", "col", "s")


@query("""SELECT c_custkey AS doc_id, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, c_name AS s FROM customer UNION ALL SELECT c_custkey, 1, 2, '' FROM customer UNION ALL SELECT c_custkey, 2, 1, '' FROM customer UNION ALL SELECT c_custkey, 2, 2, c_mktsegment FROM customer""")
def rectangular(t: Tables):
    cells = t.customer.select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("c_name").alias("s")), F.struct(F.lit(2).alias("row"), F.lit(2).alias("col"), F.col("c_mktsegment").alias("s")))))
    return tables.rectangular(cells)


@query("""WITH r AS (SELECT CAST(floor((c_custkey + 1) / 100) AS BIGINT) AS range_id, c_custkey + 2 AS row, c_name, c_nationkey, c_acctbal FROM customer), f AS (SELECT range_id, range_id * 100 + 1 AS r1 FROM r GROUP BY 1),
h AS (SELECT f.range_id, r1, CASE WHEN r1 = 1 THEN 'c_name' ELSE coalesce(c_name, 'Col0') END AS h0 FROM f LEFT JOIN r ON r.range_id = f.range_id AND r.row = r1)
SELECT h.range_id, r1 + 1 + i - r1 - 1 AS row, h0 AS name, c_name AS value FROM h, range(0, 99) x(i) LEFT JOIN r ON r.range_id = h.range_id AND r.row = r1 + 1 + i""")
def range_frame(t: Tables):
    named = reads.range_rows(customer_cells(t), tiles(t))
    return named.where("i = 0").select("range_id", F.col("row").cast("bigint").alias("row"), "name", "value")


@query("""WITH b AS (SELECT max(c_custkey) + 2 AS last FROM customer) SELECT row, CAST(col AS INTEGER) AS col, (row - 1) * 5 + col - 1 AS ord, value FROM (
SELECT 1 AS row, i AS col, unnest AS value FROM (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS unnest, unnest([1,2,3,4,5]) AS i)
UNION ALL SELECT c_custkey + 2, 1, CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey + 2, 2, c_name FROM customer UNION ALL SELECT c_custkey + 2, 3, CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey + 2, 5, c_mktsegment FROM customer)""")
def raw_table(t: Tables):
    found = reads.raw_tables(customer_cells(t).where("col <> 4 or row = 1"), customer_headers(t))
    return found.select("row", "col", F.col("ord").cast("bigint").alias("ord"), reads.cell_text().alias("value"))


@query("""SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(min(l_linenumber) AS BIGINT) AS r1, 2 AS c1, CAST(max(l_linenumber) + 2 AS BIGINT) AS r2, CAST(5 AS BIGINT) AS c2 FROM lineitem GROUP BY 1""")
def merges_grown(t: Tables):
    """An area of one row for each supplier over merges that overlap like tiles: it grows to all of them, one after the other."""
    areas = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("wb_id")).agg(F.min("l_linenumber").cast("bigint").alias("r1")).select("wb_id", F.lit("s").alias("sheet"), "r1", F.lit(2).cast("bigint").alias("c1"), F.col("r1").alias("r2"), F.lit(3).cast("bigint").alias("c2"))
    ends = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("wb_id")).agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"))
    merges = ends.select("wb_id", F.lit("s").alias("sheet"), F.explode(F.sequence(F.col("a").cast("bigint"), F.col("z").cast("bigint"))).alias("r1")).select("wb_id", "sheet", "r1", F.lit(3).cast("bigint").alias("c1"), (F.col("r1") + 2).alias("r2"), F.lit(5).cast("bigint").alias("c2"))
    return reads.grow_to_merges(areas, merges).select(F.col("wb_id").cast("bigint").alias("k"), "r1", F.col("c1").cast("int").alias("c1"), "r2", "c2")


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 9) SELECT c_custkey AS doc_id, header_id, CAST(place AS INTEGER) AS place, CAST(level AS INTEGER) AS level, is_leaf FROM c, (VALUES ('who', 1, 1, false), ('name', 2, 2, true), ('nation', 3, 2, true), ('seg', 4, 1, true)) v(header_id, place, level, is_leaf)""")
def header_navigation(t: Tables):
    h = documents.structure_headers(structure_documents(t)).where("header_id is not null").select(F.col("doc_id").cast("string").alias("wb_id"), "sheet", "table_id", "header_id", "places")
    return reads.header_list(h).where("first_of_id").select(F.col("wb_id").cast("bigint").alias("doc_id"), "header_id", "place", "level", "is_leaf")


@query(f"""WITH {BOXES}, o AS (SELECT *, r1 <= q2 AND q1 <= r2 AND c1 <= d2 AND d1 <= c2 AS meet, (r1 = q1 AND r2 = q2 AND c1 <= d2 + 1 AND d1 <= c2 + 1) OR (c1 = d1 AND c2 = d2 AND r1 <= q2 + 1 AND q1 <= r2 + 1) AS one FROM b)
SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 4 WHEN 0 THEN meet::INT WHEN 1 THEN meet::INT WHEN 2 THEN CASE WHEN one THEN 1 ELSE 2 END
  ELSE CASE WHEN meet THEN (r1 < q1)::INT + (q2 < r2)::INT + (c1 < d1)::INT + (d2 < c2)::INT ELSE 1 END END AS INTEGER) AS boxes FROM o""")
def resolve_ranges(t: Tables):
    op = F.element_at(F.array(*map(F.lit, ("intersection", " Crossing", "union", "difference"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return boxes(t).select("l_orderkey", "l_linenumber", F.size(A.resolve(op, F.col("a"), F.col("b"))).alias("boxes"))


@query(f"""WITH {FORMULAS}, {TABLES} SELECT CAST(f.wb AS VARCHAR) || ':' || row AS relation_key, string_agg(table_id, ',' ORDER BY table_id) AS tables FROM (SELECT DISTINCT wb, row FROM f) f LEFT JOIN tb ON tb.wb = f.wb AND (CASE WHEN row % 5 = 0 THEN table_id = 't2' ELSE row BETWEEN r1 AND r2 END) GROUP BY 1""")
def relation_table_ids(t: Tables):
    own = formulas(t).where("col = 6").select("wb_id", "row").distinct()
    named = own.select(F.struct("wb_id", "row").alias("relation_key"), "wb_id", F.when(F.col("row") % 3 == 0, "lines").alias("sheet"), F.when(F.col("row") % 5 == 0, "t2").otherwise("gone").alias("table_id"), F.col("row").alias("r1"), F.lit(3).alias("c1"), F.col("row").alias("r2"), F.lit(4).alias("c2"))
    found = relations.relation_tables(named, tables_of(t))
    key = F.concat_ws(":", "relation_key.wb_id", F.col("relation_key.row").cast("string"))
    return found.select(key.alias("relation_key"), F.nullif(F.array_join("table_ids", ","), F.lit("")).alias("tables"))


def relation_headers(t: Tables):
    """Headers over columns B to F of each of tables_of(), table ids told apart by workbook."""
    own = tables_of(t).select("wb_id", "sheet", F.concat_ws("/", "wb_id", "table_id").alias("table_id"), "r1", "c1", "r2", "c2")
    names = [("line", 2), ("part", 3), ("qty", 4), ("off", 5), ("net", 6)]
    rows = F.array(*(F.struct(F.lit(n).alias("header_id"), F.lit(i).alias("ord"), F.lit(c).cast("bigint").alias("hc")) for i, (n, c) in enumerate(names)))
    h = own.select("table_id", F.col("r1").cast("bigint").alias("r1"), F.col("r2").cast("bigint").alias("r2"), F.inline(rows))
    return own, h.select("table_id", "header_id", "ord", "r1", F.col("hc").alias("c1"), "r2", F.col("hc").alias("c2"), F.lit(False).alias("by_row"))


@query(f"""WITH {FORMULAS}, {TABLES}, d AS (SELECT DISTINCT wb, row FROM f), a AS (SELECT wb, wb || '/' || table_id AS table_id, row, r2 FROM d JOIN tb USING (wb) WHERE row BETWEEN r1 AND r2 + 5)
SELECT table_id, row, CASE WHEN row > r2 THEN 'summary_net' ELSE 'net' END || ' = qty *(1 - off)* $H$1' AS expression FROM a""")
def relation_expressions(t: Tables):
    own, headers = relation_headers(t)
    priced = relations.assign_formulas(formulas_once(t).where("col = 6"), own)
    key = F.concat_ws(":", "table_id", F.col("row").cast("string"))
    examples = priced.select(key.alias("key"), "table_id", "row", F.col("col").cast("bigint").alias("col"), "raw")
    return relations.expressions(examples, headers).select(F.split("key", ":")[0].alias("table_id"), F.split("key", ":")[1].cast("bigint").alias("row"), "expression")


#: The registered formulas of each table as relations: runs down F, G and H, single cells, and broken ones in the order of their cells.
EXTRACTED = f"""WITH {FORMULAS}, {TABLES}, d AS (SELECT wb, row, any_value(l_linenumber) AS l, max(l_quantity) AS q FROM f GROUP BY 1, 2),
c AS (SELECT wb, row, 6 AS col, false AS bad FROM d UNION ALL SELECT wb, row, 7, false FROM d WHERE l = 1 UNION ALL SELECT wb, row, 8, q > 45 FROM d),
a AS (SELECT wb, table_id, row, col, bad FROM c JOIN tb USING (wb) WHERE row BETWEEN r1 AND r2 + 5), g AS (SELECT *, row - row_number() OVER (PARTITION BY wb, table_id, col ORDER BY row) AS island, min(row) OVER (PARTITION BY wb, table_id, col) AS first FROM a WHERE NOT bad),
s AS (SELECT wb, table_id, col, first, min(row) AS r1, max(row) AS r2, CASE WHEN count(*) > 1 THEN 'normal' WHEN col = 7 THEN 'aggregate' ELSE 'cell' END AS category FROM g GROUP BY wb, table_id, col, first, island),
n AS (SELECT *, row_number() OVER (PARTITION BY wb, table_id, category ORDER BY first, col, r1) AS i FROM s),
x AS (SELECT wb, table_id, category, r1, col, r2, CASE category WHEN 'normal' THEN CASE col WHEN 6 THEN 'rel_repeat_row_arithmetic_f_' WHEN 7 THEN 'rel_repeat_row_sum_g_' ELSE 'rel_repeat_row_formula_h_' END WHEN 'aggregate' THEN 'rel_aggregate_sum_' ELSE CASE col WHEN 6 THEN 'rel_single_arithmetic_formula_' ELSE 'rel_single_cell_formula_' END END || i AS relation_id,
  CASE WHEN category = 'normal' THEN CASE col WHEN 6 THEN 'F{{row}} = D{{row}} *(1 - E{{row}})* $H$1' WHEN 7 THEN 'G{{row}} = SUM(B{{row}}:E{{row}})' ELSE 'H{{row}} = IF(B{{row}} > 10, ''NG'', ''OK'')' END END AS pattern FROM n
  UNION ALL SELECT wb, table_id, 'invalid', row, col, row, 'rel_invalid_ref_' || row_number() OVER (PARTITION BY wb, table_id ORDER BY row, col), NULL FROM a WHERE bad)
SELECT CAST(wb AS VARCHAR) AS wb_id, table_id, category, r1, CAST(col AS INTEGER) AS c1, r2, relation_id, pattern, CASE category WHEN 'invalid' THEN 'Formula contains error(s): broken_reference (Original referenced cell or range is lost.).'
  WHEN 'normal' THEN CASE col WHEN 6 THEN 'Repeated row-wise arithmetic formula using an absolute reference.' WHEN 7 THEN 'Repeated row-wise SUM formula. Each row calculates a value from a range of cells in the same row.' ELSE 'Repeated row-wise formula.' END
  WHEN 'aggregate' THEN 'Aggregate SUM formula in cell G' || r1 || ' over a column or range.' ELSE CASE col WHEN 6 THEN 'Standalone arithmetic formula in cell F' || r1 || ' that does not repeat across rows or columns.' ELSE 'Standalone formula used only in one specific cell in cell H' || r1 || '.' END END AS description FROM x"""


@query(EXTRACTED)
def extract_relations(t: Tables):
    return relations.extract_relations(formulas_once(t), tables_of(t)).select("wb_id", "table_id", "category", "r1", "c1", "r2", "relation_id", "pattern", "description")


@query(f"WITH found AS ({EXTRACTED}) SELECT wb_id, relation_id FROM found WHERE category = 'normal' AND table_id = 't2'")
def relations_listed(t: Tables):
    found = relations.extract_relations(formulas_once(t), tables_of(t)).withColumn("table_ids", F.array("table_id"))
    return relations.list_relations(found, "normal", "t2").select("wb_id", "relation_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND NOT l_tax > 0.05 THEN round_even(l_quantity / 2, 0) WHEN l_discount > 0.05 OR l_tax = 0 THEN abs(l_linenumber - 5) ELSE pow(l_linenumber, 2) - l_quantity / 4 END AS value, l_returnflag || CAST(l_linenumber AS VARCHAR) AS name FROM lineitem""")
def formula_scalars(t: Tables):
    f, o, c = X.SCALARS, X.OPERATORS, F.col
    big = f["AND"](o[">"](c("l_quantity"), F.lit(25)), f["NOT"](o[">"](c("l_tax"), F.lit(0.05))))
    off = f["OR"](o[">"](c("l_discount"), F.lit(0.05)), o["="](c("l_tax"), F.lit(0)))
    rest = o["-"](o["^"](c("l_linenumber"), F.lit(2)), o["/"](c("l_quantity"), F.lit(4)))
    value = f["IF"](big, f["ROUND"](o["/"](c("l_quantity"), F.lit(2))), f["IF"](off, f["ABS"](o["-"](c("l_linenumber"), F.lit(5))).cast("double"), rest))
    return t.lineitem.select("l_orderkey", "l_linenumber", value.alias("value"), o["&"](c("l_returnflag"), c("l_linenumber")).alias("name"))


TOKENS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NUM!", "#N/A", "#NULL!")


@query("""WITH e AS (SELECT unnest(['#REF!', '#DIV/0!', '#VALUE!', '#NAME?', '#NUM!', '#N/A', '#NULL!']) AS token, unnest(['broken_reference', 'division_by_zero', 'wrong_value_type', 'invalid_name', 'number_error', 'value_not_available', 'null_error']) AS type, unnest([0, 1, 2, 3, 4, 5, 6]) AS k,
unnest(['Original referenced cell or range is lost.', 'Formula attempts to divide by zero.', 'Formula uses a value of the wrong data type.', 'Formula contains unrecognized text or function name.', 'Formula contains invalid numeric values.', 'A value is not available to the formula.', 'Formula refers to an intersection of two ranges that do not intersect.']) AS message)
SELECT p_partkey, type, token, message FROM part JOIN e ON k = p_partkey % 7 OR (k = (p_partkey + 3) % 7 AND p_partkey % 2 = 0)""")
def formula_error_types(t: Tables):
    token = lambda i: F.element_at(F.array(*map(F.lit, TOKENS)), (i % 7 + 1).cast("int"))
    k = F.col("p_partkey")
    raw = F.concat(F.lit("="), token(k), F.when(k % 2 == 0, F.concat(F.lit("+A1*"), token(k + 3))).otherwise(""))
    return t.part.select("p_partkey", F.explode(relations.formula_errors(raw)).alias("e")).select("p_partkey", "e.type", "e.token", "e.message")


@query("""SELECT p_partkey, p_partkey % 9 < 6 OR p_partkey % 9 = 8 AS stands_for_nothing FROM part""")
def placeholder_labels(t: Tables):
    from gridspark.operators.structures import placeholder

    n = F.col("p_partkey").cast("string")
    label = F.element_at(F.array(F.concat(F.lit(" Column "), n), F.concat(F.lit("attr"), n), F.lit("Value"), F.lit("n/a"), F.lit("  "), F.concat(F.lit("placeholder"), n), F.col("p_name"), F.concat(F.lit("column "), n, F.lit("a")), F.lit("EMPTY")), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.part.select("p_partkey", placeholder(label).alias("stands_for_nothing"))


def card_tables(t: Tables):
    """A table for each part brand of a size class as its workbook: its headers are its types, in two levels."""
    wb = F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string"))
    own = t.part.select(wb.alias("wb_id"), F.lit("Parts").alias("sheet"), F.col("p_brand").alias("table_id"), F.concat(F.lit("Stock "), "p_brand").alias("name"), F.when(F.col("p_brand").endswith("1"), "first").alias("description")).distinct()
    types = t.part.select(wb.alias("wb_id"), F.lit("Parts").alias("sheet"), F.col("p_brand").alias("table_id"), F.col("p_type").alias("label")).distinct()
    child = types.select("wb_id", "sheet", "table_id", F.lower("label").alias("header_id"), F.array(F.lit("all"), F.lower("label")).alias("path"), F.col("label").alias("ord"), "label", F.lit(None).cast("string").alias("description"), F.lit("column").alias("orientation"))
    parent = own.select("wb_id", "sheet", "table_id", F.lit("all").alias("header_id"), F.array(F.lit("all")).alias("path"), F.lit("").alias("ord"), F.lit("All types").alias("label"), F.lit("every type").alias("description"), F.lit(None).cast("string").alias("orientation"))
    return own, parent.unionByName(child)


CARDS = """p AS (SELECT DISTINCT 'size' || p_size % 10 AS wb_id, p_brand AS table_id, p_type AS label FROM part), t AS (SELECT wb_id, table_id, string_agg(label || ' (' || lower(label) || ') [column]', '; ' ORDER BY label) AS kids, string_agg('All types > ' || label, '; ' ORDER BY label) AS paths, string_agg('All types > ' || label || ' (' || lower(label) || ') [column]', '; ' ORDER BY label) AS columns, count(*) AS n FROM p GROUP BY 1, 2)"""


@query(f"""WITH {CARDS} SELECT wb_id || ':Parts:' || table_id AS card_id, 'Workbook: ' || wb_id || chr(10) || 'Sheet: Parts' || chr(10) || 'Table: Stock ' || table_id || ' (' || table_id || ')' || chr(10) || CASE WHEN table_id LIKE '%1' THEN 'Description: first' || chr(10) ELSE '' END || 'Headers: All types (all): every type; ' || kids || chr(10) || 'Relations: rel_1 sum of ' || table_id AS card FROM t""")
def cards_full(t: Tables):
    own, headers = card_tables(t)
    rel = own.select("wb_id", "sheet", "table_id", F.lit(1).alias("ord"), F.lit("rel_1").alias("relation_id"), F.concat(F.lit("sum of "), "table_id").alias("description"))
    return cards.table_cards(own, headers, rel).select("card_id", "card")


@query(f"""WITH {CARDS}, s AS (SELECT wb_id, table_id, 'Stock ' || table_id || CASE WHEN table_id LIKE '%1' THEN '. first' ELSE '' END || '. Columns: All types; ' || paths AS summary FROM t),
d AS (SELECT wb_id, string_agg('Stock ' || table_id, '; ' ORDER BY table_id) FILTER (k <= 10) AS described, string_agg(summary, ' ' ORDER BY table_id) FILTER (k <= 8) AS summaries, string_agg('Stock ' || table_id, '; ' ORDER BY table_id) FILTER (k <= 20) AS names FROM (SELECT *, row_number() OVER (PARTITION BY wb_id ORDER BY table_id) AS k FROM s) GROUP BY 1)
SELECT wb_id, described, CASE WHEN length(x) <= 1600 THEN x ELSE rtrim(substr(x, 1, 1597)) || '...' END AS sheet_summary, names FROM (SELECT *, 'Sheet Parts. ' || summaries AS x FROM d)""")
def sheet_payloads(t: Tables):
    made = cards.sheet_payloads(*card_tables(t), t.part.select(F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string")).alias("wb_id"), F.lit("Parts").alias("sheet"), F.lit("text of a sheet").alias("sheet_text")).distinct())
    return made.select("wb_id", F.col("description").alias("described"), "sheet_summary", F.array_join(F.slice("tables.name", 1, 20), "; ").alias("names"))


@query(f"""WITH {CARDS}, k AS (SELECT *, row_number() OVER (PARTITION BY wb_id ORDER BY table_id) AS k FROM t), d AS (SELECT wb_id, count(*) FILTER (k <= 20) AS details, count(*) FILTER (k <= 10) AS book_details FROM k GROUP BY 1)
SELECT wb_id || ':Parts:metadata' AS card_id, CAST(7 + details AS INTEGER) AS lines, CAST(4 + 1 + book_details AS INTEGER) AS book_lines FROM d""")
def metadata_cards(t: Tables):
    payloads = cards.sheet_payloads(*card_tables(t), t.part.select(F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string")).alias("wb_id"), F.lit("Parts").alias("sheet"), F.lit("text of a sheet").alias("sheet_text")).distinct())
    lines = lambda c: F.size(F.split(c, "\n"))
    books = cards.workbook_cards(payloads).select("wb_id", lines("card").alias("book_lines"))
    return cards.sheet_cards(payloads).join(books, "wb_id").select("card_id", lines("card").alias("lines"), "book_lines")


@query(f"WITH {CARDS} SELECT wb_id, table_id, lower(p.label) AS header_id, 'All types > ' || p.label AS column_path FROM p UNION ALL SELECT DISTINCT wb_id, table_id, 'all', 'All types' FROM p")
def column_paths(t: Tables):
    return cards.column_paths(card_tables(t)[1]).select("wb_id", "table_id", "header_id", "column_path")


@query(f"""WITH {CARDS} SELECT wb_id, table_id, '- table_id: ' || table_id || chr(10) || '  name: Stock ' || table_id || chr(10) || '  description: ' || CASE WHEN table_id LIKE '%1' THEN 'first' ELSE '' END || chr(10) || '  sheet: Parts' || chr(10) || '  headers: All types (all): every type' || chr(10) || '  formula_relations: ' || CASE WHEN table_id LIKE '%2' THEN 'rel_1' ELSE '(none)' END AS summary FROM t""")
def table_catalogue(t: Tables):
    own, headers = card_tables(t)
    rel = own.where(F.col("table_id").endswith("2")).select("wb_id", "sheet", "table_id", F.lit("rel_1").alias("relation_id"))
    return cards.catalogue_lines(own, headers, rel).select("wb_id", "table_id", "summary")


@query(f"""WITH {CARDS} SELECT wb_id, table_id, CAST(6 + n + CASE WHEN table_id LIKE '%2' THEN 14 ELSE 0 END AS INTEGER) AS lines, table_id LIKE '%2' AS more FROM t""")
def structure_summary(t: Tables):
    own, headers = card_tables(t)
    many = own.where(F.col("table_id").endswith("2")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(15))))
    rel = many.select("wb_id", "sheet", "table_id", F.concat(F.lit("rel_"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("relation_id"), F.lit("normal").alias("category"), F.lit("A1").alias("range"), F.lit("d").alias("description"), F.lit("=1").alias("formula"))
    made = cards.structure_lines(own, headers, rel)
    return made.select("wb_id", "table_id", F.size(F.split("summary", "\n")).alias("lines"), F.contains("summary", F.lit("... 3 more relations")).alias("more"))


@query("""SELECT doc_id AS card_id, CAST(1 AS INTEGER) AS artifact_version, source || '.xlsx' AS document_name, md5(source) AS workbook_sha256, CASE WHEN lang = 'en' THEN 'structure of ' || source END AS structure_text FROM documents""")
def index_records(t: Tables):
    own = t.documents.select(F.col("doc_id").alias("card_id"), F.col("source").alias("wb_id"), F.col("lang").alias("sheet"))
    books = t.documents.select(F.col("source").alias("wb_id"), F.concat("source", F.lit(".xlsx")).alias("document_name"), F.md5("source").alias("workbook_sha256"), F.lit("s").alias("schema_text"), F.lit("m").alias("workbook_metadata")).distinct()
    structures = t.documents.where("lang = 'en'").select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.concat(F.lit("structure of "), "source").alias("structure_text")).distinct()
    return cards.index_records(own, books, structures).select("card_id", "artifact_version", "document_name", "workbook_sha256", "structure_text")


@query("""WITH r AS (SELECT source AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) FILTER (rank <= 10) AS audit, count(*) AS candidates FROM r GROUP BY 1""")
def rank_audit(t: Tables):
    rank = F.row_number().over(W.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("card_id"), rank.alias("rank"), F.lit(0.5).alias("score"))
    return retrieval.audit(ranked).select("query_id", F.array_join(F.col("audit.card_id").cast("array<string>"), ",").alias("audit"), "candidates")


@query("""SELECT c_custkey + 2 AS row, 'B' AS letter, CASE WHEN (c_custkey - 1) % 7 = 0 AND c_custkey > 0 THEN NULL ELSE c_name END AS s FROM customer WHERE c_custkey + 2 BETWEEN 5 AND 500 AND NOT ((c_custkey - 1) % 7 = 0 AND c_custkey > 0)""")
def sheet_frame_bounds(t: Tables):
    cells, _ = merged_sheet(t)
    return reads.sheet_frame(cells, reads.sheet_bounds(cells), 5, 500, 2, 2).select("row", "letter", "s")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'h' || p_partkey ELSE replace(p_name, ' ', '_') END AS header_id, p_name AS label, CASE WHEN p_partkey % 4 = 1 THEN 'row' ELSE 'column' END AS orientation, CASE WHEN p_partkey % 5 < 2 THEN 'B' || (p_partkey + 1) END AS header_range FROM part""")
def headers_normalised(t: Tables):
    from gridspark.operators.structures import normalised

    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    rows = t.part.select(
        "p_partkey", F.when(k % 3 == 0, F.concat(F.lit(" h"), n)).when(k % 3 == 1, " ").alias("header_id"), F.concat(F.lit(" "), "p_name").alias("label"), F.when(k % 4 == 1, " ROW").when(k % 4 == 2, "diagonal").alias("orientation"),
        F.when(k % 5 < 2, F.concat(F.lit("B"), (k + 1).cast("string"), F.lit(" "))).when(k % 5 == 2, "Unknown").when(k % 5 == 3, "?").alias("header_range"), F.lit("n/a").alias("data_range"),
    )
    return normalised(rows).where("data_range is null").select("p_partkey", "header_id", "label", "orientation", "header_range")
