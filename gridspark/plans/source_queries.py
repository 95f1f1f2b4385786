"""Queries over tables in texts; HTML, LaTeX and JSON are built from rows, so that the rows are the expected cells."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.plans.register import Register, Tables
from gridspark.sources import tables, workbooks

REGISTER = query = Register()




def by_customer(t: Tables, line, head: str, tail: str):
    """One text for each nation: a line of its customers, in order of key."""
    lines = t.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("x")))).alias("x"))
    return lines.select("doc_id", F.concat(F.lit(head), F.array_join("x.x", tail if tail == "," else ""), F.lit({",": "]}"}.get(tail, tail))).alias("text"))


CELLS = """WITH r AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row, c_name, c_mktsegment FROM customer)
SELECT doc_id, row, CAST(1 AS INTEGER) AS col, c_name AS s FROM r UNION ALL SELECT doc_id, row, 2, c_mktsegment FROM r"""


@query(CELLS)
def html_table_cells(t: Tables):
    line = F.concat(F.lit("<tr><td>"), "c_name", F.lit("</td><td> <b>"), "c_mktsegment", F.lit("</b></td></tr>"))
    return tables.parsed_cells(by_customer(t, line, "<p>x</p><table>", "</table><table><tr><td>2</td></tr></table>"), tables.html_rows).select("doc_id", "row", "col", "s")


@query(CELLS)
def latex_table_cells(t: Tables):
    line = F.concat(F.lit("\\hline \\textbf{"), F.regexp_replace("c_name", "#", r"\\#"), F.lit("} & "), "c_mktsegment", F.lit(" \\\\ "))
    return tables.parsed_cells(by_customer(t, line, "\\begin{tabular}{ll} ", "\\end{tabular}"), tables.latex_rows).select("doc_id", "row", "col", "s")


@query(CELLS)
def json_table_cells(t: Tables):
    line = F.concat(F.lit('["'), "c_name", F.lit('","'), "c_mktsegment", F.lit('"]'))
    return tables.parsed_cells(by_customer(t, line, '{"title":"t","texts":[', ","), tables.json_rows).select("doc_id", "row", "col", "s")


@query("""WITH l AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i]) AS line FROM documents, range(1, 2000) r(i) WHERE i <= len(string_split(text, chr(10)))),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS row FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[|\\s:+-]*-{3,}[|\\s:+-]*$')),
p AS (SELECT doc_id, row, CASE WHEN contains(line, '|') THEN string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|') ELSE [line] END AS parts FROM k)
SELECT doc_id, CAST(row AS INTEGER) AS row, count(*) AS cells, CAST(sum(length(trim(s))) AS BIGINT) AS chars FROM (SELECT doc_id, row, unnest(parts) AS s FROM p) GROUP BY 1, 2""")
def text_table_cells(t: Tables):
    return tables.text_cells(t.documents).groupBy("doc_id", "row").agg(F.count("*").alias("cells"), F.sum(F.length("s")).alias("chars"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS row, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey),
h AS (SELECT n_regionkey, n_nationkey, n_name, max(row) AS height FROM r GROUP BY ALL), o AS (SELECT *, coalesce(sum(height + 3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM h)
SELECT n_regionkey, CAST(off + 1 AS BIGINT) AS row, n_name AS s FROM o UNION ALL SELECT n_regionkey, CAST(row + off + 1 AS BIGINT), c_name FROM r JOIN o USING (n_regionkey, n_nationkey)""")
def stack_tables(t: Tables):
    place = F.row_number().over(W.Window.partitionBy("n_nationkey").orderBy("c_custkey"))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = joined.select("n_regionkey", F.col("n_nationkey").alias("ord"), place.alias("row"), F.lit(1).alias("col"), F.col("c_name").alias("s"))
    titles = joined.select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title")).distinct()
    return tables.stacked(cells, titles, "n_regionkey").select("n_regionkey", "row", "s")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row, '| ' || n_nationkey || ' | ' || n_name || '\\|x |' AS line FROM nation")
def markdown_rows(t: Tables):
    row = F.row_number().over(W.Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    cells = t.nation.withColumn("row", row).select(F.col("n_regionkey").cast("bigint").alias("doc_id"), "row", F.inline(F.array(F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("s")), F.struct(F.lit(2).alias("col"), F.concat("n_name", F.lit("|x")).alias("s")))))
    return tables.markdown_rows(cells)


@query("""WITH f AS (SELECT doc_id AS ord, source AS name, md5(text) AS h FROM documents), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY h ORDER BY ord) = 1)
SELECT ord, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || substr(h, 1, 8) || ')' ELSE name END AS name FROM k""")
def workbook_normalise(t: Tables):
    files = t.documents.select(F.col("doc_id").alias("ord"), F.col("source").alias("name"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    return workbooks.normalise(files).select("ord", "name")


@query("""WITH r AS (SELECT c_custkey // 10 AS doc_id, CAST(row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS INTEGER) AS ord, c_name, c_mktsegment FROM customer)
SELECT doc_id, ord, CAST(1 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, c_name AS s FROM r UNION ALL SELECT doc_id, ord, 1, 2, c_mktsegment FROM r""")
def payload_cells(t: Tables):
    """Payloads of ten customers' tables, of one row each."""
    one = F.struct("c_custkey", F.col("c_name").alias("title"), F.array(F.array("c_name", "c_mktsegment")).alias("texts"))
    docs = t.customer.groupBy(F.floor(F.col("c_custkey") / 10).alias("doc_id")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("tables"))).alias("text"))
    return tables.payload_cells(docs).select("doc_id", "ord", "row", "col", "s")
