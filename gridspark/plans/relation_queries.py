"""Queries over formulas and table descriptions; formulas and headers are made from the rows and schemas of tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.addressing import BOX, LAST_ROW
from gridspark.functions.formula_code import formula_column
from gridspark.operators import reads, recalculation, relations, structures
from gridspark.plans.register import Register, Tables

REGISTER = query = Register()

#: A sheet for each part of the orders: rows are lines, column F is priced, G is aggregated now and then, H may be broken.
FORMULAS = "f AS (SELECT l_suppkey AS wb, l_orderkey * 8 + l_linenumber AS row, l_quantity, l_linenumber FROM lineitem)"


def formulas(t: Tables, lines=None):
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row")
    base = (t.lineitem if lines is None else lines).select(F.col("l_suppkey").cast("string").alias("wb_id"), F.lit("lines").alias("sheet"), row, "l_linenumber", "l_quantity")
    n = F.col("row").cast("string")
    price = F.concat(F.lit("=D"), n, F.lit("*(1-E"), n, F.lit(")*$H$1"))
    total = F.concat(F.lit("=SUM(B"), n, F.lit(":E"), n, F.lit(")"))
    broken = F.when(F.col("l_quantity") > 45, F.lit("=#REF!+1")).otherwise(F.concat(F.lit("=IF(B"), n, F.lit('>10,"NG","OK")')))
    cells = F.array(F.struct(F.lit(6).alias("col"), price.alias("raw")), F.struct(F.lit(7).alias("col"), F.when(F.col("l_linenumber") == 1, total).alias("raw")), F.struct(F.lit(8).alias("col"), broken.alias("raw")))
    return base.select("wb_id", "sheet", "row", "l_quantity", F.inline(cells)).where("raw is not null")


def formulas_once(t: Tables):
    """formulas() with one formula a cell, the broken one of several: lines are brought together before they become texts."""
    return formulas(t, t.lineitem.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")))


@query(f"WITH {FORMULAS} SELECT CAST(wb AS VARCHAR) AS wb_id, row, 'broken_reference' AS type, '#REF!' AS token FROM f WHERE l_quantity > 45")
def formula_errors(t: Tables):
    found = formulas(t).select("wb_id", "row", F.explode(relations.formula_errors(F.col("raw"))).alias("e"))
    return found.select("wb_id", "row", "e.type", "e.token")


@query(f"""WITH {FORMULAS} SELECT form, count(*) AS n FROM (SELECT '=[col_offset=-2,row_offset=0]*(1-[col_offset=-1,row_offset=0])*[$H,$1]' AS form FROM f UNION ALL SELECT '=SUM([col_offset=-5,row_offset=0]:[col_offset=-2,row_offset=0])' FROM f WHERE l_linenumber = 1
UNION ALL SELECT '=#REF!+1' FROM f WHERE l_quantity > 45 UNION ALL SELECT '=IF([col_offset=-6,row_offset=0]>10,"NG","OK")' FROM f WHERE l_quantity <= 45) GROUP BY 1""")
def formula_normalise(t: Tables):
    form = relations.normal_form(F.col("raw"), F.col("row"), F.col("col"))
    return formulas(t).select(form.alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, '=D' || (l_orderkey + 3) || '*(1-F' || (l_orderkey + 5) || ')*$H$1+IF($B' || (l_orderkey + 3) || '>1,\"D1\",0)' AS moved FROM lineitem")
def relation_fill(t: Tables):
    n = F.col("l_orderkey")
    raw = F.concat(F.lit("=C"), (n + 1).cast("string"), F.lit("*(1-E"), (n + 3).cast("string"), F.lit(")*$H$1+IF($B"), (n + 1).cast("string"), F.lit('>1,"D1",0)'))
    return t.lineitem.select("l_orderkey", "l_linenumber", relations.shifted(raw, F.lit(2), F.lit(1)).alias("moved"))


def tables_of(t: Tables):
    """Three tables to a sheet, one below the other over its lines; columns B to E."""
    place = F.ntile(3).over(W.Window.partitionBy("wb_id", "sheet").orderBy("row"))
    lines = t.lineitem.select(F.col("l_suppkey").cast("string").alias("wb_id"), F.lit("lines").alias("sheet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    return lines.withColumn("p", place).groupBy("wb_id", "sheet", F.concat(F.lit("t"), F.col("p").cast("string")).alias("table_id")).agg(F.min("row").alias("r1"), F.lit(2).alias("c1"), F.max("row").alias("r2"), F.lit(5).alias("c2"))


TABLES = "tb AS (SELECT wb, 't' || p AS table_id, min(row) AS r1, max(row) AS r2 FROM (SELECT wb, row, ntile(3) OVER (PARTITION BY wb ORDER BY row) AS p FROM f) GROUP BY 1, 2)"


@query(f"""WITH {FORMULAS}, {TABLES}, c AS (SELECT wb, row, 6 AS col FROM f UNION ALL SELECT wb, row, 7 FROM f WHERE l_linenumber = 1 UNION ALL SELECT wb, row, 8 FROM f)
SELECT CAST(wb AS VARCHAR) AS wb_id, table_id, row, CAST(col AS INTEGER) AS col FROM c JOIN tb USING (wb) WHERE row BETWEEN r1 AND r2 + 5""")
def formula_assign(t: Tables):
    return relations.assign_formulas(formulas(t), tables_of(t)).select("wb_id", "table_id", "row", "col")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS k, l_orderkey * 8 + l_linenumber AS row, i AS col FROM lineitem, range(1, 4) r(i) WHERE i <= 1 + l_linenumber % 3),
v AS (SELECT *, row - row_number() OVER (PARTITION BY k, col ORDER BY row) AS g FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY k, col, g) AS n FROM v),
tall AS (SELECT k, min(row) AS r1, col AS c1, max(row) AS r2, col AS c2, 'rows' AS shape FROM s WHERE n > 1 GROUP BY k, col, g),
w AS (SELECT k, row, col, col - row_number() OVER (PARTITION BY k, row ORDER BY col) AS h FROM s WHERE n = 1)
SELECT k, r1, CAST(c1 AS INTEGER) AS c1, r2, CAST(c2 AS INTEGER) AS c2, shape FROM tall UNION ALL SELECT k, row, CAST(min(col) AS INTEGER), row, CAST(max(col) AS INTEGER), CASE WHEN count(*) > 1 THEN 'columns' ELSE 'single' END FROM w GROUP BY k, row, h""")
def runs_vertical_horizontal(t: Tables):
    cells = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.explode(F.sequence(F.lit(1), (1 + F.col("l_linenumber") % 3).cast("int"))).alias("col"))
    return relations.runs(cells, ["k"])


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS wb, l_orderkey * 8 + l_linenumber AS row FROM lineitem),
v AS (SELECT wb, row - row_number() OVER (PARTITION BY wb ORDER BY row) AS g FROM f), g AS (SELECT wb, g, count(*) AS n FROM v GROUP BY 1, 2)
SELECT CAST(wb AS VARCHAR) AS wb_id, count(*) FILTER (n > 1) AS normal, count(*) FILTER (n = 1) AS cell FROM g GROUP BY 1""")
def relation_counts(t: Tables):
    priced = formulas_once(t).where("col = 6")
    whole = formulas(t).where("col = 6").groupBy("wb_id", "sheet").agg(F.min("row").alias("r1"), F.lit(2).alias("c1"), F.max("row").alias("r2"), F.lit(5).alias("c2")).withColumn("table_id", F.lit("t"))
    found = relations.extract_relations(priced, whole)
    return found.groupBy("wb_id").agg(F.count_if(F.col("category") == "normal").alias("normal"), F.count_if(F.col("category") == "cell").alias("cell"))


@query("""WITH h AS (SELECT * FROM (VALUES ('t', 'all', 1, 2, 1, 1000000, 5, false), ('t', 'pair', 2, 2, 1, 1000000, 3, false), ('t', 'b', 3, 2, 1, 1000000, 2, false), ('t', 'top', 4, 1, 1, 40, 9, true)) v(table_id, header_id, ord, c1, r1, r2, c2, by_row)),
r AS (SELECT l_orderkey * 8 + l_linenumber AS ref_id, l_orderkey AS r1, l_orderkey + l_linenumber AS r2, 2 + l_linenumber % 2 AS c1, 2 + l_linenumber % 2 + l_suppkey % 3 AS c2 FROM lineitem)
SELECT ref_id, arg_min(header_id, rank) AS header_id FROM (SELECT ref_id, header_id, ((NOT (h.c1 <= r.c1 AND h.c2 >= r.c2 AND h.r1 <= r.r1 AND h.r2 >= r.r2))::INT * 1000 + (h.c2 - h.c1)) * 10 + ord AS rank FROM r JOIN h ON CASE WHEN by_row THEN h.r1 <= r.r1 AND h.r2 >= r.r2 ELSE h.c1 <= r.c1 AND h.c2 >= r.c2 END) GROUP BY 1""")
def narrowest_header(t: Tables):
    headers = t.spark.createDataFrame([("t", "all", 1, 2, 1, 1000000, 5, False), ("t", "pair", 2, 2, 1, 1000000, 3, False), ("t", "b", 3, 2, 1, 1000000, 2, False), ("t", "top", 4, 1, 1, 40, 9, True)], "table_id string, header_id string, ord int, c1 bigint, r1 bigint, r2 bigint, c2 bigint, by_row boolean")
    c1 = 2 + F.col("l_linenumber") % 2
    refs = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"), F.lit("t").alias("table_id"), F.col("l_orderkey").alias("r1"), c1.alias("c1"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("r2"), (c1 + F.col("l_suppkey") % 3).alias("c2"))
    return relations.narrowest_header(refs, headers)


@query("""SELECT CAST(m AS INTEGER) AS scenario, l_orderkey, l_linenumber, round(l_extendedprice * (1 - m / 10.0), 4) AS value FROM lineitem, (SELECT unnest([1, 2]) AS m) WHERE (l_orderkey + m) % 2 = 0""")
def recalc_pattern(t: Tables):
    keys, inputs = ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_discount"]
    rows = t.lineitem.select(*keys, *inputs)
    changed = rows.withColumn("scenario", F.explode(F.array(F.lit(1), F.lit(2)))).where((F.col("l_orderkey") + F.col("scenario")) % 2 == 0).select("scenario", *keys, F.lit("l_discount").alias("column"), (F.col("scenario") / 10).alias("value"))
    found = relations.recalculate_rows(rows, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), changed, keys, inputs)
    return found.select("scenario", *keys, "value")


@query("""WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, sum(q) AS q FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'o' || l_orderkey AS cell, q AS value FROM l UNION ALL SELECT 'c' || o_custkey, q FROM c UNION ALL SELECT 'n' || c_nationkey, sum(q) FROM c JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
def recalc_graph(t: Tables):
    name = lambda p, *c: F.concat(F.lit(p), *(x for k in c for x in (F.col(k).cast("string"), F.lit("_")))) if len(c) > 1 else F.concat(F.lit(p), F.col(c[0]).cast("string"))
    line = name("l", "l_orderkey", "l_linenumber")
    constants = t.lineitem.groupBy(F.lit(0).alias("scenario"), line.alias("cell")).agg(F.sum("l_quantity").alias("value"))
    edge = lambda df, cell, ref: df.select(F.lit(0).alias("scenario"), cell.alias("cell"), ref.alias("ref"), F.lit(1.0).alias("weight"))
    sold = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    buyers = t.customer.join(sold.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    edges = edge(t.lineitem.select("l_orderkey", "l_linenumber").distinct(), name("o", "l_orderkey"), line).unionByName(edge(sold, name("c", "o_custkey"), name("o", "o_orderkey"))).unionByName(edge(buyers, name("n", "c_nationkey"), name("c", "c_custkey")))
    return relations.recalculate_graph(edges, constants).where("cell not like 'l%'").select("cell", "value")


@query("""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS r FROM orders),
v AS (SELECT *, CASE WHEN r % 3 = 0 THEN 1000.0 ELSE o_totalprice END AS a FROM o), w AS (SELECT *, sum(a) OVER (PARTITION BY o_custkey ORDER BY r) AS b FROM v),
x AS (SELECT *, CASE WHEN b > 500000 THEN 'high' END AS s, CASE WHEN b <= 500000 THEN a * 0.1 END AS n FROM w)
SELECT CAST(o_custkey AS VARCHAR) AS wb_id, 'Orders' AS sheet, CAST(r AS BIGINT) AS row, CAST(2 AS BIGINT) AS col, round(b, 4) AS n, NULL AS s, 'value' AS state FROM x
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'Orders', r, 3, round(n, 4), s, 'value' FROM x
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'Sums', 1, 1, round(coalesce(sum(n), 0), 4), NULL, 'value' FROM x GROUP BY o_custkey
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'Sums', 2, 1, count(n), NULL, 'value' FROM x GROUP BY o_custkey
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'Sums', CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 4 END, 1, NULL, NULL, CASE WHEN o_custkey % 2 = 0 THEN 'circular' ELSE 'error' END FROM x GROUP BY o_custkey""")
def recalc_formulas(t: Tables):
    """A workbook a customer, a row an order: a running total, a test on it, sums of both from another sheet, a circle or a fault; every third price is another."""
    row, wb = F.col("row"), F.col("o_custkey").cast("string").alias("wb_id")
    orders = t.orders.select(wb, "o_totalprice", (F.row_number().over(W.Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1).cast("bigint").alias("row"))
    text = lambda pattern: F.format_string(pattern.replace("{r}", "%1$d").replace("{p}", "%2$d"), row, row - 1)
    entry = lambda col, n, formula: F.struct(F.lit(col).alias("col"), n.cast("double").alias("n"), formula.cast("string").alias("formula"))
    blank = F.lit(None)
    lines = F.array(entry(1, F.col("o_totalprice"), blank), entry(2, blank, F.when(row == 2, F.lit("=A2")).otherwise(text("=A{r}+B{p}"))), entry(3, blank, text('=IF(B{r}>500000,"high",A{r}*10%%)')))
    cells = orders.select("wb_id", F.lit("Orders").alias("sheet"), "row", F.inline(lines))
    sums = orders.groupBy("wb_id").agg(F.max("row").alias("row"))
    last = F.when(F.col("wb_id").cast("bigint") % 2 == 0, F.struct(F.lit(3).cast("bigint").alias("row"), F.lit("=A3+1").alias("formula"))).otherwise(F.struct(F.lit(4).cast("bigint").alias("row"), F.lit("=A9+1").alias("formula")))
    named = lambda r, formula: F.struct(F.lit(r).cast("bigint").alias("row"), formula.alias("formula"))
    totals = sums.select("wb_id", F.lit("Sums").alias("sheet"), F.inline(F.array(named(1, text("=SUM(Orders!C2:C{r})")), named(2, text("=COUNT(Orders!C2:C{r})")), last))).select("wb_id", "sheet", "row", F.lit(1).alias("col"), blank.cast("double").alias("n"), "formula")
    cells = cells.unionByName(totals).select("*", blank.cast("string").alias("s"), blank.cast("boolean").alias("b"))
    changed = cells.where("sheet = 'Orders' and col = 1 and row % 3 = 0").select("wb_id", "sheet", "row", "col", F.lit(1000.0).alias("n"))
    asked = sums.select("wb_id", blank.cast("string").alias("sheet"), blank.cast("bigint").alias("row"), blank.cast("int").alias("col"), blank.cast("double").alias("n"))
    mutations = changed.unionByName(asked).select(F.lit("cheap").alias("scenario"), "*", blank.cast("string").alias("s"), blank.cast("boolean").alias("b"))
    found = recalculation.recalculate(cells, mutations)
    return found.select("wb_id", "sheet", "row", "col", F.round("n", 4).alias("n"), "s", "state")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN round(l_extendedprice * (1 + l_tax), 4) ELSE 0 END AS gross FROM lineitem""")
def recalc_column(t: Tables):
    """Two relations' texts as Columns over all rows."""
    named = lambda sheet, row, col: F.col(("l_extendedprice", "l_discount", "l_tax", "l_quantity")[col - 1])
    net, gross = (formula_column(x, named) for x in ("=A2*(1-B2)", "=IF(D2>25,A2*(1+C2),0)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"), F.round(gross, 4).alias("gross"))


def described(t: Tables):
    """One table of three headers for each nation's customers: a parent over two children, with faults by key."""
    ends = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg((F.max("c_custkey") + 2).alias("last"))
    box = lambda r1, c1, r2, c2: F.struct(F.lit(None).cast("string").alias("sheet"), *(F.lit(x).cast("bigint").alias(n) if isinstance(x, int) else x.cast("bigint").alias(n) for n, x in zip(("r1", "c1", "r2", "c2"), (r1, c1, r2, c2), strict=True))).cast(BOX)
    k, last = F.col("k"), F.col("last")
    h = lambda i, parent, path, label, orientation, hr, dr: F.struct(F.lit(i).alias("header_id"), F.lit(parent).cast("string").alias("parent_id"), F.array(*map(F.lit, path)).alias("path"), F.lit(len(path)).alias("ord"), label.alias("label"), orientation.alias("orientation"), hr.alias("hr"), dr.alias("dr"))
    column = F.lit("column")
    rows = F.array(
        h("who", None, ["who"], F.when(k % 3 == 0, "Wrong").otherwise("c_name"), F.when(k == 4, "diagonal").otherwise(column), box(1, 2, 1, 2), box(F.when(k % 5 == 0, 1).otherwise(2), 2, last, 2)),
        h("seg", None, ["seg"], F.lit("c_mktsegment"), column, box(1, 5, 1, F.when(k % 4 == 1, 6).otherwise(5)), box(2, 5, F.when(k % 6 == 2, last + 9).otherwise(last), 5)),
        h("kid", "who", ["who", "kid"], F.lit("x"), column, box(F.when(k % 2 == 0, 1).otherwise(2), 2, 2, 2), F.when(k % 7 != 3, box(3, 2, last, 2))),
    )
    headers = ends.select(k.cast("string").alias("wb_id"), F.lit("customer").alias("sheet"), F.lit("t1").alias("table_id"), F.inline(rows))
    cells = reads.cells_from_table(t.customer, "customer", F.col("c_custkey"))
    body = cells.where("row > 1").join(t.customer.select((F.col("c_custkey") + 2).alias("row"), F.col("c_nationkey").cast("string").alias("k")), "row").withColumn("wb_id", F.col("k")).drop("k").select(cells.columns)
    names = F.posexplode(F.array(*map(F.lit, t.customer.columns))).alias("i", "s")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    head = ends.select(k.cast("string").alias("wb_id"), names).select("wb_id", F.lit("customer").alias("sheet"), F.lit(1).cast("bigint").alias("row"), (F.col("i") + 1).alias("col"), F.lit("text").alias("kind"), "s", none("double", "n"), none("boolean", "b"), none("timestamp", "ts"), none("string", "formula"))
    return headers, body.unionByName(head)


def no_merges(t: Tables):
    return t.spark.createDataFrame([], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")


@query("""WITH e AS (SELECT c_nationkey AS k, max(c_custkey) + 2 AS last FROM customer GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS wb_id, header_id, rule, severity FROM (
  SELECT k, 'who' AS header_id, 'orientation' AS rule, 'error' AS severity FROM e WHERE k = 4
  UNION ALL SELECT k, 'who', 'label_repaired', 'action' FROM e WHERE k % 3 = 0
  UNION ALL SELECT k, 'who', 'data_shifted', 'action' FROM e WHERE k % 5 = 0
  UNION ALL SELECT k, 'seg', 'hr_unused', 'error' FROM e WHERE k % 4 = 1
  UNION ALL SELECT k, 'seg', 'data_realigned', 'action' FROM e WHERE k % 4 = 1
  UNION ALL SELECT k, 'seg', 'dr_unused', 'error' FROM e WHERE k % 6 = 2
  UNION ALL SELECT k, 'kid', 'child_data_missing', 'error' FROM e WHERE k % 7 = 3
  UNION ALL SELECT k, 'kid', 'child_header_outside', 'error' FROM e WHERE k % 2 = 0)""")
def verify_structure(t: Tables):
    headers, cells = described(t)
    rules = ["orientation", "label_repaired", "data_shifted", "hr_unused", "data_realigned", "dr_unused", "child_data_missing", "child_header_outside"]
    found = structures.verify(headers, cells, no_merges(t)).where(F.col("rule").isin(rules))
    named = (F.col("rule") == "label_repaired") & (F.col("header_id") == "kid")
    return found.where(~named).select("wb_id", "header_id", "rule", "severity")


def described_merges(t: Tables):
    """Merges of the sheets of described(): two rows in column B at every seventh customer, and E1:F1 of every fourth nation."""
    sheet = [F.col("c_nationkey").cast("string").alias("wb_id"), F.lit("customer").alias("sheet")]
    box = lambda *x: [c.cast("bigint").alias(n) for n, c in zip(("r1", "c1", "r2", "c2"), x, strict=True)]
    body = t.customer.where("c_custkey % 7 = 0").select(*sheet, *box(F.col("c_custkey") + 2, F.lit(2), F.col("c_custkey") + 3, F.lit(2)))
    head = t.customer.where("c_nationkey % 4 = 2").select(*sheet, *box(*map(F.lit, (1, 5, 1, 6)))).distinct()
    return body.unionByName(head)


@query()
def verify_structure_all(t: Tables):
    """Every finding of every rule, with merged areas; verify_structure holds the rules that its SQL states."""
    headers, cells = described(t)
    return structures.verify(headers, cells, described_merges(t)).select("wb_id", "header_id", "rule", "severity", "detail")


def faulty(t: Tables):
    """Tables of one header, and of parents and children, over each nation's customers (of nations with three or more), each with a fault of its own."""
    key, name = F.col("c_custkey"), F.col("c_name")
    ends = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg((F.min(key) + 2).alias("f"), (F.max(key) + 2).alias("l"), F.min_by(name, key).alias("low"), F.max_by(name, key).alias("high"), F.count("*").alias("n")).where("n > 2")
    k, f, l, low, high = (F.col(x) for x in ("k", "f", "l", "low", "high"))  # noqa: E741
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    box = lambda *x: F.struct(F.lit(None).cast("string").alias("sheet"), *(lit(v).cast("bigint").alias(n) for n, v in zip(("r1", "c1", "r2", "c2"), x, strict=True))).cast(BOX)
    none, column, number = F.lit(None).cast(BOX), F.lit("column"), k.cast("string")

    def h(i, label, hr, dr, parent=None, turn=column):
        path = [parent, i] if parent else [i]
        return F.struct(F.lit(f"t_{parent or i}").alias("table_id"), F.lit(i).alias("header_id"), F.lit(parent).cast("string").alias("parent_id"), F.array(*map(F.lit, path)).alias("path"), F.lit(len(path)).alias("ord"), label.alias("label"), turn.alias("orientation"), hr.alias("hr"), dr.alias("dr"))

    a, b, c, d, e = (F.lit(x) for x in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    rows = F.array(
        h("edge", b, box(1, 2, 1, 2), box(2, 2, LAST_ROW + 1, 2)), h("above", c, box(0, 3, 1, 3), box(2, 3, l, 3)),
        h("over", e, box(1, 5, 1, 5), box(1, 5, 1, 7), turn=F.lit("row")), h("blank", b, box(1, 2, 1, 2), box(2, 2, 2, 2)), h("under", high, box(l, 2, l, 2), box(l + 1, 2, l + 3, 2)),
        h("void", number, box(2, 3, 2, 3), box(3, 3, l, 3)), h("many", F.lit("c_acctbal c_mktsegment"), box(1, 4, 1, 5), box(2, 4, l, 5)), h("merged", a, box(1, 1, 1, 1), box(3, 1, l, 1)),
        h("turned", c, box(1, 3, 1, 3), box(2, 3, l, 3), turn=F.when(k % 4 == 0, "diagonal").otherwise(column)), h("shift", c, box(1, 3, 1, 3), box(1, 3, l, 3)),
        h("aside", d, box(1, 4, 1, 4), box(2, 4, l, 5)), h("named", F.lit("segment"), box(1, 5, 1, 5), box(2, 5, l, 5)), h("p", b, box(1, 2, 1, 2), box(l, 2, l, 2)), h("kid", low, box(f, 2, f, 2), box(f + 1, 2, l, 2), "p"),
        h("q", b, box(1, 2, 1, 2), none), h("a", low, box(f, 2, f, 2), none, "q"), h("b", high, box(l, 2, l, 2), none, "q"),
        h("r", c, box(1, 3, 1, 3), box(2, 3, l, 3)), h("s", number, box(f, 3, f, 3), box(f + 1, 3, l, 3), "r"), h("v", d, box(1, 4, 1, 4), none), h("u", e, box(1, 5, 1, 5), box(2, 5, l, 5), "v"),
    )
    headers = ends.select(number.alias("wb_id"), F.lit("customer").alias("sheet"), F.inline(rows))
    merges = ends.where("k % 4 = 2 and f > 2").select(number.alias("wb_id"), F.lit("customer").alias("sheet"), *(F.lit(x).cast("bigint").alias(n) for n, x in (("r1", 1), ("c1", 1), ("r2", 2), ("c2", 1))))
    return headers, merges


@query("""WITH e AS (SELECT c_nationkey AS k, min(c_custkey) + 2 AS f, max(c_custkey) + 2 AS l FROM customer GROUP BY 1 HAVING count(*) > 2),
n AS (SELECT c_nationkey AS k, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
m AS (SELECT k, string_agg(c_name, ', ' ORDER BY c_custkey) AS names FROM n WHERE i > 1 AND i < n AND i <= 9 GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS wb_id, header_id, rule, severity, detail FROM (
  SELECT k, 'edge' AS header_id, 'dr_bounds' AS rule, 'error' AS severity, 'B2:B1048577' AS detail FROM e
  UNION ALL SELECT k, 'edge', 'dr_unused', 'error', 'B2:B1048577' FROM e
  UNION ALL SELECT k, 'above', 'hr_bounds', 'error', 'C0:C1' FROM e
  UNION ALL SELECT k, 'above', 'hr_unused', 'error', 'C0:C1' FROM e
  UNION ALL SELECT k, 'over', 'dr_unused', 'error', 'E1:G1' FROM e
  UNION ALL SELECT k, 'over', 'data_overlaps', 'error', 'E1:G1' FROM e
  UNION ALL SELECT k, 'blank', 'data_repaired', 'action', 'B2:B' || l FROM e WHERE f > 2
  UNION ALL SELECT k, 'under', 'dr_unused', 'error', 'B' || (l + 1) || ':B' || (l + 3) FROM e
  UNION ALL SELECT k, 'under', 'data_blank', 'error', 'B' || (l + 1) || ':B' || (l + 3) FROM e
  UNION ALL SELECT k, 'void', 'header_blank', 'error', 'C2' FROM e WHERE f > 2
  UNION ALL SELECT k, 'many', 'header_texts', 'error', 'c_acctbal | c_mktsegment' FROM e
  UNION ALL SELECT k, 'merged', 'header_merged', 'action', 'A1:A2' FROM e WHERE k % 4 = 2 AND f > 2
  UNION ALL SELECT k, 'turned', 'orientation', 'error', 'diagonal' FROM e WHERE k % 4 = 0
  UNION ALL SELECT k, 'shift', 'data_shifted', 'action', 'C2:C' || l FROM e
  UNION ALL SELECT k, 'aside', 'data_realigned', 'action', 'D2:D' || l FROM e
  UNION ALL SELECT k, 'named', 'label_repaired', 'action', 'c_mktsegment' FROM e
  UNION ALL SELECT k, 'kid', 'child_data_outside', 'error', 'B' || (f + 1) || ':B' || l FROM e
  UNION ALL SELECT k, 'a', 'child_data_missing', 'error', 'a' FROM e
  UNION ALL SELECT k, 'b', 'child_data_missing', 'error', 'b' FROM e
  UNION ALL SELECT k, 'q', 'children_uncovered', 'error', names FROM e JOIN m USING (k)
  UNION ALL SELECT k, 's', 'parent_data_over_child', 'action', 'C2:C' || l FROM e
  UNION ALL SELECT k, 'u', 'child_header_outside', 'error', 'E1' FROM e
  UNION ALL SELECT k, 'v', 'children_uncovered', 'error', 'c_acctbal' FROM e)""")
def verify_faults(t: Tables):
    """Every finding of every rule with its detail, over tables that have one fault each."""
    headers, merges = faulty(t)
    return structures.verify(headers, described(t)[1], merges).select("wb_id", "header_id", "rule", "severity", "detail")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS wb_id, h AS header_id, h <> 'who' AS has_header, NOT (h = 'seg' AND c_nationkey % 2 = 0) AND NOT (h = 'kid' AND c_nationkey % 7 = 3) AS has_data FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest(['who', 'seg', 'kid']) AS h)")
def null_fields(t: Tables):
    headers, _ = described(t)
    key = ["wb_id", "sheet", "table_id", "header_id"]
    fields = headers.where("header_id = 'who'").select(*key, F.lit("hr").alias("field")).unionByName(headers.where("header_id = 'seg' and wb_id % 2 = 0").select(*key, F.lit("dr").alias("field")))
    return structures.null_fields(headers, fields).select("wb_id", "header_id", F.col("hr").isNotNull().alias("has_header"), F.col("dr").isNotNull().alias("has_data"))


@query("SELECT source AS wb_id, lang AS sheet, bool_or(length(text) >= 60) AS valid, CAST(1 AS BIGINT) AS tables FROM documents GROUP BY 1, 2")
def structure_valid(t: Tables):
    labels = t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.lit("t1").alias("table_id"), F.when(F.length("text") >= 60, F.lit("Region")).otherwise("column 3").alias("label"))
    return structures.valid_structures(labels)


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS wb_id, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 5 END AS r1, CASE WHEN c_nationkey % 2 = 0 THEN max(c_custkey) + 20 ELSE max(c_custkey) + 2 END AS r2 FROM customer GROUP BY c_nationkey""")
def structure_merge(t: Tables):
    headers, _ = described(t)
    new = headers.where("header_id = 'seg'").withColumn("hr", F.struct(F.lit(None).cast("string").alias("sheet"), F.lit(1).cast("bigint").alias("r1"), F.lit(5).cast("bigint").alias("c1"), F.lit(1).cast("bigint").alias("r2"), F.lit(5).cast("bigint").alias("c2")))
    end = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("wb_id")).agg(F.max("c_custkey").alias("last"))
    data = lambda a, z: F.struct(F.lit(None).cast("string").alias("sheet"), F.lit(a).cast("bigint").alias("r1"), F.lit(5).cast("bigint").alias("c1"), z.cast("bigint").alias("r2"), F.lit(5).cast("bigint").alias("c2")).cast(BOX)
    joined = new.join(end, "wb_id")
    latest, older = joined.withColumn("dr", data(5, F.col("last") + 2)), joined.where("wb_id % 2 = 0").withColumn("dr", data(1, F.col("last") + 20))
    return structures.merge_versions(latest.drop("last"), older.drop("last")).select("wb_id", F.col("dr.r1").cast("int").alias("r1"), F.col("dr.r2").alias("r2"))


@query("SELECT source AS wb_id, lang AS sheet, 'table1' AS table_id, count(*) AS rows FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0) GROUP BY 1, 2")
def fallback_structure(t: Tables):
    sheets = t.documents.groupBy(F.col("source").alias("wb_id"), F.col("lang").alias("sheet")).agg(F.count("*").alias("used"))
    odd = t.documents.groupBy(F.col("source").alias("wb_id")).agg(F.min("doc_id").alias("m")).where("m % 2 <> 0")
    known = sheets.join(odd, "wb_id", "left_semi")
    return structures.fallback_structures(sheets, known).select("wb_id", "sheet", "table_id", F.col("bounds").alias("rows"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 + l_linenumber AS c FROM lineitem), s AS (SELECT l_orderkey, min(c) AS a, max(c) + 1 AS z FROM p GROUP BY 1)
SELECT l_orderkey AS target_id, bool_and(EXISTS (SELECT 1 FROM p q WHERE q.l_orderkey = s.l_orderkey AND x BETWEEN q.c AND q.c + 1)) AS covered FROM s, range(0, 20) r(x) WHERE x BETWEEN a AND z GROUP BY 1""")
def range_coverage(t: Tables):
    c = (F.col("l_orderkey") % 5 + F.col("l_linenumber")).cast("bigint")
    part = t.lineitem.select(F.col("l_orderkey").alias("target_id"), F.lit(1).alias("r1"), F.lit(2).alias("r2"), c.alias("c1"), (c + 1).alias("c2"))
    target = part.groupBy("target_id").agg(F.lit(1).alias("r1"), F.lit(2).alias("r2"), F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    return structures.covered(target, part)
