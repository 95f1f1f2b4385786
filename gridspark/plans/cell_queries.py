"""Queries over cells: reading, ranges, filters and selections. A table is a sheet; a row's key + 2 is its row number."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import addressing as A
from gridspark.operators import filters, reads
from gridspark.plans.register import Register, Tables

REGISTER = query = Register()

CUSTOMER_CELLS = """
customer_cells AS (
  SELECT c_custkey + 2 AS row, 1 AS col, 'number' AS kind, CAST(NULL AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS n FROM customer
  UNION ALL SELECT c_custkey + 2, 2, 'text', c_name, NULL FROM customer
  UNION ALL SELECT c_custkey + 2, 3, 'number', NULL, CAST(c_nationkey AS DOUBLE) FROM customer
  UNION ALL SELECT c_custkey + 2, 4, 'number', NULL, c_acctbal FROM customer
  UNION ALL SELECT c_custkey + 2, 5, 'text', c_mktsegment, NULL FROM customer
  UNION ALL SELECT 1, i, 'text', unnest, NULL FROM (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS unnest, unnest([1,2,3,4,5]) AS i)
)"""


COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def customer_cells(t: Tables, column: int | None = None):
    """The customer sheet, or one of its columns: then no other is read."""
    cells = reads.cells_from_table(t.customer, "customer", F.col("c_custkey"), columns=None if column is None else [COLUMNS[column - 1]])
    return cells if column is None else cells.withColumn("col", F.lit(column))


@query(f"WITH {CUSTOMER_CELLS} SELECT row, CAST(col AS INTEGER) AS col, kind, s, n FROM customer_cells")
def cells_from_table(t: Tables):
    return customer_cells(t).select("row", "col", "kind", "s", "n")


@query("SELECT 'orders' AS sheet, CAST(1 AS BIGINT) AS r1, CAST(1 AS INTEGER) AS c1, max(o_orderkey) + 2 AS r2, CAST(6 AS INTEGER) AS c2 FROM orders")
def sheet_bounds(t: Tables):
    cells = reads.cells_from_table(t.orders, "orders", F.col("o_orderkey"))
    return reads.sheet_bounds(cells).select("sheet", "r1", "c1", "r2", "c2")


def tiles(t: Tables, height: int = 100):
    """Boxes of columns B to D that tile the whole customer sheet."""
    band = F.floor((F.col("c_custkey") + 1) / height)
    return t.customer.select(band.alias("range_id")).distinct().select("range_id", F.lit("wb").alias("wb_id"), F.lit("customer").alias("sheet"), (F.col("range_id") * height + 1).alias("r1"), F.lit(2).alias("c1"), ((F.col("range_id") + 1) * height).alias("r2"), F.lit(4).alias("c2"))


@query(f"""WITH {CUSTOMER_CELLS}, ranges AS (SELECT DISTINCT CAST(floor((c_custkey + 1) / 100) AS BIGINT) AS range_id FROM customer)
SELECT range_id, row, CAST(col AS INTEGER) AS col, (row - range_id * 100 - 1) * 3 + col - 2 AS ord, s, n
FROM customer_cells JOIN ranges ON row BETWEEN range_id * 100 + 1 AND range_id * 100 + 100 WHERE col BETWEEN 2 AND 4""")
def read_range(t: Tables):
    return reads.read_ranges(customer_cells(t), tiles(t)).select("range_id", "row", "col", "ord", "s", "n")


@query(f"""WITH {CUSTOMER_CELLS}, ranges AS (SELECT DISTINCT CAST(floor((c_custkey + 1) / 100) AS BIGINT) AS range_id FROM customer),
grid AS (SELECT range_id, range_id * 100 + 1 + i AS row, j AS col, i * 3 + j - 2 AS ord FROM ranges, range(0, 100) a(i), range(2, 5) b(j))
SELECT range_id, CAST(ord AS BIGINT) AS ord, coalesce(s, CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) END) AS value
FROM grid LEFT JOIN customer_cells USING (row, col)""")
def read_range_flat(t: Tables):
    whole = F.when(F.col("n") == F.floor("n"), F.floor("n").cast("string"))
    return reads.read_ranges(customer_cells(t), tiles(t), dense=True).select("range_id", F.col("ord").cast("bigint").alias("ord"), F.coalesce("s", whole).alias("value"))


@query("SELECT c_custkey + 2 AS row, CAST(c_custkey AS VARCHAR) AS \"A\", c_name AS \"B\", CAST(c_nationkey AS VARCHAR) AS \"C\", c_mktsegment AS \"E\" FROM customer UNION ALL SELECT 1, 'c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment'")
def read_sheet_frame(t: Tables):
    return reads.frame(customer_cells(t), {1: "A", 2: "B", 3: "C", 5: "E"}).select("row", "A", "B", "C", "E")


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 16384 + 1 AS BIGINT) AS n FROM part)
SELECT p_partkey, n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER))
  ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((n - 703) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END AS letters,
  n AS back, p_partkey + 1 AS box_row, n AS box_col FROM p""")
def a1_codec(t: Tables):
    n = (F.col("p_partkey") % 16384 + 1).cast("bigint")
    box = A.parse_box(F.concat(F.lit("'my sheet'!$"), A.column_letters(n), F.lit("$"), (F.col("p_partkey") + 1).cast("string")), last_row=A.ANY_ROW)
    return t.part.select("p_partkey", n.alias("n"), A.column_letters(n).alias("letters"), A.column_number(A.column_letters(n)).alias("back"), box["r1"].alias("box_row"), box["c2"].alias("box_col"))


#: Merges of two rows in column B at every seventh customer, whose lower cell is blank.
MERGED = "c_custkey % 7 = 0"


def merged_sheet(t: Tables):
    cells = customer_cells(t)
    followers = (F.col("row") > 2) & ((F.col("row") - 3) % 7 == 0) & (F.col("col") == 2)
    merges = t.customer.where(MERGED).select(F.lit("wb").alias("wb_id"), F.lit("customer").alias("sheet"), (F.col("c_custkey") + 2).alias("r1"), F.lit(2).alias("c1"), (F.col("c_custkey") + 3).alias("r2"), F.lit(2).alias("c2"))
    return cells.where(~followers), merges


@query("""SELECT c_custkey + 2 AS row, c_name AS s FROM customer WHERE (c_custkey - 1) % 7 <> 0
UNION ALL SELECT c_custkey + 3, c_name FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 1, 'c_name'""")
def merged_expand(t: Tables):
    return reads.expand_merges(*merged_sheet(t)).where("col = 2").select("row", "s")


def customer_headers(t: Tables):
    """Header tree of the customer sheet: a group over name and nation, and a wide header over balance and segment."""
    end = t.customer.agg((F.max("c_custkey") + 2).alias("last"))
    rows = [("id", 1, 1, 1), ("who", 2, 2, 3), ("name", 3, 2, 2), ("rest", 4, 4, 5)]
    row = lambda i, ord_, c1, c2: F.struct(F.lit(i).alias("header_id"), F.lit(ord_).alias("ord"), F.lit(c1).cast("bigint").alias("c1"), F.lit(c2).cast("bigint").alias("c2"))
    headers = end.select("last", F.inline(F.array(*(row(*r) for r in rows))))
    box = lambda r1, r2: F.struct(F.lit(None).cast("string").alias("sheet"), r1.cast("bigint").alias("r1"), F.col("c1"), r2.cast("bigint").alias("r2"), F.col("c2"))
    return headers.select(F.lit("wb").alias("wb_id"), F.lit("customer").alias("sheet"), F.lit("t1").alias("table_id"), "header_id", "ord", box(F.lit(1), F.lit(1)).alias("hr"), box(F.lit(2), F.col("last")).alias("dr"))


@query("""SELECT c_custkey + 2 AS row, 'id' AS header_id, CAST(c_custkey AS VARCHAR) AS value FROM customer
UNION ALL SELECT c_custkey + 2, 'name', c_name FROM customer UNION ALL SELECT c_custkey + 2, 'who', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey + 2, 'rest', c_mktsegment FROM customer""")
def logical_table(t: Tables):
    text_only = customer_cells(t).where("col <> 4")
    return reads.logical_rows(text_only, customer_headers(t)).select("row", "header_id", "value")


@query("""SELECT c_custkey + 2 AS row, 'rest' AS header_id, CASE WHEN c_mktsegment = CAST(c_nationkey AS VARCHAR) THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) || chr(10) || c_mktsegment END AS value FROM customer""")
def collapse_columns(t: Tables):
    moved = customer_cells(t).where("col in (3, 5)").withColumn("col", F.when(F.col("col") == 3, 4).otherwise(5))
    return reads.logical_rows(moved, customer_headers(t)).select("row", "header_id", "value")


@query(f"""WITH {CUSTOMER_CELLS}, ranges AS (SELECT DISTINCT CAST(floor((c_custkey + 1) / 100) AS BIGINT) AS range_id FROM customer),
hit AS (SELECT range_id, count(DISTINCT row) AS r, count(DISTINCT col) AS c FROM customer_cells JOIN ranges ON row BETWEEN range_id * 100 + 1 AND range_id * 100 + 100 WHERE col BETWEEN 2 AND 4 AND (s = 'BUILDING' OR n > 9000 OR (col = 3 AND n = 7)) GROUP BY 1)
SELECT range_id, round(coalesce(r, 0) / 100.0, 6) AS row_share, round(coalesce(c, 0) / 3.0, 6) AS col_share, coalesce(r, 0) / 100.0 >= 0.4 OR coalesce(c, 0) / 3.0 >= 0.4 AS enough FROM ranges LEFT JOIN hit USING (range_id)""")
def coverage_regions(t: Tables):
    some = customer_cells(t).where("s = 'BUILDING' or n > 9000 or (col = 3 and n = 7)")
    return reads.coverage(some, tiles(t)).select("range_id", F.round("row_share", 6).alias("row_share"), F.round("col_share", 6).alias("col_share"), "enough")


@query("""WITH b AS (SELECT n_nationkey, max(c_custkey) + 2 AS r2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT n_nationkey, r2, least(50, r2) AS up, greatest(r2 - 49, 1) AS low FROM b)
SELECT DISTINCT n_nationkey, CAST(x.a AS BIGINT) AS t_r1, CAST(x.b AS BIGINT) AS t_r2, CAST(x.c AS BIGINT) AS t_c1, CAST(x.d AS BIGINT) AS t_c2 FROM (
  SELECT n_nationkey, unnest([{'a': 1, 'b': up, 'c': 1, 'd': 3}, {'a': 1, 'b': up, 'c': 3, 'd': 5}, {'a': low, 'b': r2, 'c': 1, 'd': 3}, {'a': low, 'b': r2, 'c': 3, 'd': 5}]) AS x FROM t)""")
def tile_corners(t: Tables):
    areas = t.customer.groupBy(F.col("c_nationkey").alias("wb_id")).agg((F.max("c_custkey") + 2).alias("r2")).select("wb_id", F.lit("customer").alias("sheet"), F.lit(1).alias("r1"), F.lit(1).alias("c1"), "r2", F.lit(5).alias("c2"))
    found = reads.corner_tiles(areas, 50, 3)
    return found.select(F.col("wb_id").alias("n_nationkey"), *(F.col(x).cast("bigint").alias(x) for x in ("t_r1", "t_r2", "t_c1", "t_c2")))


def positions(t: Tables, column: int, **conditions):
    last = 1 << 40
    return filters.filter_values(customer_cells(t, column), 2, column, last, column, **conditions)


def _filter(name: str, sql: str, column: int, **conditions):
    def run(t: Tables):
        return positions(t, column, **conditions).select("axis", "pos")

    run.__name__ = name
    query(f"SELECT 'row' AS axis, c_custkey + 2 AS pos FROM customer WHERE {sql}")(run)


_filter("filter_equals", "lower(c_mktsegment) = 'building'", 5, equals="Building")
_filter("filter_equals_number", "c_nationkey = 7", 3, equals=7)
_filter("filter_not_equals", "c_nationkey <> 7", 3, not_equals=7)
_filter("filter_in_values", "c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')", 5, in_values=["automobile", "Machinery"])
_filter("filter_contains", "lower(c_mktsegment) LIKE '%hold%'", 5, contains="HOLD")
_filter("filter_startswith", "lower(c_name) LIKE 'customer#00000001%'", 2, startswith="Customer#00000001")
_filter("filter_endswith", "c_name LIKE '%9'", 2, endswith="9")
_filter("filter_regex", "regexp_matches(c_name, '(?i)#0*[0-9]*7[0-9]$')", 2, regex="#0*[0-9]*7[0-9]$")
_filter("filter_compare", "c_acctbal > 100 AND c_acctbal <= 5000.5", 4, gt=100, lte=5000.5)
_filter("filter_between", "c_acctbal BETWEEN -500 AND 2500", 4, between=(-500, 2500))


@query("SELECT 'row' AS axis, c_custkey + 2 AS pos FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_mktsegment = 'MACHINERY'")
def filter_accents(t: Tables):
    """Segments with marks on their vowels, found by one name with marks and one without."""
    cells = customer_cells(t, 5).withColumn("s", F.translate("s", "AEIOU", "ÁÊÎÖŪ"))
    either = filters.combine("union", *(filters.filter_values(cells, 2, 5, 1 << 40, 5, ignore_accents=True, **c) for c in ({"equals": "Furniture"}, {"contains": "mâchï"})))
    return either.select("axis", "pos")


@query("SELECT 'row' AS axis, o_orderkey + 2 AS pos FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1996-09-15' AND month(o_orderdate) = 9")
def filter_dates(t: Tables):
    cells = reads.cells_from_table(t.orders, "orders", F.col("o_orderkey"), columns=["o_orderdate"]).withColumn("col", F.lit(5))
    found = filters.filter_values(cells, 2, 5, 1 << 40, 5, gte="1995-03-01", lte="15/09/1996", predicate=lambda: F.month("ts") == 9)
    return found.select("axis", "pos")


MASK_TEST = "coalesce({} > 0.05, false)"


@query("SELECT l_orderkey, l_linenumber, l_discount > 0.05 OR l_tax > 0.05 AS hit FROM lineitem")
def group_mask_any(t: Tables):
    rows = t.lineitem
    return rows.select("l_orderkey", "l_linenumber", filters.group_mask(rows, ["l_discount", "l_tax"], lambda c: c > 0.05).alias("hit"))


@query("SELECT l_orderkey, l_linenumber, (l_discount = 0 OR l_discount > 0.05) AND (l_tax = 0 OR l_tax > 0.05) AS hit FROM lineitem")
def group_mask_all(t: Tables):
    rows = t.lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rows.select("l_orderkey", "l_linenumber", filters.group_mask(rows, ["l_discount", "l_tax"], lambda c: c > 0.05, "all", missing_matches=True).alias("hit"))


def _set(name: str, sql: str):
    def run(t: Tables):
        found = filters.combine(name.split("_")[1], positions(t, 5, equals="BUILDING"), positions(t, 4, gt=1000))
        return found.select("axis", "pos")

    run.__name__ = name
    query(f"SELECT 'row' AS axis, c_custkey + 2 AS pos FROM customer WHERE {sql}")(run)


_set("selection_intersection", "c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
_set("selection_union", "c_mktsegment = 'BUILDING' OR c_acctbal > 1000")
_set("selection_difference", "c_mktsegment = 'BUILDING' AND NOT c_acctbal > 1000")


@query("SELECT c_custkey + 2 AS row, c_name AS s FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def selection_read(t: Tables):
    chosen = filters.combine("intersection", positions(t, 5, equals="BUILDING"), positions(t, 4, gt=1000))
    return filters.read_selection(chosen, customer_cells(t, 2), 2, 2, 1 << 40, 2).select("row", "s")


BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_partkey % 20 + 1 AS r1, l_partkey % 20 + 1 + l_suppkey % 5 AS r2, l_orderkey % 9 + 1 AS c1, l_orderkey % 9 + 1 + l_linenumber AS c2,
  l_suppkey % 18 + 1 AS q1, l_suppkey % 18 + 4 AS q2, l_partkey % 8 + 1 AS d1, l_partkey % 8 + 3 AS d2 FROM lineitem)"""


def boxes(t: Tables):
    r1, c1, q1, d1 = F.col("l_partkey") % 20 + 1, F.col("l_orderkey") % 9 + 1, F.col("l_suppkey") % 18 + 1, F.col("l_partkey") % 8 + 1
    return t.lineitem.select("l_orderkey", "l_linenumber", A.box(r1, c1, r1 + F.col("l_suppkey") % 5, c1 + F.col("l_linenumber")).alias("a"), A.box(q1 + 3, d1 + 2, q1, d1).alias("b"))


@query(f"WITH {BOXES} SELECT l_orderkey, l_linenumber, greatest(r1, q1) AS r1, greatest(c1, d1) AS c1, least(r2, q2) AS r2, least(c2, d2) AS c2 FROM b WHERE r1 <= q2 AND q1 <= r2 AND c1 <= d2 AND d1 <= c2")
def range_intersection(t: Tables):
    found = boxes(t).withColumn("x", A.intersection(F.col("a"), F.col("b"))).where("x is not null")
    return found.select("l_orderkey", "l_linenumber", "x.r1", "x.c1", "x.r2", "x.c2")


@query(f"""WITH {BOXES}, m AS (SELECT *, (r1 = q1 AND r2 = q2 AND c1 <= d2 + 1 AND d1 <= c2 + 1) OR (c1 = d1 AND c2 = d2 AND r1 <= q2 + 1 AND q1 <= r2 + 1) AS one FROM b)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN one THEN 1 ELSE 2 END AS INTEGER) AS boxes, CASE WHEN one THEN (greatest(r2, q2) - least(r1, q1) + 1) * (greatest(c2, d2) - least(c1, d1) + 1) ELSE (r2 - r1 + 1) * (c2 - c1 + 1) + 12 END AS cells FROM m""")
def range_union(t: Tables):
    parts = A.union(F.col("a"), F.col("b"))
    area = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + (x["r2"] - x["r1"] + 1) * (x["c2"] - x["c1"] + 1))
    return boxes(t).select("l_orderkey", "l_linenumber", F.size(parts).alias("boxes"), area.alias("cells"))


@query(f"""WITH {BOXES}, x AS (SELECT *, greatest(r1, q1) AS i1, least(r2, q2) AS i2, greatest(c1, d1) AS j1, least(c2, d2) AS j2 FROM b)
SELECT l_orderkey, l_linenumber, (r2 - r1 + 1) * (c2 - c1 + 1) - CASE WHEN i1 <= i2 AND j1 <= j2 THEN (i2 - i1 + 1) * (j2 - j1 + 1) ELSE 0 END AS cells,
  CAST(CASE WHEN i1 <= i2 AND j1 <= j2 THEN (r1 < i1)::INT + (i2 < r2)::INT + (c1 < j1)::INT + (j2 < c2)::INT ELSE 1 END AS INTEGER) AS boxes FROM x""")
def range_difference(t: Tables):
    parts = A.difference(F.col("a"), F.col("b"))
    area = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + (x["r2"] - x["r1"] + 1) * (x["c2"] - x["c1"] + 1))
    return boxes(t).select("l_orderkey", "l_linenumber", area.alias("cells"), F.size(parts).alias("boxes"))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, CASE WHEN r1 = q1 AND r2 = q2 AND c1 <= d2 + 1 AND d1 <= c2 + 1 THEN least(c1, d1) ELSE c1 END AS c1, CASE WHEN r1 = q1 AND r2 = q2 AND c1 <= d2 + 1 AND d1 <= c2 + 1 THEN greatest(c2, d2) ELSE c2 END AS c2 FROM b""")
def range_extend(t: Tables):
    grown = A.extend(F.col("a"), F.col("b"), F.lit(True))
    return boxes(t).select("l_orderkey", "l_linenumber", grown["c1"].alias("c1"), grown["c2"].alias("c2"))
