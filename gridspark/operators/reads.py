"""Cells of tables and sheets, and reading ranges and logical tables from them.

cells: wb_id, sheet, row, col, kind (text, number, bool, time, formula), s, n, b, ts, formula. Blank cells have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.addressing import LAST_COLUMN, LAST_ROW, column_letters
from gridspark.functions.lineage import cut

#: Rows of a band in range joins.
BAND = 1024
#: Blocks that an area's rows are dealt to at most, beside those at its ends: longer areas have longer blocks, by this factor.
AREA_BLOCKS = 64
CELL_KEYS = ["wb_id", "sheet", "row", "col"]
VALUES = ["kind", "s", "n", "b", "ts", "formula"]
_KINDS = {"string": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}


def bands(df: DataFrame, first: str = "r1", last: str = "r2") -> DataFrame:
    """df with a column band, a row for each band of BAND rows from first to last; what shares a row shares a band."""
    number = lambda x: F.floor(F.col(x) / BAND)
    return df.withColumn("band", number(first) if first == last else F.explode(F.sequence(number(first), number(last))))


def area_blocks(areas: DataFrame, first: str = "r1", last: str = "r2") -> tuple[DataFrame, list[int]]:
    """areas written aside, with the columns block_size and block, a row for each block of rows that they lie in, and what sizes are in use.

    Unlike bands(), an area gives a few rows however long it is: blocks' size goes with its length, BAND or AREA_BLOCKS times as
    much and so on. What is to be met by row looks in one block of each size in use.
    """
    sizes = [BAND * AREA_BLOCKS**i for i in range(9)]
    size = F.lit(sizes[-1])
    for x in reversed(sizes[:-1]):
        size = F.when(F.col(last) - F.col(first) < x * AREA_BLOCKS, F.lit(x)).otherwise(size)
    areas = cut(areas.withColumn("block_size", size.cast("bigint")))
    used = sorted(r[0] for r in areas.select("block_size").distinct().collect())
    number = lambda x: F.floor(F.col(x) / F.col("block_size"))
    return areas.withColumn("block", F.explode(F.sequence(number(first), number(last)))), used


def rows_in_areas(points: DataFrame, areas: DataFrame, by: list[str], row: str = "row", first: str = "r1", last: str = "r2") -> DataFrame:
    """points with the areas that hold their row, within equal columns `by`, block_size and block (area_blocks()); other columns have names of their own."""
    there, used = area_blocks(areas, first, last)
    known = [F.lit(x).cast("bigint") for x in used or [BAND]]
    here = points.withColumn("block_size", known[0] if len(known) == 1 else F.explode(F.array(*known))).withColumn("block", F.floor(F.col(row) / F.col("block_size")))
    return here.join(there, [*by, "block_size", "block"]).where(F.col(row).between(F.col(first), F.col(last)))


def cells_from_table(df: DataFrame, sheet: str, key: Column, columns: list[str] | None = None, wb_id: str = "wb") -> DataFrame:
    """A table seen as a sheet: row 1 holds the column names, a data row stands at key + 2, columns in schema order; nulls are blank."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    cells = []
    for i, name in enumerate(columns, 1):
        kind = _KINDS.get(types[name], "number")
        value = {"text": "s", "number": "n", "bool": "b", "time": "ts"}[kind]
        fields = {"s": "string", "n": "double", "b": "boolean", "ts": "timestamp"}
        cells.append(F.struct(F.lit(i).alias("col"), F.lit(kind).alias("kind"), *((F.col(name) if f == value else F.lit(None)).cast(t).alias(f) for f, t in fields.items())))
    body = df.select((key + 2).cast("bigint").alias("row"), F.explode(F.array(*cells)).alias("c")).select("row", "c.*").where(F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string"), F.col("ts").cast("string")).isNotNull())
    head = df.sparkSession.createDataFrame([(1, i, "text", name, None, None, None) for i, name in enumerate(columns, 1)], "row bigint, col int, kind string, s string, n double, b boolean, ts timestamp")
    place = [F.lit(wb_id).alias("wb_id"), F.lit(sheet).alias("sheet")]
    return body.unionByName(head).select(*place, "row", "col", "kind", "s", "n", "b", "ts", F.lit(None).cast("string").alias("formula"))


def cell_text(cell: str = "") -> Column:
    """A cell's value as text: whole numbers without decimals, times as date and time."""
    c = lambda name: F.col(f"{cell}{name}")
    whole = F.when(c("n") == F.floor(c("n")), F.floor(c("n")).cast("string")).otherwise(c("n").cast("string"))
    truth = F.when(c("b"), "True").when(~c("b"), "False")
    return F.coalesce(c("formula"), c("s"), whole, truth, F.date_format(c("ts"), "yyyy-MM-dd HH:mm:ss"))


def sheet_bounds(cells: DataFrame) -> DataFrame:
    """Last row and column of each sheet, and the box of its cells that hold something."""
    return cells.groupBy("wb_id", "sheet").agg(*(f(x).alias(y) for f, x, y in ((F.min, "row", "r1"), (F.min, "col", "c1"), (F.max, "row", "r2"), (F.max, "col", "c2"))))


def read_ranges(cells: DataFrame, ranges: DataFrame, dense: bool = False) -> DataFrame:
    """Cells of many ranges (range_id, wb_id, sheet, r1, c1, r2, c2) with their row-major place ord; dense adds blank cells.

    Ranges and cells meet by sheet and band of BAND rows, so that one huge sheet is many keys.
    """
    r = ranges.select("range_id", "wb_id", "sheet", "r1", "c1", "r2", "c2")
    inside = F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))
    found = bands(cells, "row", "row").join(bands(r), ["wb_id", "sheet", "band"]).where(inside)
    place = ((F.col("row") - F.col("r1")) * (F.col("c2") - F.col("c1") + 1) + F.col("col") - F.col("c1")).alias("ord")
    found = found.select("range_id", "wb_id", "sheet", "row", "col", place, *VALUES)
    if not dense:
        return found
    grid = r.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2"))).select("range_id", "wb_id", "sheet", "row", F.col("col").cast("int").alias("col"), place)
    return grid.join(found.drop("ord", "wb_id", "sheet"), ["range_id", "row", "col"], "left").select(found.columns)


def frame(cells: DataFrame, columns: dict[int, str], value: Column | None = None) -> DataFrame:
    """Rows of one sheet with a column for each of the given column numbers."""
    text = cells.withColumn("_v", cell_text() if value is None else value).where(F.col("col").isin(list(columns)))
    wide = text.groupBy("wb_id", "sheet", "row").pivot("col", list(columns)).agg(F.first("_v"))
    return wide.select("wb_id", "sheet", "row", *(F.col(str(c)).alias(name) for c, name in columns.items()))


def expand_merges(cells: DataFrame, merges: DataFrame, overwrite: bool = True) -> DataFrame:
    """Cells with every merged area filled from its upper left cell; blank anchors leave blanks. Without overwrite, cells that hold something of their own stay."""
    area = merges.select("wb_id", "sheet", "r1", "c1", "r2", "c2")
    anchors = area.join(cells, (area["wb_id"] == cells["wb_id"]) & (area["sheet"] == cells["sheet"]) & (area["r1"] == cells["row"]) & (area["c1"] == cells["col"]))
    filled = anchors.select(area["wb_id"], area["sheet"], F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2", *VALUES).withColumn("col", F.explode(F.sequence(F.col("c1").cast("int"), F.col("c2").cast("int")))).select(*CELL_KEYS, *VALUES)
    own = cells.select(*CELL_KEYS, *VALUES)
    if not overwrite:
        return own.unionByName(filled.join(own.select(*CELL_KEYS), CELL_KEYS, "left_anti").dropDuplicates(CELL_KEYS))
    return own.join(filled.select(*CELL_KEYS), CELL_KEYS, "left_anti").select(*CELL_KEYS, *VALUES).unionByName(filled)


def logical_rows(cells: DataFrame, headers: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Long logical tables: wb_id, sheet, table_id, row, header_id, value and, of a single value, kind, s, n, b, ts.

    Data begin below the lowest header row of a table; a column belongs to the narrowest header over it (earlier ones first),
    to `col_n` if there is none. Columns of one header collapse: one distinct text stays the first cell's typed value, several
    are joined by line feeds as a text. headers: wb_id, sheet, table_id, header_id, ord, hr (box), dr (box).
    """
    cells = cells if merges is None else expand_merges(cells, merges)
    key = ["wb_id", "sheet", "table_id"]
    edges = lambda f, side: f(*(F.col(f"{b}.{side}") for b in ("hr", "dr")))
    tables = headers.groupBy(*key).agg(F.max("hr.r2").alias("head"), F.max(edges(F.greatest, "r2")).alias("bottom"), F.min(edges(F.least, "c1")).alias("left"), F.max(edges(F.greatest, "c2")).alias("right"))
    body = bands(cells, "row", "row").join(bands(tables, "head", "bottom"), ["wb_id", "sheet", "band"]).where((F.col("row") > F.col("head")) & (F.col("row") <= F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right")))
    spans = headers.where("hr is not null").select(*key, "header_id", "ord", (F.col("hr.c2") - F.col("hr.c1")).alias("width"), F.explode(F.sequence(F.col("hr.c1").cast("int"), F.col("hr.c2").cast("int"))).alias("col"))
    owner = spans.groupBy(*key, "col").agg(F.min_by("header_id", F.struct("width", "ord")).alias("header_id"))
    typed = ["kind", "s", "n", "b", "ts"]
    named = body.join(owner, [*key, "col"], "left").select(*key, "row", F.coalesce("header_id", F.concat(F.lit("col_"), F.col("col"))).alias("header_id"), "col", F.trim(cell_text()).alias("text"), F.struct(*typed).alias("v"))
    parts = named.where("text <> ''").groupBy(*key, "row", "header_id").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("parts"), F.min_by("v", "col").alias("v"))
    texts = F.array_distinct(F.col("parts.text"))
    one = F.size(texts) == 1
    several = F.struct(F.lit("text").alias("kind"), F.array_join(texts, "\n").alias("s"), *(F.lit(None).cast(t).alias(x) for x, t in (("n", "double"), ("b", "boolean"), ("ts", "timestamp"))))
    return parts.select(*key, "row", "header_id", F.array_join(texts, "\n").alias("value"), F.when(one, F.col("v")).otherwise(several).alias("v")).select(*key, "row", "header_id", "value", "v.*")


def table_bounds(headers: DataFrame) -> DataFrame:
    """wb_id, sheet, table_id, r1, c1, r2, c2 around all header and data ranges of a table's headers; 0s for a table without any."""
    edge = lambda f, g, side: F.coalesce(g(f(*(F.col(f"{b}.{side}") for b in ("hr", "dr")))), F.lit(0)).alias(side)
    return headers.groupBy("wb_id", "sheet", "table_id").agg(edge(F.least, F.min, "r1"), edge(F.least, F.min, "c1"), edge(F.greatest, F.max, "r2"), edge(F.greatest, F.max, "c2"))


def raw_tables(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells within the bounds of each table as they stand, headers included: table_id, then place and values."""
    bounds = table_bounds(headers).where("r2 > 0")
    found = read_ranges(cells, bounds.withColumn("range_id", F.struct("wb_id", "sheet", "table_id")))
    return found.select("wb_id", "sheet", F.col("range_id.table_id").alias("table_id"), "row", "col", "ord", *VALUES)


def range_rows(cells: DataFrame, ranges: DataFrame, has_headers: bool = True) -> DataFrame:
    """Long rows of ranges: range_id, row (from 0), name, i (column from 0), value as text; blank cells are null.

    A range of more than one row has its names in the first, `Col0`, `Col1` and so on where that is blank; one row, or a range
    read without headers, has numbers for names.
    """
    tall = F.col("r2") > F.col("r1")
    grid = read_ranges(cells, ranges, dense=True).join(ranges.select("range_id", "r1", "c1", (F.lit(has_headers) & tall).alias("named")), "range_id")
    places = grid.select("range_id", (F.col("row") - F.col("r1")).alias("row"), (F.col("col") - F.col("c1")).alias("i"), "named", cell_text().alias("value"))
    heads = places.where("named and row = 0").select("range_id", "i", F.coalesce("value", F.concat(F.lit("Col"), F.col("i").cast("string"))).alias("head"))
    rows = places.where("not (named and row = 0)").join(heads, ["range_id", "i"], "left")
    return rows.select("range_id", (F.col("row") - F.col("named").cast("int")).alias("row"), "i", F.coalesce("head", F.col("i").cast("string")).alias("name"), "value")


def sheet_frame(cells: DataFrame, sheets: DataFrame, min_row: int = 1, max_row: int | None = None, min_col: int = 1, max_col: int | None = None) -> DataFrame:
    """Cells of whole sheets with column letters, within bounds that are clamped to each sheet's own; bounds that hold no cell of a sheet raise.

    sheets: wb_id, sheet, r2, c2 (last row and column, as sheet_bounds() gives them).
    """
    low, right = F.least(F.lit(max_row or LAST_ROW), F.col("r2")), F.least(F.lit(max_col or LAST_COLUMN), F.col("c2"))
    fine = F.lit(min_row >= 1 and min_col >= 1) & (low >= min_row) & (right >= min_col)
    if not sheets.where(~fine).isEmpty():
        raise ValueError("invalid worksheet bounds")
    areas = sheets.select("wb_id", "sheet", low.cast("bigint").alias("r2"), right.cast("bigint").alias("c2")).select(F.struct("wb_id", "sheet").alias("range_id"), "wb_id", "sheet", F.lit(min_row).cast("bigint").alias("r1"), F.lit(min_col).cast("bigint").alias("c1"), "r2", "c2")
    return read_ranges(cells, areas).select("wb_id", "sheet", "row", column_letters(F.col("col")).alias("letter"), *VALUES)


def grow_to_merges(areas: DataFrame, merges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Areas (wb_id, sheet, r1, c1, r2, c2, one per sheet) grown to every merge that they touch, until none sticks out; both meet by bands of rows.

    A round that changes something takes in at least one more merge, so that this ends; more than most_rounds raise, if given.
    """
    m = bands(merges.select("wb_id", "sheet", *(F.col(x).alias(f"m_{x}") for x in ("r1", "c1", "r2", "c2"))), "m_r1", "m_r2")
    rounds = 0
    while True:
        touch = (F.col("r1") <= F.col("m_r2")) & (F.col("m_r1") <= F.col("r2")) & (F.col("c1") <= F.col("m_c2")) & (F.col("m_c1") <= F.col("c2"))
        grown = bands(areas).join(m, ["wb_id", "sheet", "band"], "left").groupBy("wb_id", "sheet", "r1", "c1", "r2", "c2").agg(
            *(f(F.when(touch, F.col(f"m_{x}"))).alias(f"g_{x}") for x, f in (("r1", F.min), ("c1", F.min), ("r2", F.max), ("c2", F.max)))
        )
        wider = grown.select("wb_id", "sheet", *(f(x, f"g_{x}").alias(x) for x, f in (("r1", F.least), ("c1", F.least), ("r2", F.greatest), ("c2", F.greatest))), F.coalesce((F.col("g_r1") < F.col("r1")) | (F.col("g_c1") < F.col("c1")) | (F.col("g_r2") > F.col("r2")) | (F.col("g_c2") > F.col("c2")), F.lit(False)).alias("changed"))
        wider = cut(wider)
        areas = wider.drop("changed")
        if wider.where("changed").isEmpty():
            return areas
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError(f"areas still grow after {most_rounds} rounds")


def coverage(cells: DataFrame, regions: DataFrame, least: float = 0.4) -> DataFrame:
    """Regions (range_id and box) with their shares of non-blank rows and columns, and whether either reaches least."""
    found = read_ranges(cells.where(F.trim(cell_text()) != ""), regions).groupBy("range_id").agg(F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"))
    share = lambda n, a, b: F.coalesce(F.col(n), F.lit(0)) / (F.col(b) - F.col(a) + 1)
    rows, cols = share("rows", "r1", "r2"), share("cols", "c1", "c2")
    return regions.join(found, "range_id", "left").select("range_id", rows.alias("row_share"), cols.alias("col_share"), ((rows >= least) | (cols >= least)).alias("enough"))


def sheet_text(cells: DataFrame) -> DataFrame:
    """All values of a sheet in row-major order, joined by spaces; a sheet's text is one value, as its cards need it.

    Bands of BAND rows are joined first, so that a sheet's cells never are one list.
    """
    part = F.sort_array(F.collect_list(F.struct("row", "col", cell_text().alias("text"))))
    banded = bands(cells, "row", "row").groupBy("wb_id", "sheet", "band").agg(F.array_join(part["text"], " ").alias("text"))
    return banded.groupBy("wb_id", "sheet").agg(F.array_join(F.sort_array(F.collect_list(F.struct("band", "text")))["text"], " ").alias("sheet_text"))


def corner_tiles(areas: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles of fixed size at the four corners of each area, clipped to it, equal ones once."""
    up, left = F.least(F.col("r1") + height - 1, F.col("r2")), F.least(F.col("c1") + width - 1, F.col("c2"))
    low, right = F.greatest(F.col("r2") - height + 1, F.col("r1")), F.greatest(F.col("c2") - width + 1, F.col("c1"))
    tile = lambda r1, c1, r2, c2: F.struct(r1.alias("t_r1"), c1.alias("t_c1"), r2.alias("t_r2"), c2.alias("t_c2"))
    r1, c1, r2, c2 = (F.col(x) for x in ("r1", "c1", "r2", "c2"))
    tiles = F.array(tile(r1, c1, up, left), tile(r1, right, up, c2), tile(low, c1, r2, left), tile(low, right, r2, c2))
    return areas.select("wb_id", "sheet", F.inline(F.array_distinct(tiles)))


def header_leaves(headers: DataFrame, header_id: str) -> DataFrame:
    """Leaf headers below a header, itself if it is one, in order; headers have path (ids from the root) and is_leaf."""
    return headers.where(F.array_contains("path", header_id) & F.col("is_leaf")).orderBy("ord")


def header_list(headers: DataFrame) -> DataFrame:
    """Headers of each table in pre-order (by their paths of places), of an id the first: place, level and is_leaf beside it.

    headers: wb_id, sheet, table_id, header_id, places (array of a header's place among its siblings, from the root).
    """
    key = ["wb_id", "sheet", "table_id"]
    order = W.Window.partitionBy(*key).orderBy("places")
    inner = headers.where(F.size("places") > 1).select(*key, F.slice("places", F.lit(1), F.size("places") - 1).alias("places")).distinct().withColumn("inner", F.lit(True))
    listed = headers.join(inner, [*key, "places"], "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner")
    listed = listed.withColumn("place", F.row_number().over(order)).withColumn("level", F.size("places"))
    again = F.row_number().over(W.Window.partitionBy(*key, "header_id").orderBy("place"))
    return listed.withColumn("first_of_id", again == 1)
