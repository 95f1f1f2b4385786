"""Formula relations: normal forms, runs, assignment to tables, extraction, filling and what-if recalculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.addressing import cell_a1, column_letters
from gridspark.functions.formulas import normal_form, pattern, pieces, shifted, spacing
from gridspark.functions.lineage import cut
from gridspark.operators.reads import BAND, area_blocks, bands, rows_in_areas

#: Error tokens and what they say. Fixed values.
ERRORS = {
    "#REF!": ("broken_reference", "Original referenced cell or range is lost."),
    "#DIV/0!": ("division_by_zero", "Formula attempts to divide by zero."),
    "#VALUE!": ("wrong_value_type", "Formula uses a value of the wrong data type."),
    "#NAME?": ("invalid_name", "Formula contains unrecognized text or function name."),
    "#NUM!": ("number_error", "Formula contains invalid numeric values."),
    "#N/A": ("value_not_available", "A value is not available to the formula."),
    "#NULL!": ("null_error", "Formula refers to an intersection of two ranges that do not intersect."),
}
AGGREGATES = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "SUBTOTAL")
__all__ = ["normal_form", "pattern", "shifted"]


def formula_errors(raw: Column) -> Column:
    """Array of (type, token, message) of the error tokens in a formula."""
    every = F.array(*(F.struct(F.lit(kind).alias("type"), F.lit(token).alias("token"), F.lit(message).alias("message")) for token, (kind, message) in ERRORS.items()))
    return F.filter(every, lambda e: F.contains(raw, e["token"]))


def aggregate_function(raw: Column) -> Column:
    """First of the aggregate functions, in their order, that a formula calls."""
    return F.coalesce(*(F.when(F.upper(raw).rlike(rf"\b{name}\s*\("), F.lit(name)) for name in AGGREGATES))


def description(category: Column, shape: Column, text: Column, agg_function: Column, cell: Column, errors: Column) -> Column:
    """What a relation is, in words; category is normal, aggregate, cell or invalid, text a run's pattern or a single formula. Fixed values."""
    arithmetic = text.rlike(r"[*/+-]")
    down = (
        F.when(agg_function.isNotNull(), F.concat(F.lit("Repeated row-wise "), agg_function, F.lit(" formula. Each row calculates a value from a range of cells in the same row.")))
        .when(arithmetic & F.contains(text, F.lit("$")), "Repeated row-wise arithmetic formula using an absolute reference.")
        .when(arithmetic, "Repeated row-wise arithmetic formula.").otherwise("Repeated row-wise formula.")
    )
    across = F.concat(F.lit("Repeated column-wise "), F.coalesce(F.concat(agg_function, F.lit(" ")), F.lit("")), F.lit("formula. Each column calculates a value from rows above it."))
    alone = (
        F.when(F.contains(F.upper(text), F.lit("IF")), F.concat(F.lit("Standalone formula used only in one specific cell in cell "), cell, F.lit(".")))
        .when(arithmetic, F.concat(F.lit("Standalone arithmetic formula in cell "), cell, F.lit(" that does not repeat across rows or columns.")))
        .otherwise(F.concat(F.lit("Standalone cell formula in cell "), cell, F.lit(".")))
    )
    listed = F.array_join(F.transform(errors, lambda e: F.concat(e["type"], F.lit(" ("), e["message"], F.lit(")"))), ", ")
    return (
        F.when((category == "normal") & (shape == "rows"), down).when(category == "normal", across)
        .when(category == "aggregate", F.concat(F.lit("Aggregate "), agg_function, F.lit(" formula in cell "), cell, F.lit(" over a column or range.")))
        .when(category == "cell", alone).otherwise(F.concat(F.lit("Formula contains error(s): "), listed, F.lit(".")))
    )


def runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col) as segments: runs of two rows or more in a column first, of what is left runs in a row, else single cells.

    Returns keys, r1, c1, r2, c2 and shape (rows, columns, single). Runs are found within bands of rows and joined over their
    borders, so that a window holds a band, or two islands of each of a sheet's 1,024 bands, and never a column.
    """
    band = F.floor(F.col("row") / BAND)
    inside = W.Window.partitionBy(*keys, "col", "band").orderBy("row")
    here = cells.select(*keys, "row", "col").distinct().withColumn("band", band).withColumn("island", F.col("row") - F.row_number().over(inside))
    here = here.groupBy(*keys, "col", "band", "island").agg(F.min("row").alias("r1"), F.max("row").alias("r2"))
    # islands at a band's border are joined over borders, two of a band at most; others are whole
    border = (F.col("r1") == F.col("band") * BAND) | (F.col("r2") == (F.col("band") + 1) * BAND - 1)
    here = here.withColumn("part", F.when(border, -1).otherwise(F.col("band")))
    along = W.Window.partitionBy(*keys, "col", "part").orderBy("r1")
    here = here.withColumn("fresh", F.when(F.lag("r2").over(along) == F.col("r1") - 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(along))
    tall = here.groupBy(*keys, "col", "part", "run").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2"))
    box = [f(x).alias(y) for f, x, y in ((F.min, "row", "r1"), (F.min, "col", "c1"), (F.max, "row", "r2"), (F.max, "col", "c2"))]
    vertical = tall.where("r2 > r1").select(*keys, "r1", F.col("col").alias("c1"), "r2", F.col("col").alias("c2"), F.lit("rows").alias("shape"))
    across = W.Window.partitionBy(*keys, "row").orderBy("col")
    rest = tall.where("r2 = r1").select(*keys, F.col("r1").alias("row"), "col").withColumn("island", F.col("col") - F.row_number().over(across))
    flat = rest.groupBy(*keys, "row", "island").agg(*box, F.count("*").alias("n"))
    horizontal = flat.select(*keys, "r1", "c1", "r2", "c2", F.when(F.col("n") > 1, "columns").otherwise("single").alias("shape"))
    return vertical.unionByName(horizontal)


def assign_formulas(formulas: DataFrame, tables: DataFrame, footer: int = 5, side: int = 3) -> DataFrame:
    """Formula cells of each table: within its rows and `footer` below them, and `side` columns around; a cell may have several.

    formulas: wb_id, sheet, row, col, raw; tables: wb_id, sheet, table_id, r1, c1, r2, c2. Both meet by blocks of rows (rows_in_areas()).
    """
    return _assigned(formulas, tables, footer, side).select("wb_id", "sheet", "table_id", "row", "col", "raw")


def _assigned(formulas: DataFrame, tables: DataFrame, footer: int = 5, side: int = 3) -> DataFrame:
    """assign_formulas() with the column block: a table's rows of a band are in one block, by which Spark has dealt them."""
    own = tables.select("wb_id", "sheet", "table_id", "r1", "c1", (F.col("r2") + footer).alias("r2"), "c2")
    beside = F.col("col").between(F.col("c1") - side, F.col("c2") + side)
    return rows_in_areas(formulas, own, ["wb_id", "sheet"]).where(beside).select("wb_id", "sheet", "table_id", "block_size", "block", "row", "col", "raw")


def narrowest_header(refs: DataFrame, headers: DataFrame, relaxed: bool = True) -> DataFrame:
    """Of each ref (ref_id, table_id, r1, c1, r2, c2) the header whose data range covers it; else, if relaxed, one covering its columns, or rows if by row.

    headers: table_id, header_id, ord, r1, c1, r2, c2 (data range), by_row. Column headers are met by a column, row headers by a
    band of rows, so that neither many refs nor a wide table is one key.
    """
    h = headers.select("table_id", "header_id", "ord", F.coalesce("by_row", F.lit(False)).alias("by_row"), *(F.col(x).alias(f"h_{x}") for x in ("r1", "c1", "r2", "c2")))
    cols = (F.col("h_c1") <= F.col("c1")) & (F.col("h_c2") >= F.col("c2"))
    rows = (F.col("h_r1") <= F.col("r1")) & (F.col("h_r2") >= F.col("r2"))
    rank = F.struct((~(cols & rows)).alias("relaxed"), (F.col("h_c2") - F.col("h_c1")).alias("w"), (F.col("h_r2") - F.col("h_r1")).alias("h"), "ord")
    of_column = h.where("not by_row").withColumn("at", F.explode(F.sequence("h_c1", "h_c2")))
    by_column = refs.withColumn("at", F.col("c1")).join(of_column, ["table_id", "at"]).where(cols if relaxed else cols & rows)
    of_rows = bands(h.where("by_row"), "h_r1", "h_r2")
    by_rows = bands(refs, "r1", "r1").join(of_rows, ["table_id", "band"]).where(rows if relaxed else cols & rows)
    found = by_column.select("ref_id", "header_id", rank.alias("rank")).unionByName(by_rows.select("ref_id", "header_id", rank.alias("rank")))
    return found.groupBy("ref_id").agg(F.min_by("header_id", "rank").alias("header_id"))


def expressions(examples: DataFrame, headers: DataFrame) -> DataFrame:
    """relation key and expression: a formula with the headers' ids in place of references, `target = formula`.

    examples: key, table_id, row, col, raw; headers as in narrowest_header(). A reference without a header keeps its address.
    The target is its cell's header; below that header's data it is total_, average_ and so on, or summary_, before the id.
    """
    parts = examples.select("key", "table_id", F.posexplode(pieces("raw")).alias("i", "p"))
    ref_id = F.concat_ws("|", "key", "i")
    refs = parts.where("p.r1 is not null").select(ref_id.alias("ref_id"), "table_id", "p.r1", "p.c1", "p.r2", "p.c2")
    cells = examples.select(F.concat(F.lit("cell|"), "key").alias("ref_id"), "table_id", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    found = narrowest_header(refs.unionByName(cells), headers)
    named = parts.withColumn("ref_id", ref_id).join(found, "ref_id", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("header_id", "p.text").alias("t")))).alias("x"))
    body = named.select("key", F.array_join("x.t", "").alias("body"))
    lowest = headers.groupBy("table_id", "header_id").agg(F.max("r2").alias("lowest"))
    own = examples.withColumn("ref_id", F.concat(F.lit("cell|"), "key")).join(found, "ref_id", "left").join(lowest, ["table_id", "header_id"], "left")
    outer = F.lower(aggregate_function(F.col("raw")))
    prefix = F.when(outer.isNull(), "summary").when(outer == "sum", "total").otherwise(outer)
    target = F.when(F.col("header_id").isNull(), cell_a1(F.col("row"), F.col("col"))).when(F.col("row") > F.col("lowest"), F.concat(prefix, F.lit("_"), "header_id")).otherwise(F.col("header_id"))
    return own.select("key", target.alias("target")).join(body, "key").select("key", spacing(F.concat("target", F.lit(" = "), "body")).alias("expression"))


def _ends(pieces: DataFrame, keys: list[str], order: str, first: str, last: str, apart: Column | None = None) -> DataFrame:
    """Pieces from first to last as whole runs, with a run's first piece's other columns: what follows another directly, or repeats it, joins it; pieces that are apart stay alone, once."""
    along = W.Window.partitionBy(*keys).orderBy(order)
    apart = F.col("bad") if apart is None else apart
    gap = F.when(apart, 0).otherwise(1)
    begins = F.coalesce(F.col(first) > F.lag(last).over(along) + gap, F.lit(True))
    ends = F.coalesce(F.lead(first).over(along) > F.col(last) + gap, F.lit(True))
    kept = pieces.withColumn("begins", begins).withColumn("ends", ends).where("begins or ends")
    kept = kept.withColumn(last, F.when(F.col("ends"), F.col(last)).otherwise(F.lead(last).over(along)))
    return kept.where("begins").drop("begins", "ends")


def extract_relations(formulas: DataFrame, tables: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Relations of each table: repeated formulas by run, single ones as aggregate or cell formulas, broken ones as invalid.

    Returns wb_id, sheet, table_id, relation_id, category (normal, aggregate, cell, invalid), r1, c1, r2, c2, pattern (of runs),
    agg_function, cell and raw (of the first cell), errors, description and, with headers (as in narrowest_header(), table ids
    of all sheets told apart), expression. Ids say what a relation is and count up by table and category: forms in order of
    their first cells, of each its runs down columns, then those across rows.
    """
    key = ["wb_id", "sheet", "table_id"]
    own = _assigned(formulas, tables).withColumn("bad", F.size(formula_errors(F.col("raw"))) > 0)
    form = F.when(F.col("bad"), F.col("raw")).otherwise(normal_form(F.when(~F.col("bad"), F.col("raw")), F.col("row"), F.col("col")))
    # forms are told apart by 128 bits; each step below is one sort, after which only what begins or ends a run goes on
    own = own.withColumn("form", form).withColumn("f1", F.xxhash64("form")).withColumn("f2", F.xxhash64(F.lit("form"), "form"))
    same = ["bad", "f1", "f2"]
    # runs within bands, where the cells are: a band is in one block; a broken cell is alone
    cells = own.withColumn("band", F.floor(F.col("row") / BAND)).select(*key, "block_size", "block", *same, "col", "band", F.col("row").alias("r1"), F.col("row").alias("r2"), "raw")
    here = _ends(cells, [*key, "block_size", "block", *same, "col", "band"], "r1", "r1", "r2")
    # from here on a table's runs are together, as its relations are numbered: over borders of bands, then across rows
    tall = _ends(here.select(*key, *same, "col", "r1", "r2", "raw").repartition(*key), [*key, *same, "col"], "r1", "r1", "r2")
    tall = tall.withColumn("down", F.min("r1").over(W.Window.partitionBy(*key, *same, "col"))).withColumn("g", F.min(F.struct(F.col("r1").alias("row"), "col")).over(W.Window.partitionBy(*key, *same)))
    tall = tall.withColumn("alone", F.col("bad") | (F.col("r2") > F.col("r1"))).withColumn("c1", F.col("col").cast("bigint")).withColumn("c2", F.col("col").cast("bigint"))
    segments = _ends(tall, [*key, *same, "alone", "r1"], "c1", "c1", "c2", F.col("alone"))
    column = dict(formulas.dtypes)["col"]
    segments = segments.withColumn("c1", F.col("c1").cast(column)).withColumn("c2", F.col("c2").cast(column))
    segments = segments.withColumn("shape", F.when(F.col("r2") > F.col("r1"), "rows").when(F.col("c2") > F.col("c1"), "columns").otherwise("single"))
    agg_function = F.when(~F.col("bad"), aggregate_function(F.col("raw")))
    category = F.when(F.col("bad"), "invalid").when(F.col("shape") != "single", "normal").when(agg_function.isNotNull(), "aggregate").otherwise("cell")
    first_cell = F.struct(F.col("r1").alias("row"), F.col("c1").alias("col"))
    flat = F.col("shape") != "rows"
    order = F.struct(F.when(F.col("bad"), first_cell).otherwise(F.col("g")).alias("g"), flat.alias("across"), F.when(flat, F.col("r1")).otherwise(F.col("down")).alias("x"), F.col("c1").alias("y"), F.col("r1").alias("z"))
    every = segments.select(*key, category.alias("category"), "shape", "r1", "c1", "r2", "c2", agg_function.alias("agg_function"), "raw", order.alias("order"))
    number = F.row_number().over(W.Window.partitionBy(*key, "category").orderBy("order"))
    arithmetic = F.col("raw").rlike(r"[*/+-]")
    letters = F.lower(column_letters(F.col("c1")))
    row_kind = F.when(F.col("agg_function") == "SUM", "sum").when(F.col("agg_function") == "SUBTOTAL", "subtotal").when(arithmetic, "arithmetic").otherwise("formula")
    name = (
        F.when((F.col("category") == "normal") & (F.col("shape") == "rows"), F.concat(F.lit("rel_repeat_row_"), row_kind, F.lit("_"), letters))
        .when(F.col("category") == "normal", F.concat(F.lit("rel_repeat_column_formula_"), F.col("r1").cast("string")))
        .when(F.col("category") == "aggregate", F.concat(F.lit("rel_aggregate_"), F.lower("agg_function")))
        .when(F.col("category") == "invalid", "rel_invalid_ref")
        .when(arithmetic & ~F.contains(F.upper("raw"), F.lit("IF")), "rel_single_arithmetic_formula").otherwise("rel_single_cell_formula")
    )
    every = every.withColumn("number", number)
    every = every.withColumn("relation_id", F.concat(name, F.lit("_"), F.col("number").cast("string"))).withColumn("cell", cell_a1(F.col("r1"), F.col("c1"))).withColumn("errors", formula_errors(F.col("raw")))
    repeated = F.col("category") == "normal"
    every = every.withColumn("pattern", pattern(F.when(repeated, F.col("raw")), F.col("r1"), F.col("c1"), F.col("shape") == "rows"))
    every = every.withColumn("description", description(F.col("category"), F.col("shape"), F.coalesce("pattern", "raw"), F.col("agg_function"), F.col("cell"), F.col("errors")))
    columns = [*key, "relation_id", "category", "r1", "c1", "r2", "c2", "pattern", "agg_function", "cell", "raw", "errors", "description"]
    if headers is None:
        return every.select(*columns)
    every = every.withColumn("key", F.concat_ws("|", *key, "relation_id"))
    examples = every.where("category <> 'invalid'").select("key", "table_id", F.col("r1").alias("row"), F.col("c1").alias("col"), "raw")
    return every.join(expressions(examples, headers), "key", "left").select(*columns, "expression")


def relation_tables(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """relation_key and table_ids: the table that a relation names if it is known, else every table of its sheet whose bounds hold its range.

    relations: relation_key (of any type, one row each), wb_id, sheet (null: any), table_id (may be null), r1, c1, r2, c2; tables:
    wb_id, sheet, table_id, r1, c1, r2, c2. Both meet by blocks of rows (area_blocks()), where a relation's row stays one row.
    """
    places = ["r1", "c1", "r2", "c2"]
    own = ["relation_key", "wb_id", "sheet", "table_id", *places]
    there, used = area_blocks(tables.select(F.col("wb_id").alias("t_wb"), F.col("sheet").alias("t_sheet"), F.col("table_id").alias("t_id"), *(F.col(x).alias(f"t_{x}") for x in places)), "t_r1", "t_r2")
    names = there.select(F.col("t_wb").alias("wb_id"), F.col("t_id").alias("table_id")).distinct().withColumn("known", F.lit(True))
    found = relations.select(*own).join(names, ["wb_id", "table_id"], "left").withColumn("held", F.array().cast("array<string>"))
    inside = (F.col("t_r1") <= F.col("r1")) & (F.col("t_r2") >= F.col("r2")) & (F.col("t_c1") <= F.col("c1")) & (F.col("t_c2") >= F.col("c2"))
    for size in used:
        part = there.where(F.col("block_size") == size).withColumnRenamed("block", "t_block")
        meet = (F.col("wb_id") == F.col("t_wb")) & (F.col("block") == F.col("t_block")) & inside & F.col("known").isNull() & (F.col("sheet").isNull() | (F.col("sheet") == F.col("t_sheet")))
        held = found.withColumn("block", F.floor(F.col("r1") / size)).join(part, meet, "left")
        found = held.groupBy(*own, "known", "held", "block").agg(F.collect_set("t_id").alias("more")).withColumn("held", F.array_union("held", "more"))
    return found.select("relation_key", F.when(F.col("known"), F.array("table_id")).otherwise(F.sort_array("held")).alias("table_ids"))


def list_relations(relations: DataFrame, category: str | None = None, table_id: str | None = None) -> DataFrame:
    """Relations of a category and of a table (a column table_ids, as relation_tables() gives it), in order of their ids."""
    out = relations if category is None else relations.where(F.col("category") == category)
    return out if table_id is None else out.where(F.array_contains("table_ids", table_id))


def recalculate_rows(rows: DataFrame, formula: Column, mutations: DataFrame, keys: list[str], inputs: list[str], out: str = "value") -> DataFrame:
    """What-if values of one row-wise relation for all rows and scenarios.

    mutations: scenario, keys, column, value. Each scenario sees its own values in place of a row's; rows that a scenario
    doesn't touch are not repeated. formula is a Column over the inputs.
    """
    changed = mutations.where(F.col("column").isin(inputs)).groupBy("scenario", *keys).pivot("column", inputs).agg(F.first("value"))
    changed = changed.select("scenario", *keys, *(F.col(c).alias(f"m_{c}") for c in inputs))
    joined = rows.join(changed, keys)
    overlay = joined.select("scenario", *keys, *(F.coalesce(f"m_{c}", c).alias(c) for c in inputs))
    return overlay.withColumn(out, formula)


def recalculate_graph(edges: DataFrame, constants: DataFrame, most_levels: int | None = None) -> DataFrame:
    """Values of cells that are weighted sums of other cells: scenario, cell, value, state (value or circular).

    edges: scenario, cell, ref, weight; constants: scenario, cell, value. A constant (a mutation) wins over a cell's formula.
    Cells that never resolve, as they depend on themselves or on something blank, are circular with a null value.
    Each round puts in the values of resolved cells, and in place of a cell with one open reference what it refers to, so that
    a chain halves. A round resolves at least one cell or none ever will; more than most_levels rounds raise, if given.
    """
    key = ["scenario", "cell"]
    known = cut(constants.select(*key, "value"))
    found = known.where("value is not null").select("scenario", F.col("cell").alias("ref"), "value")
    first = cut(edges.join(known.select(*key), key, "left_anti").join(found, ["scenario", "ref"], "left").select(*key, "ref", "weight", "value"))
    links = cut(first.where("value is null").groupBy(*key, "ref").agg(F.sum("weight").alias("weight")))
    own = first.groupBy(*key).agg(F.coalesce(F.sum(F.col("weight") * F.col("value")), F.lit(0.0)).alias("base"))
    opened = lambda nodes, links: cut(nodes.join(links.groupBy(*key).agg(F.count("*").alias("n")), key, "left").select(*key, "base", F.coalesce("n", F.lit(0)).alias("n")))
    nodes, solved, rounds = opened(own, links), None, 0
    while True:
        ready = nodes.where("n = 0").select(*key, F.col("base").alias("value"))
        if ready.isEmpty():
            break
        rounds += 1
        if most_levels is not None and rounds > most_levels:
            raise RuntimeError(f"cells still resolve after {most_levels} rounds")
        solved = cut(ready if solved is None else solved.unionByName(ready))
        # a reference to a resolved cell goes, one to a cell with a single open reference moves on to that; others stay
        ends = solved.select("scenario", F.col("cell").alias("ref"), F.col("value").alias("base"), F.lit(None).cast(links.schema["ref"].dataType).alias("next"), F.lit(None).cast("double").alias("factor"))
        passed = nodes.where("n = 1").join(links, key).select("scenario", F.col("cell").alias("ref"), "base", F.col("ref").alias("next"), F.col("weight").alias("factor")).unionByName(ends).withColumn("passes", F.lit(True))
        moved = links.join(passed, ["scenario", "ref"], "left")
        target = F.when(F.col("passes"), F.col("next")).otherwise(F.col("ref"))
        moved = cut(moved.select(*key, target.alias("ref"), (F.col("weight") * F.coalesce("factor", F.lit(1.0))).alias("weight"), F.coalesce(F.col("weight") * F.col("base"), F.lit(0.0)).alias("add")))
        links = cut(moved.where("ref is not null").groupBy(*key, "ref").agg(F.sum("weight").alias("weight")))
        added = moved.groupBy(*key).agg(F.sum("add").alias("add"))
        nodes = opened(nodes.where("n > 0").join(added, key).select(*key, (F.col("base") + F.col("add")).alias("base")), links)
    stuck = nodes.select(*key, F.lit(None).cast("double").alias("value"), F.lit("circular").alias("state"))
    values = known if solved is None else known.unionByName(solved)
    return values.withColumn("state", F.lit("value")).unionByName(stuck)
