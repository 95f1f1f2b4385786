"""Cards of tables, sheets and workbooks: the texts that questions are held against, and what they are made of.

headers: wb_id, sheet, table_id, header_id, ord, path (ids from the root), label, description, orientation; tables: wb_id, sheet,
table_id, name, description; relations: wb_id, sheet, table_id, relation_id, description; previews: wb_id, sheet, sheet_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.text import compact

TABLE = ["wb_id", "sheet", "table_id"]
#: How many headers, relations and columns of a table, tables of a sheet and sheets of a workbook a card names. Fixed values.
HEADERS, RELATIONS, COLUMNS, SHOWN_COLUMNS, SUMMARY_COLUMNS, TABLES, DETAILED_TABLES, SHEETS, NAMES = 40, 20, 80, 24, 16, 20, 10, 20, 50


def _line(name: str, value: Column) -> Column:
    """A card's line; null, and so left out, where there is no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))


def header_text(label: Column, header_id: Column, description: Column, orientation: Column) -> Column:
    """`label (id): description [orientation]`, without the parts that are blank."""
    part = lambda before, x, after="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    return F.concat(F.coalesce(label, F.lit("")), part(" (", header_id, ")"), part(": ", description), part(" [", orientation, "]"))


def _first(df: DataFrame, keys: list[str], value: Column, most: int, name: str) -> DataFrame:
    """keys and an array of the first values in order of ord; longer lists are cut before they are joined into a text."""
    return df.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("ord", value.alias("v")))), 1, most)["v"].alias(name))


def column_paths(headers: DataFrame) -> DataFrame:
    """headers with column_path: the labels, or else ids, from the root joined by ` > `."""
    key = [*TABLE, "header_id"]
    named = headers.select(*TABLE, F.col("header_id").alias("at"), F.coalesce(F.nullif("label", F.lit("")), F.col("header_id")).alias("name"))
    steps = headers.select(*key, F.posexplode("path").alias("i", "at")).join(named, [*TABLE, "at"])
    paths = steps.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "name")))["name"], " > ").alias("column_path"))
    return headers.join(paths, key, "left")


def column_text(path: Column, header_id: Column, description: Column, orientation: Column) -> Column:
    """`path (id): description [orientation]`; the id only where the path doesn't hold it."""
    return header_text(path, F.when(~F.contains(path, header_id), header_id), compact(description, 180), orientation)


def table_cards(tables: DataFrame, headers: DataFrame, relations: DataFrame | None = None, previews: DataFrame | None = None) -> DataFrame:
    """A card for each table: workbook, sheet, table, description, its first headers and relations, the beginning of its sheet's text."""
    named = F.coalesce(F.nullif("name", F.lit("")), F.col("table_id"))
    made = tables.join(_first(headers, TABLE, header_text(F.col("label"), F.col("header_id"), F.col("description"), F.col("orientation")), HEADERS, "h"), TABLE, "left")
    lines = [_line("Workbook", F.col("wb_id")), _line("Sheet", F.col("sheet")), _line("Table", F.concat(named, F.lit(" ("), "table_id", F.lit(")"))), _line("Description", F.col("description")), _line("Headers", F.array_join("h", "; "))]
    if relations is not None:
        made = made.join(_first(relations, TABLE, F.concat_ws(" ", "relation_id", "description"), RELATIONS, "r"), TABLE, "left")
        lines.append(_line("Relations", F.array_join("r", "; ")))
    if previews is not None:
        made = made.join(previews, ["wb_id", "sheet"], "left")
        lines.append(_line("Sheet preview", F.substring("sheet_text", 1, 500)))
    return made.select(F.concat_ws(":", *TABLE).alias("card_id"), *TABLE, F.concat_ws("\n", *lines).alias("card"))


def sheet_payloads(tables: DataFrame, headers: DataFrame, previews: DataFrame) -> DataFrame:
    """What a sheet's metadata card says: wb_id, sheet, description, sheet_summary, preview, tables (id, name, description, summary, columns, column_count).

    A sheet without a table is described by its text. Ranges are not taken over: they say nothing to a question.
    """
    h = column_paths(headers)
    column = F.struct(F.col("header_id").alias("id"), F.coalesce("column_path", "label", "header_id").alias("path"), column_text(F.coalesce("column_path", "label", "header_id"), F.col("header_id"), F.col("description"), F.col("orientation")).alias("text"))
    columns = _first(h, TABLE, column, COLUMNS, "columns")
    named = F.coalesce(F.nullif("name", F.lit("")), F.col("table_id"))
    shown = compact(F.col("description"), 500)
    names = F.filter(F.slice("columns", 1, SUMMARY_COLUMNS)["path"], lambda x: x != "")
    summary = compact(F.concat_ws(". ", named, F.nullif(shown, F.lit("")), F.when(F.size(names) > 0, F.concat(F.lit("Columns: "), F.array_join(names, "; ")))), 900)
    t = tables.join(columns, TABLE, "left").withColumn("columns", F.coalesce("columns", F.array().cast(columns.schema["columns"].dataType.simpleString())))
    one = F.struct("table_id", F.col("table_id").alias("id"), named.alias("name"), shown.alias("description"), summary.alias("summary"), F.col("columns.text").alias("columns"), F.size("columns").alias("column_count"))
    of_sheet = t.groupBy("wb_id", "sheet").agg(F.sort_array(F.collect_list(one)).alias("tables"))
    s = previews.join(of_sheet, ["wb_id", "sheet"], "full")
    listed = F.array_join(F.slice("tables.name", 1, 10), "; ")
    described = F.coalesce(F.nullif(listed, F.lit("")), compact(F.col("sheet_text"), 500))
    whole = F.when(F.col("tables").isNull(), described).otherwise(compact(F.concat(F.lit("Sheet "), "sheet", F.lit(". "), F.array_join(F.slice("tables.summary", 1, 8), " ")), 1600))
    return s.select("wb_id", "sheet", described.alias("description"), whole.alias("sheet_summary"), compact(F.col("sheet_text"), 900).alias("preview"), "tables")


def _table_detail(most: int, prefix: str) -> Column:
    """A line for each of a sheet's first tables."""
    listed = lambda t: F.when(F.size(t["columns"]) > 0, F.concat(F.lit("Columns: "), F.array_join(F.slice(t["columns"], 1, most), "; ")))
    blank = lambda x: F.nullif(x, F.lit(""))
    return lambda t: F.concat(F.lit(prefix), F.concat_ws(" | ", blank(t["id"]), blank(t["name"]), blank(t["description"]), blank(t["summary"]), listed(t)))


def sheet_cards(payloads: DataFrame) -> DataFrame:
    """card_id, wb_id, sheet, card: a metadata card for each of sheet_payloads()."""
    tables = F.coalesce("tables", F.array().cast(payloads.schema["tables"].dataType.simpleString()))
    detail = F.transform(F.slice(tables, 1, TABLES), _table_detail(SHOWN_COLUMNS, "Table detail: "))
    lines = [
        F.lit("Metadata type: sheet"), _line("Workbook", F.col("wb_id")), _line("Sheet", F.col("sheet")), _line("Description", F.col("description")), _line("Sheet summary", F.col("sheet_summary")),
        _line("Preview", F.col("preview")), F.concat(F.lit("Tables: "), F.array_join(F.slice(tables["name"], 1, TABLES), "; ")),
    ]
    return payloads.select(F.concat("wb_id", F.lit(":"), "sheet", F.lit(":metadata")).alias("card_id"), "wb_id", "sheet", F.concat_ws("\n", *lines, F.nullif(F.array_join(detail, "\n"), F.lit(""))).alias("card"))


def workbook_cards(payloads: DataFrame) -> DataFrame:
    """card_id, wb_id, card: a metadata card for each workbook, over its sheets' payloads in order of name."""
    sheet = F.struct(F.col("sheet").alias("name"), "description", F.col("sheet_summary").alias("summary"), F.coalesce("tables", F.array().cast(payloads.schema["tables"].dataType.simpleString())).alias("tables"))
    g = payloads.groupBy("wb_id").agg(F.sort_array(F.collect_list(sheet)).alias("s"))
    part = lambda key, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{key}="), x))

    def block(x: Column) -> Column:
        head = F.concat(F.lit("Sheet detail: "), F.concat_ws(" | ", part("name", x["name"]), part("description", x["description"]), part("summary", x["summary"]), part("tables", F.array_join(F.slice(x["tables"]["name"], 1, TABLES), "; "))))
        return F.array_join(F.concat(F.array(head), F.transform(F.slice(x["tables"], 1, DETAILED_TABLES), _table_detail(12, "Workbook table detail: "))), "\n")

    every = F.array_join(F.col("s.name"), "; ")
    lines = [
        F.lit("Metadata type: workbook"), _line("Workbook", F.col("wb_id")), F.concat(F.lit("Description: Workbook contains sheets: "), F.array_join(F.slice(F.col("s.name"), 1, NAMES), "; ")),
        F.concat(F.lit("Sheets: "), every), F.array_join(F.transform(F.slice("s", 1, SHEETS), block), "\n"),
    ]
    return g.select(F.concat("wb_id", F.lit(":metadata")).alias("card_id"), "wb_id", F.concat_ws("\n", *lines).alias("card"))


def catalogue_lines(tables: DataFrame, headers: DataFrame, relations: DataFrame, most_headers: int = 20, most_relations: int = 12) -> DataFrame:
    """table key and summary: id, name, description, sheet, first top headers with how many more there are, and first relations' ids."""
    top = headers.where(F.size("path") == 1)
    bit = F.concat("label", F.when(F.coalesce("header_id", F.lit("")) != "", F.concat(F.lit(" ("), "header_id", F.lit(")"))).otherwise(""), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    h = top.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("ord", bit.alias("v"))))["v"].alias("h"))
    r = relations.groupBy(*TABLE).agg(F.slice(F.sort_array(F.collect_list("relation_id")), 1, most_relations).alias("r"))
    more = F.when(F.size("h") > most_headers, F.array(F.concat(F.lit("... "), (F.size("h") - most_headers).cast("string"), F.lit(" more headers")))).otherwise(F.array().cast("array<string>"))
    listed = F.array_join(F.concat(F.slice("h", 1, most_headers), more), "; ")
    lines = [
        F.concat(F.lit("- table_id: "), "table_id"), F.concat(F.lit("  name: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("  description: "), F.coalesce("description", F.lit(""))), F.concat(F.lit("  sheet: "), "sheet"),
        F.concat(F.lit("  headers: "), F.coalesce(F.nullif(listed, F.lit("")), F.lit("(none)"))), F.concat(F.lit("  formula_relations: "), F.coalesce(F.nullif(F.array_join("r", ", "), F.lit("")), F.lit("(none)"))),
    ]
    return tables.join(h, TABLE, "left").join(r, TABLE, "left").select(*TABLE, F.concat_ws("\n", *lines).alias("summary"))


def structure_lines(tables: DataFrame, headers: DataFrame, relations: DataFrame, most_relations: int = 12) -> DataFrame:
    """table key and summary: id, name, description and sheet, all headers indented by level, and first relations with how many more there are.

    headers in pre-order of ord; relations: table key, relation_id, category, range, description, formula.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("- ID: "), text("header_id"), F.lit(", Label: "), text("label"), F.lit(", Description: "), text("description"), F.lit(", Orientation: "), text("orientation"))
    h = headers.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("v"))))["v"].alias("h"))
    said = F.concat(F.lit("  - ID: "), text("relation_id"), F.lit(", Category: "), text("category"), F.lit(", Range: "), text("range"), F.lit(", Description: "), text("description"), F.lit(", Formula: "), text("formula"))
    r = relations.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("relation_id", said.alias("v"))))["v"].alias("r"))
    more = F.when(F.size("r") > most_relations, F.concat(F.lit("  - ... "), (F.size("r") - most_relations).cast("string"), F.lit(" more relations")))
    lines = [
        F.concat(F.lit("Table ID: "), "table_id"), F.concat(F.lit("Table Name: "), text("name")), F.concat(F.lit("Description: "), text("description")), F.concat(F.lit("Sheet: "), "sheet"), F.lit("Headers:"),
        F.nullif(F.array_join("h", "\n"), F.lit("")), F.when(F.size("r") > 0, "Formula Relations:"), F.nullif(F.array_join(F.slice("r", 1, most_relations), "\n"), F.lit("")), more,
    ]
    return tables.join(h, TABLE, "left").join(r, TABLE, "left").select(*TABLE, F.concat_ws("\n", *lines).alias("summary"))


def index_records(cards: DataFrame, workbooks: DataFrame, structures: DataFrame, version: int = 1) -> DataFrame:
    """Cards as they are indexed: with artifact_version, document_name, workbook_sha256, schema_text and workbook_metadata of their workbook, and structure_text of their sheet if it has one.

    workbooks: wb_id, document_name, workbook_sha256, schema_text, workbook_metadata; structures: wb_id, sheet, structure_text.
    """
    joined = cards.join(workbooks, "wb_id").join(structures, ["wb_id", "sheet"], "left")
    return joined.select(*cards.columns, F.lit(version).alias("artifact_version"), "document_name", "workbook_sha256", "schema_text", "workbook_metadata", "structure_text")
