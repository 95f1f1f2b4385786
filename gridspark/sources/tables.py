"""Tables inside texts, as cells: doc_id, row, col, s, and merged areas. Rows and columns count from 1."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

CELLS = "doc_id bigint, row int, col int, s string, rows int, cols int"


def source_format(text: Column) -> Column:
    """html, latex, json or text, by how a table's text starts."""
    tidy = F.trim(text)
    return F.when(tidy.startswith("<"), "html").when(F.contains(tidy, F.lit("\\begin{tabular}")), "latex").when(F.try_parse_json(tidy).isNotNull(), "json").otherwise("text")


def text_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cells of plain texts: lines split at pipes, outer pipes off, blank lines and rules of dashes left out; a line without pipes is one cell."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    tidy = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(r"^[|\s:+-]*-{3,}[|\s:+-]*$"))
    inner = F.regexp_replace("line", r"^\||\|$", "")
    numbered = tidy.withColumn("row", F.row_number().over(W.Window.partitionBy("doc_id").orderBy("i")))
    parts = F.when(F.contains("line", F.lit("|")), F.split(inner, r"\|")).otherwise(F.array("line"))
    return numbered.select("doc_id", "row", F.posexplode(parts).alias("c", "s")).select("doc_id", "row", (F.col("c") + 1).alias("col"), F.trim("s").alias("s"))


class _FirstTable(HTMLParser):
    """Cells of the first table: row, col, text, spanned rows and columns."""

    def __init__(self):
        super().__init__()
        self.cells, self.taken, self.row, self.col, self.open, self.depth, self.done = [], set(), 0, 1, None, 0, False
        self.caption, self.in_caption = None, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "caption":
            self.in_caption, self.caption = self.caption is None, self.caption or ""
        elif self.depth == 1 and tag == "tr":
            self.row, self.col = self.row + 1, 1
        elif self.depth == 1 and tag in ("td", "th"):
            spans = dict(attrs)
            size = lambda name: max(1, int(spans[name])) if str(spans.get(name, "")).isdigit() else 1
            while (self.row, self.col) in self.taken:
                self.col += 1
            self.open = [self.row, self.col, "", size("rowspan"), size("colspan")]
            self.taken |= {(self.row + i, self.col + j) for i in range(self.open[3]) for j in range(self.open[4])}
        elif tag == "br" and self.open:
            self.open[2] += " "

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag == "caption":
            self.in_caption = False
        elif tag in ("td", "th") and self.open and self.depth == 1:
            self.open[2] = " ".join(self.open[2].split())
            self.cells.append(tuple(self.open))
            self.col += self.open[4]
            self.open = None

    def handle_data(self, data):
        if self.in_caption and not self.done:
            self.caption += data
        elif self.open and not self.done:
            self.open[2] += data


def html_caption(text: str) -> str:
    """The first table's caption, or an empty text."""
    parser = _FirstTable()
    parser.feed(text)
    return " ".join((parser.caption or "").split())


def html_rows(text: str):
    parser = _FirstTable()
    parser.feed(text)
    return parser.cells


_GROUP = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def _latex_text(cell: str) -> str:
    """A cell's words: nested tables are joined, commands give way to their last argument."""
    cell = re.sub(r"\\(?:begin|end)\{[a-z*]+\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " ", cell).replace("\\\\", " ")
    while (bare := re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*\{([^{}]*)\}", r"\1", cell)) != cell:
        cell = bare
    cell = re.sub(r"\\([&%$#_{}])", r"\1", re.sub(r"\\[a-zA-Z]+\*?", " ", cell))
    return " ".join(re.sub(r"[{}$]|~", " ", cell).split())


def _split_outside(text: str, mark: str) -> list[str]:
    """text cut at marks that are in no braces and no nested table."""
    parts, depth, at = [""], 0, 0
    for token in re.split(r"(\\begin\{tabular\}|\\end\{tabular\}|\\\\|\\.|[{}&])", text):
        depth += token in ("\\begin{tabular}", "{")
        depth -= token in ("\\end{tabular}", "}")
        if token == mark and depth <= 0:
            parts.append("")
        else:
            parts[-1] += token
        at += 1
    return parts


def latex_rows(text: str):
    found = re.search(r"\\begin\{tabular\}(?:\[[^\]]*\])?" + _GROUP + r"(.*)\\end\{tabular\}", text, re.S)
    cells, row = [], 0
    for line in _split_outside(found[2], "\\\\") if found else []:
        line = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)|\\c(?:line|midrule)(?:\([^)]*\))?\{[^}]*\}", "", line)
        if not line.strip():
            continue
        row, col = row + 1, 1
        for cell in _split_outside(line, "&"):
            span = re.match(r"\s*\\multicolumn\{(\d+)\}\{[^{}]*\}", cell)
            width = int(span[1]) if span else 1
            cells.append((row, col, _latex_text(cell[span.end() :] if span else cell), 1, 1))
            cells += [(row, col + i, "", 1, 1) for i in range(1, width)]
            col += width
    return cells


def json_rows(text: str):
    """Cells of a JSON table: texts with merged_regions, or rows, data, table or values, or pairs of keys and values."""
    payload = json.loads(text)
    spans = {}
    if isinstance(payload, dict):
        for m in payload.get("merged_regions") or []:
            spans[m["first_row"], m["first_column"]] = m["last_row"] - m["first_row"] + 1, m["last_column"] - m["first_column"] + 1
        listed = next((payload[k] for k in ("texts", "rows", "data", "table", "values") if isinstance(payload.get(k), list)), None)
        if listed is None:
            listed = list(map(list, payload.items()))
    else:
        listed = payload if isinstance(payload, list) else [payload]
    cells = []
    for i, line in enumerate(listed):
        line = [f"{k}: {v}" for k, v in line.items()] if isinstance(line, dict) else line if isinstance(line, list) else [line]
        cells += [(i + 1, j + 1, "" if v is None else v if isinstance(v, str) else json.dumps(v), *spans.get((i, j), (1, 1))) for j, v in enumerate(line)]
    return cells


def parsed_cells(docs: DataFrame, parse: Callable[[str], list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cells of every text by a parser of one table (html_rows, latex_rows, json_rows): doc_id, row, col, s, rows, cols (spans)."""

    def run(frames):
        for frame in frames:
            rows = [(i, *cell) for i, text in zip(frame["doc_id"], frame["text"], strict=True) if text for cell in parse(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "col", "s", "rows", "cols"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, CELLS)


def captions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, title of HTML texts whose first table has a caption: what stacked() sets above a table."""

    def run(frames):
        for frame in frames:
            found = [(i, html_caption(text)) for i, text in zip(frame["doc_id"], frame["text"], strict=True) if text]
            yield pd.DataFrame([x for x in found if x[1]], columns=["doc_id", "title"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id bigint, title string")


def payload_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord (from 1), title, text of each table of JSON payloads: an object with a list `tables`, or a list of objects.

    A table without a title is called by its place. Other texts, and null, have no tables.
    """
    tidy = F.trim(text_col)
    of_object = F.from_json(tidy, "struct<tables:array<string>>")["tables"]
    listed = F.when(tidy.rlike(r"^\[\s*\{"), F.from_json(tidy, "array<string>")).otherwise(of_object)
    each = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode(listed).alias("i", "text")).where("text is not null")
    place = (F.col("i") + 1).cast("int")
    title = F.get_json_object("text", "$.title")
    return each.select("doc_id", place.alias("ord"), F.when(title != "", title).otherwise(F.concat(F.lit("Table "), place.cast("string"))).alias("title"), "text")


def payload_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cells of each table of JSON payloads: doc_id, ord, row, col, s, rows, cols; stacked() puts them below each other."""

    def run(frames):
        for frame in frames:
            rows = [(i, k, *cell) for i, k, text in zip(frame["doc_id"], frame["ord"], frame["text"], strict=True) for cell in json_rows(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "row", "col", "s", "rows", "cols"])

    return payload_tables(docs, id_col, text_col).select("doc_id", "ord", "text").mapInPandas(run, CELLS.replace("bigint,", "bigint, ord int,", 1))


def any_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cells of texts of all formats."""
    kind = docs.withColumn("_format", source_format(F.col(text_col)))
    out = text_cells(kind.where("_format = 'text'"), id_col, text_col).withColumn("rows", F.lit(1)).withColumn("cols", F.lit(1))
    for name, parse in (("html", html_rows), ("latex", latex_rows), ("json", json_rows)):
        out = out.unionByName(parsed_cells(kind.where(F.col("_format") == name), parse, id_col, text_col))
    return out


def merges_of(cells: DataFrame) -> DataFrame:
    """Merged areas of cells with spans."""
    return cells.where("rows > 1 or cols > 1").select("doc_id", F.col("row").alias("r1"), F.col("col").alias("c1"), (F.col("row") + F.col("rows") - 1).alias("r2"), (F.col("col") + F.col("cols") - 1).alias("c2"))


def stacked(cells: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Tables of one key below each other: title row, table, two blank rows; cells and titles have key, ord (and title)."""
    height = cells.groupBy(key, "ord").agg(F.max("row").alias("height"))
    before = F.coalesce(F.sum(F.coalesce("height", F.lit(0)) + 3).over(W.Window.partitionBy(key).orderBy("ord").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    placed = titles.join(height, [key, "ord"], "left").withColumn("offset", before)
    heads = placed.select(key, (F.col("offset") + 1).cast("bigint").alias("row"), F.lit(1).alias("col"), F.col("title").alias("s"))
    return heads.unionByName(cells.join(placed.select(key, "ord", "offset"), [key, "ord"]).select(key, (F.col("row") + F.col("offset") + 1).cast("bigint").alias("row"), "col", "s"))


def rectangular(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells with blanks added as empty texts, so that every row of a table has as many columns."""
    size = cells.groupBy(key).agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = size.select(key, "c", F.explode(F.sequence(F.lit(1).cast("int"), F.col("r").cast("int"))).alias("row")).select(key, "row", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("col"))
    return grid.join(cells, [key, "row", "col"], "left").select(key, "row", "col", F.coalesce("s", F.lit("")).alias("s"))


def markdown_rows(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """A Markdown line for each row of a table."""
    tidy = F.regexp_replace(F.regexp_replace("s", r"\|", r"\\|"), r"\r?\n", "<br>")
    parts = cells.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct("col", tidy.alias("s")))).alias("x"))
    return parts.select(key, "row", F.concat(F.lit("| "), F.array_join(F.col("x.s"), " | "), F.lit(" |")).alias("line"))
