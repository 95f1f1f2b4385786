"""Workbook files as cells, merges and properties; their identity; records of cards as files."""

from __future__ import annotations

import datetime
import functools
import io
import itertools
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.formulas import REFERENCE, column_of, letters_of

CELLS = "wb_id string, sheet string, row bigint, col int, kind string, s string, n double, b boolean, ts timestamp, formula string"
MERGES = "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint"
PROPERTIES = "wb_id string, sheet_names array<string>, author string, date_created string, date_modified string"
#: Cells handed on at once.
CHUNK = 20_000
#: Columns of records as CSV. Fixed values.
RECORD_COLUMNS = ["id", "retrieval_type", "retrieval_level", "workbook", "sheet", "table_id", "table_name", "retrieval_card"]
#: Built-in number formats that show dates or times. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Workbook:
    """One .xlsx file: its sheets in order, shared texts, styles and sheets' cells. Sheets are read as streams, a row at a time."""

    def __init__(self, content: bytes | BinaryIO):
        self.zip = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        self.names = set(self.zip.namelist())
        book = self._tree("xl/workbook.xml")
        target = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
        self.sheets = [(s.get("name"), place(target[s.get(f"{_R}id")])) for s in book.iter(f"{_M}sheet")]
        self.epoch = datetime.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_M}workbookPr")) else datetime.datetime(1899, 12, 30)

    @functools.cached_property
    def shared(self) -> list[str]:
        return ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in self._stream("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in self.names else []

    @functools.cached_property
    def date_styles(self) -> set[int]:
        return self._date_styles() if "xl/styles.xml" in self.names else set()

    def _tree(self, name: str):
        return ET.fromstring(self.zip.read(name))

    def _stream(self, name: str, tag: str):
        """The elements of a tag, one after the other; each is forgotten, and what else has passed with it, when the next one is asked for."""
        with self.zip.open(name) as part:
            above = []
            for event, x in ET.iterparse(part, ("start", "end")):
                if event == "start":
                    above.append(x)
                    continue
                above.pop()
                if x.tag == f"{_M}{tag}":
                    yield x
                if above and not any(a.tag == f"{_M}{tag}" for a in above):
                    above[-1].remove(x)

    def _date_styles(self) -> set[int]:
        """Numbers of cell styles whose number format shows dates or times."""
        styles = self._tree("xl/styles.xml")
        bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower()
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_M}numFmt") if re.search("[ymdhs]", bare(f.get("formatCode")))}
        used = styles.find(f"{_M}cellXfs")
        return {i for i, xf in enumerate(used if used is not None else ()) if int(xf.get("numFmtId") or 0) in DATE_FORMATS | own}

    def _time(self, serial: float) -> datetime.datetime:
        return (self.epoch + datetime.timedelta(milliseconds=round(serial * 86_400_000))).replace(tzinfo=datetime.UTC)

    def cells(self, data_only: bool, sheet: int | None = None):
        """(sheet, row, col, kind, s, n, b, ts, formula) of each filled cell, of one sheet if its place is given; formulas have their stored values beside them, data_only leaves only these."""
        for name, path in self.sheets if sheet is None else self.sheets[sheet : sheet + 1]:
            filled: dict[str, tuple[str, int, int]] = {}
            row = 0
            for line in self._stream(path, "row"):
                row, col = int(line.get("r") or row + 1), 0
                for c in line.findall(f"{_M}c"):
                    place = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r") or "")
                    row, col = (int(place[2]), column_of(place[1])) if place else (row, col + 1)
                    value, f, kind = c.findtext(f"{_M}v"), c.find(f"{_M}f"), c.get("t", "n")
                    formula = None if f is None else f.text
                    if f is not None and f.get("t") == "shared":
                        if formula:
                            filled[f.get("si")] = formula, row, col
                        elif f.get("si") in filled:
                            text, r0, c0 = filled[f.get("si")]
                            formula = moved(text, row - r0, col - c0)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                    shown, values = self._value(kind, value, int(c.get("s") or 0))
                    if formula is not None and not data_only:
                        yield name, row, col, "formula", *values, f"={formula}"
                    elif shown is not None:
                        yield name, row, col, shown, *values, None

    def _value(self, kind: str, value: str | None, style: int):
        """A stored value's kind and its (s, n, b, ts); without a value all null."""
        if value is None:
            return None, (None, None, None, None)
        if kind in ("s", "str", "inlineStr", "e"):
            return "text", (self.shared[int(value)] if kind == "s" else value, None, None, None)
        if kind == "b":
            return "bool", (None, None, value == "1", None)
        if kind == "d":
            return "time", (None, None, None, datetime.datetime.fromisoformat(value).replace(tzinfo=datetime.UTC))
        if style in self.date_styles:
            return "time", (None, None, None, self._time(float(value)))
        return "number", (None, float(value), None, None)

    def merges(self):
        for name, path in self.sheets:
            for m in self._stream(path, "mergeCell"):
                box = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref") or "")
                if box:
                    yield name, int(box[2]), column_of(box[1]), int(box[4]), column_of(box[3])

    def properties(self):
        """(sheet names, author, created, modified); what the file doesn't say is null."""
        found = {}
        if "docProps/core.xml" in self.names:
            for x in self._tree("docProps/core.xml"):
                text = (x.text or "").strip()
                found[x.tag.rpartition("}")[2]] = text or None
        iso = lambda x: None if x is None else re.sub(r"Z$", "", x)
        return [name for name, _ in self.sheets], found.get("creator"), iso(found.get("created")), iso(found.get("modified"))


def moved(formula: str, rows: int, cols: int) -> str:
    """A shared formula's text at another of its cells."""

    def corner(col_pin, letters, row_pin, digits):
        return f"{col_pin}{letters if col_pin else letters_of(column_of(letters) + cols)}{row_pin}{digits if row_pin else int(digits) + rows}"

    def put(m: re.Match) -> str:
        if m[3] is None:
            return m[0]
        return (m[1] or "") + corner(m[2], m[3], m[4], m[5]) + (":" + corner(m[6], m[7], m[8], m[9]) if m[7] else "")

    return REFERENCE.sub(put, formula)


def _each(files: DataFrame, rows, ddl: str) -> DataFrame:
    columns = [part.strip().split(" ")[0] for part in ddl.split(", ")]

    def run(frames):
        for frame in frames:
            for wb, content in zip(frame["wb_id"], frame["content"], strict=True):
                for some in itertools.batched(((wb, *row) for row in rows(Workbook(content))), CHUNK):
                    out = pd.DataFrame(some, columns=columns)
                    yield out.astype({"ts": "datetime64[us, UTC]"}) if "ts" in columns else out

    return files.select("wb_id", "content").mapInPandas(run, ddl)


def workbook_cells(files: DataFrame, data_only: bool = False) -> DataFrame:
    """Cells of workbook files (wb_id, content): numbers with a date's format are times, shared formulas are written out, data_only takes stored values."""
    return _each(files, lambda book: book.cells(data_only), CELLS)


def workbook_merges(files: DataFrame) -> DataFrame:
    """Merged areas of workbook files (wb_id, content)."""
    return _each(files, lambda book: book.merges(), MERGES)


def workbook_metadata(files: DataFrame) -> DataFrame:
    """wb_id, name, sheet_names, author, date_created, date_modified, size_bytes of workbook files (wb_id, name, content)."""
    found = _each(files, lambda book: [book.properties()], PROPERTIES)
    size = files.select("wb_id", "name", F.octet_length("content").cast("bigint").alias("size_bytes"))
    return size.join(found, "wb_id").select("wb_id", "name", "sheet_names", "author", "date_created", "date_modified", "size_bytes")


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """wb_id (the content's SHA-256), name, content of all .xlsx files under a path, each distinct content once, at its first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    keyed = files.select(F.sha2("content", 256).alias("wb_id"), "path", "content")
    first = keyed.groupBy("wb_id").agg(F.min("path").alias("path"))
    return keyed.join(first, ["wb_id", "path"]).select("wb_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def read_workbooks(spark: SparkSession, path: str, data_only: bool = False) -> DataFrame:
    """workbook_cells() of all .xlsx files under a path."""
    return workbook_cells(workbook_files(spark, path), data_only)


def normalise(files: DataFrame) -> DataFrame:
    """Workbooks (ord, name, content_hash) with equal contents once and equal names told apart by their hash."""
    first = files.withColumn("r", F.row_number().over(W.Window.partitionBy("content_hash").orderBy("ord"))).where("r = 1").drop("r")
    same = F.count("*").over(W.Window.partitionBy("name"))
    return first.withColumn("name", F.when(same > 1, F.concat("name", F.lit(" ("), F.substring("content_hash", 1, 8), F.lit(")"))).otherwise(F.col("name")))


def write_records(cards: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Cards as JSON lines, one folder for each workbook, and as CSV with RECORD_COLUMNS or the given ones; missing ones are blank."""
    cards.write.mode("overwrite").partitionBy("wb_id").json(f"{path}/json")
    listed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in cards.columns else F.lit("").alias(c) for c in columns or RECORD_COLUMNS]
    cards.select(*listed).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def first_records(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (id, workbook, sheet, table_id) by the given order."""
    place = F.row_number().over(W.Window.partitionBy("id", "workbook", "sheet", "table_id").orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def unwrapped(docs: DataFrame, record: str, order: list[str], text_col: str = "text") -> DataFrame:
    """Records of JSON texts: a list, a wrapper with retrieval_records, artifacts or records, or JSON lines; keep-first by order and place.

    record is the DDL of a record. Texts that cannot be read give nothing.
    """
    fields = f"array<struct<{record}>>"
    wrapper = f"struct<retrieval_records:{fields},artifacts:{fields},records:{fields}>"
    text = F.trim(text_col)
    wrapped = F.from_json(text, wrapper)
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{record}>"))
    listed = F.when(text.startswith("["), F.from_json(text, fields)).otherwise(F.coalesce(wrapped["retrieval_records"], wrapped["artifacts"], wrapped["records"], lines))
    rows = docs.select(*order, F.posexplode(listed).alias("_at", "x")).where("x is not null").select(*order, "_at", "x.*").where("id is not null")
    return first_records(rows, [*order, "_at"]).drop("_at")


def read_records(spark: SparkSession, paths: list[str], schema: str, wrapped: bool = False) -> DataFrame:
    """Retrieval records, the first of each (id, workbook, sheet, table_id) in order of file and place.

    Files of JSON lines are split and read in parallel; wrapped files are lists or wrappers, each read whole as one value.
    """
    if wrapped:
        texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("text"))
        return unwrapped(texts, ",".join(":".join(part.strip().split(" ", 1)) for part in schema.split(",")), ["_file"]).drop("_file")
    rows = spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return first_records(rows, ["_file", "_block", "_at"]).drop("_file", "_block", "_at")
