"""The data source of workbook files: partitions, streams, memory."""

import subprocess
import sys
import zipfile

from gridspark.sources import workbooks, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, shared=("one", "two")):
    """A workbook of (name, XML of its rows) sheets."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>")
        for i, (_, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                part.write(f"<worksheet {MAIN}><sheetData>".encode())
                for row in rows:
                    part.write(row.encode())
                part.write(b'</sheetData><mergeCells count="1"><mergeCell ref="A1:B2"/></mergeCells></worksheet>')


def numbers(n):
    return (f'<row r="{r}"><c r="A{r}" t="s"><v>{r % 2}</v></c><c r="B{r}"><v>{r}</v></c><c r="C{r}"><f>B{r}*2</f><v>{2 * r}</v></c></row>' for r in range(1, n + 1))


def test_sheets_are_partitions(spark, tmp_path):
    (tmp_path / "below").mkdir()
    book(tmp_path / "a.xlsx", [("First", numbers(50)), ("Empty", []), ("Third", numbers(7))])
    book(tmp_path / "below" / "b.xlsx", [("Only", numbers(3))])
    (tmp_path / "notes.txt").write_text("no workbook")
    xlsx.register(spark)
    found = spark.read.format("xlsx_cells").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    rows = {(r.wb_id, r.sheet, r["row"], r.col): (r.kind, r.s, r.n, r.formula) for r in found.collect()}
    assert len(rows) == 3 * 60 and {k[:2] for k in rows} == {("a.xlsx", "First"), ("a.xlsx", "Third"), ("below/b.xlsx", "Only")}
    assert rows["a.xlsx", "First", 3, 1] == ("text", "two", None, None) and rows["a.xlsx", "Third", 7, 3] == ("formula", None, 14.0, "=B7*2")
    stored = spark.read.format("xlsx_cells").option("dataonly", "true").load(str(tmp_path / "below" / "b.xlsx"))
    assert sorted((r.wb_id, r["row"], r.n) for r in stored.where("col = 3").collect()) == [("b.xlsx", 1, 2.0), ("b.xlsx", 2, 4.0), ("b.xlsx", 3, 6.0)]
    # the same cells as by way of Spark's own files
    columns = ["sheet", "row", "col", "kind", "s", "n", "formula"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, workbooks.read_workbooks(spark, str(tmp_path)).select(columns).collect()))


def test_no_files(spark, tmp_path):
    xlsx.register(spark)
    assert spark.read.format("xlsx_cells").load(str(tmp_path)).count() == 0


def test_a_million_rows_in_little_memory(tmp_path):
    """A sheet of a million rows in a process of its own, as a task reads it; its peak stays below 300 MB."""
    book(tmp_path / "big.xlsx", [("Small", numbers(2)), ("Big", numbers(1_000_000))])
    code = f"""
import resource
from gridspark.sources.xlsx import Reader
reader = Reader({{"path": {str(tmp_path)!r}}})
parts = reader.partitions()
print(len(parts), sum(b.num_rows for b in reader.read(parts[1])), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert found[:2] == ["2", "3000000"] and int(found[2]) < 300
