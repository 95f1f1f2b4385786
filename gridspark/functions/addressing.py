"""A1 addresses and boxes as Column functions. A box is a struct of sheet, r1, c1, r2, c2, 1-based and inclusive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest row and column of a sheet. Fixed values.
LAST_ROW, LAST_COLUMN = 1048576, 16384
#: In place of LAST_ROW for a table seen as a sheet, which is as long as its keys go.
ANY_ROW = 10**18 - 1
BOX = "struct<sheet:string,r1:bigint,c1:bigint,r2:bigint,c2:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def column_number(letters: Column) -> Column:
    """Number of a column of up to three letters; null for anything else."""

    def number(upper: Column) -> Column:
        codes = F.transform(F.split(upper, ""), lambda c: (F.ascii(c) - 64).cast("bigint"))
        return F.when(upper.rlike("^[A-Z]{1,3}$"), F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, x: s * 26 + x))

    return let(F.upper(letters), number)


def column_letters(number: Column) -> Column:
    """Letters of a column number from 1 to 18278; null beyond."""
    letter = lambda x: F.char(F.lit(65) + x)
    two = lambda n: F.concat(letter(F.floor(n / 26)), letter(n % 26))
    three = lambda n: F.concat(letter(F.floor(n / 676)), letter(F.floor(n / 26) % 26), letter(n % 26))
    return let(number.cast("bigint"), lambda n: F.when(n.between(1, 26), letter(n - 1)).when(n.between(27, 702), two(n - 27)).when(n.between(703, 18278), three(n - 703)))


def cell_a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("bigint").cast("string"))


def box(r1: Column, c1: Column, r2: Column, c2: Column, sheet: Column | None = None) -> Column:
    """A box whose corners may come in either order."""
    long = lambda x: x.cast("bigint")
    return F.struct(
        (sheet if sheet is not None else F.lit(None)).cast("string").alias("sheet"),
        long(F.least(r1, r2)).alias("r1"), long(F.least(c1, c2)).alias("c1"), long(F.greatest(r1, r2)).alias("r2"), long(F.greatest(c1, c2)).alias("c2"),
    )


def box_a1(b: Column) -> Column:
    """A1 text of a box, one cell without a colon, with the sheet's name in front if there is one."""

    def text(x: Column) -> Column:
        first, last = cell_a1(x["r1"], x["c1"]), cell_a1(x["r2"], x["c2"])
        cells = F.when((x["r1"] == x["r2"]) & (x["c1"] == x["c2"]), first).otherwise(F.concat(first, F.lit(":"), last))
        return F.when(x["sheet"].isNull(), cells).otherwise(F.concat(x["sheet"], F.lit("!"), cells))

    return let(b, text)


def parse_box(a1: Column, last_row: int = LAST_ROW) -> Column:
    """Box of an A1 text: a cell, a range, whole columns `A:C` or rows `2:5`, `$` marks and a quoted sheet name allowed; null if it is none, or goes beyond last_row."""
    cells, columns, rows = r"^([A-Z]{1,3})([0-9]{1,18})(?::([A-Z]{1,3})([0-9]{1,18}))?$", r"^([A-Z]{1,3}):([A-Z]{1,3})$", r"^([0-9]{1,18}):([0-9]{1,18})$"
    number = lambda x: F.nullif(x, F.lit("")).cast("bigint")

    def corners(rest: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(rest, pattern, i)
        first = lambda a, b: F.when(b == "", a).otherwise(b)
        of_cells = F.array(number(part(cells, 2)), column_number(part(cells, 1)), number(first(part(cells, 2), part(cells, 4))), column_number(first(part(cells, 1), part(cells, 3))))
        of_columns = F.array(F.lit(1).cast("bigint"), column_number(part(columns, 1)), F.lit(last_row).cast("bigint"), column_number(part(columns, 2)))
        of_rows = F.array(number(part(rows, 1)), F.lit(1).cast("bigint"), number(part(rows, 2)), F.lit(LAST_COLUMN).cast("bigint"))
        return F.when(rest.rlike(cells), of_cells).when(rest.rlike(columns), of_columns).when(rest.rlike(rows), of_rows)

    def made(text: Column) -> Column:
        sheet = F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^(.*)!", 1), r"^'|'$", ""), "''", "'"), F.lit(""))
        rest = F.upper(F.regexp_replace(F.regexp_extract(text, r"([^!]*)$", 1), r"\$", ""))
        return let(let(rest, corners), lambda c: F.when(c.isNotNull(), box(c[0], c[1], c[2], c[3], sheet)))

    return let(let(F.trim(a1), made), lambda b: F.when((b["r1"] >= 1) & (b["r2"] <= last_row) & (b["c2"] <= LAST_COLUMN), b))


def contains_cell(b: Column, row: Column, col: Column) -> Column:
    return row.between(b["r1"], b["r2"]) & col.between(b["c1"], b["c2"])


def contains_box(outer: Column, inner: Column) -> Column:
    return (outer["r1"] <= inner["r1"]) & (outer["c1"] <= inner["c1"]) & (outer["r2"] >= inner["r2"]) & (outer["c2"] >= inner["c2"])


def intersects(a: Column, b: Column, touch: int = 0) -> Column:
    """Whether boxes share a cell, or with touch=1 at least border on each other."""
    rows = (a["r1"] <= b["r2"] + touch) & (b["r1"] <= a["r2"] + touch)
    return rows & (a["c1"] <= b["c2"] + touch) & (b["c1"] <= a["c2"] + touch)


def _same_sheet(a: Column, b: Column) -> Column:
    return a["sheet"].isNull() | b["sheet"].isNull() | (a["sheet"] == b["sheet"])


def intersection(a: Column, b: Column) -> Column:
    """Common box; null if there is none or both name different sheets."""
    sheet = F.coalesce(a["sheet"], b["sheet"])
    common = F.struct(sheet.alias("sheet"), *(f(a[x], b[x]).alias(x) for x, f in (("r1", F.greatest), ("c1", F.greatest), ("r2", F.least), ("c2", F.least))))
    return F.when(_same_sheet(a, b) & intersects(a, b), common)


def union(a: Column, b: Column) -> Column:
    """Array of one box where equal rows have columns that overlap or adjoin, or equal columns such rows; else of both."""
    side = (a["r1"] == b["r1"]) & (a["r2"] == b["r2"]) & (a["c1"] <= b["c2"] + 1) & (b["c1"] <= a["c2"] + 1)
    stack = (a["c1"] == b["c1"]) & (a["c2"] == b["c2"]) & (a["r1"] <= b["r2"] + 1) & (b["r1"] <= a["r2"] + 1)
    whole = F.struct(F.coalesce(a["sheet"], b["sheet"]).alias("sheet"), *(f(a[x], b[x]).alias(x) for x, f in (("r1", F.least), ("c1", F.least), ("r2", F.greatest), ("c2", F.greatest))))
    return F.when(_same_sheet(a, b) & (side | stack), F.array(whole.cast(BOX))).otherwise(F.array(a.cast(BOX), b.cast(BOX)))


def difference(a: Column, b: Column) -> Column:
    """Array of up to four boxes that make up a without b: above, below, left, right."""
    common = intersection(a, b)
    piece = lambda r1, c1, r2, c2: F.struct(a["sheet"].alias("sheet"), r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2")).cast(BOX)
    pieces = F.array(
        piece(a["r1"], a["c1"], common["r1"] - 1, a["c2"]), piece(common["r2"] + 1, a["c1"], a["r2"], a["c2"]),
        piece(common["r1"], a["c1"], common["r2"], common["c1"] - 1), piece(common["r1"], common["c2"] + 1, common["r2"], a["c2"]),
    )
    return F.when(common.isNull(), F.array(a.cast(BOX))).otherwise(F.filter(pieces, lambda x: (x["r1"] <= x["r2"]) & (x["c1"] <= x["c2"])))


def resolve(op: Column, a: Column, b: Column) -> Column:
    """Array of boxes by an operation's name: intersection or crossing, union, difference; another name raises."""
    name = F.lower(F.trim(op))
    both = intersection(a, b)
    return (
        F.when(name.isin("intersection", "crossing"), F.when(both.isNull(), F.array().cast(f"array<{BOX}>")).otherwise(F.array(both.cast(BOX))))
        .when(name == "union", union(a, b))
        .when(name == "difference", difference(a, b))
        .otherwise(F.raise_error(F.concat(F.lit("unknown range operation: "), op)))
    )


def extend(new: Column, old: Column, by_row: Column) -> Column:
    """A data range grown by an older one of the same band that overlaps or adjoins it; by_row: the header is a row's."""
    along = (new["r1"] == old["r1"]) & (new["r2"] == old["r2"]) & (new["c1"] <= old["c2"] + 1) & (old["c1"] <= new["c2"] + 1)
    down = (new["c1"] == old["c1"]) & (new["c2"] == old["c2"]) & (new["r1"] <= old["r2"] + 1) & (old["r1"] <= new["r2"] + 1)
    grown = F.struct(new["sheet"].alias("sheet"), *(f(new[x], old[x]).alias(x) for x, f in (("r1", F.least), ("c1", F.least), ("r2", F.greatest), ("c2", F.greatest))))
    return F.when(F.when(by_row, along).otherwise(down), grown.cast(BOX)).otherwise(new.cast(BOX))


def bounding(boxes: list[Column]) -> Column:
    """Smallest box around several; nulls are left out."""
    edge = lambda x, f: reduce(f, [b[x] for b in boxes]) if len(boxes) > 1 else boxes[0][x]
    return F.struct(F.coalesce(*(b["sheet"] for b in boxes)).alias("sheet"), edge("r1", F.least).alias("r1"), edge("c1", F.least).alias("c1"), edge("r2", F.greatest).alias("r2"), edge("c2", F.greatest).alias("c2"))
