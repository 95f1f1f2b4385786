"""Value conditions on cells, selections of positions, and masks over header groups.

A selection is a DataFrame of wb_id, sheet, axis (row or col) and pos.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.text import normal, unaccented
from gridspark.operators.reads import cell_text

#: Date forms that texts are compared by. Fixed values.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy")
SELECTION = ["wb_id", "sheet", "axis", "pos"]


def _time(text: Column) -> Column:
    tidy = F.trim(text)
    return F.coalesce(*(F.when(tidy.rlike(p), F.try_to_timestamp(tidy, F.lit(f))) for f, p in zip(DATE_FORMS, (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}$"), strict=True)))


def _as_time(value) -> datetime | None:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            return datetime.strptime(value.strip(), form)
        except (ValueError, AttributeError):
            pass
    return None


def condition(
    *, equals=None, not_equals=None, in_values=None, contains=None, startswith=None, endswith=None, regex=None, gt=None, gte=None, lt=None, lte=None, between=None,
    predicate: Callable[[], Column] | None = None, case_sensitive: bool = False, ignore_accents: bool = False, strict: bool = False, prefix: str = "",
) -> Column:
    """One Column over a cell's value columns; the given conditions must all hold.

    equals compares natively and else as normalised text (null text is empty, so not_equals keeps nulls); comparisons are by
    time, number or text, whichever the bound is, and unlike cells don't match, or raise with strict.
    """
    c = lambda name: F.col(f"{prefix}{name}")
    fold = lambda x: normal(x, case_sensitive, ignore_accents)
    text = fold(cell_text(prefix))
    literal = lambda v: fold(F.lit(str(v)))
    number = F.coalesce(c("n"), c("s").try_cast("double"))
    time = F.coalesce(c("ts"), _time(c("s")))

    def same(v) -> Column:
        native = c("n") == F.lit(float(v)) if isinstance(v, (int, float)) else c("ts") == F.lit(v) if isinstance(v, datetime) else F.lit(False)
        return F.coalesce(native, F.lit(False)) | (text == literal(v))

    def compare(v, op) -> Column:
        as_time = _as_time(v)
        if as_time is not None:
            found = op(time, F.lit(as_time))
        elif isinstance(v, (int, float)):
            found = op(number, F.lit(float(v)))
        else:
            found = op(F.when(c("s").isNotNull(), text), literal(v))
        return F.coalesce(found, F.raise_error(F.lit("values cannot be compared")).cast("boolean") if strict else F.lit(False))

    parts = []
    if equals is not None:
        parts.append(same(equals))
    if not_equals is not None:
        parts.append(~same(not_equals))
    if in_values is not None:
        parts.append(reduce(lambda x, y: x | y, [text == literal(v) for v in in_values], F.lit(False)))
    for given, test in ((contains, F.contains), (startswith, F.startswith), (endswith, F.endswith)):
        if given is not None:
            parts.append(test(text, literal(given)))
    if regex is not None:
        searched = unaccented(F.coalesce(cell_text(prefix), F.lit(""))) if ignore_accents else F.coalesce(cell_text(prefix), F.lit(""))
        parts.append(searched.rlike(regex if case_sensitive else f"(?iu){regex}"))
    for given, op in ((gt, lambda x, y: x > y), (gte, lambda x, y: x >= y), (lt, lambda x, y: x < y), (lte, lambda x, y: x <= y)):
        if given is not None:
            parts.append(compare(given, op))
    if between is not None:
        parts += [compare(between[0], lambda x, y: x >= y), compare(between[1], lambda x, y: x <= y)]
    if predicate is not None:
        parts.append(F.coalesce(predicate(), F.lit(False)))
    if not parts:
        raise ValueError("at least one condition is required")
    return reduce(lambda x, y: x & y, parts)


def filter_values(cells: DataFrame, r1: int, c1: int, r2: int, c2: int, **conditions) -> DataFrame:
    """Rows of a one-column range, or columns of a one-row range, whose cells meet the conditions."""
    if c1 != c2 and r1 != r2:
        raise ValueError("a filter takes a range of one row or one column")
    axis, pos = ("row", "row") if c1 == c2 else ("col", "col")
    inside = F.col("row").between(r1, r2) & F.col("col").between(c1, c2)
    return cells.where(inside & condition(**conditions)).select("wb_id", "sheet", F.lit(axis).alias("axis", metadata={"axis": axis}), F.col(pos).cast("bigint").alias("pos")).distinct()


def combine(op: str, *selections: DataFrame) -> DataFrame:
    """intersection, union or difference of selections, from left to right; a sheet's positions on two axes raise."""
    if not selections:
        raise ValueError("at least one selection is required")
    step = {"intersection": DataFrame.intersect, "union": lambda a, b: a.union(b).distinct(), "difference": DataFrame.subtract}[op]
    every = [s.select(SELECTION) for s in selections]
    if len(every) > 1:
        assert_one_axis(*every)
    return reduce(step, every)


def assert_one_axis(*selections: DataFrame) -> None:
    """Raises if selections mix axes within a sheet.

    filter_values() notes its axis in the column's metadata; only where a selection has no such note its rows are looked at, by
    one aggregate of which at most one row comes to the driver.
    """
    noted = {s.schema["axis"].metadata.get("axis") for s in selections}
    if None not in noted:
        if len(noted) > 1:
            raise ValueError("selections differ in axis")
        return
    sheets = reduce(DataFrame.union, [s.select("wb_id", "sheet", "axis") for s in selections])
    if not sheets.groupBy("wb_id", "sheet").agg(F.min("axis").alias("a"), F.max("axis").alias("z")).where("a <> z").isEmpty():
        raise ValueError("selections differ in axis")


def read_selection(selection: DataFrame, cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """Cells of a range at a selection's positions; positions outside of it fall away."""
    inside = cells.where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    of = lambda axis: selection.where(F.col("axis") == axis).select("wb_id", "sheet", F.col("pos").alias(axis)).distinct()
    by = [inside.join(of(axis), ["wb_id", "sheet", axis], "left_semi") for axis in ("row", "col")]
    return by[0].unionByName(by[1])


def group_mask(rows: DataFrame, leaves: list[str], test: Callable[[Column], Column], mode: str = "any", missing_matches: bool = False) -> Column:
    """One condition over all leaf columns of a header group, joined by any or all; missing_matches decides nulls."""
    lost = [x for x in leaves if x not in rows.columns]
    if lost or mode not in ("any", "all"):
        raise ValueError(f"missing columns: {lost}" if lost else "mode must be any or all")
    each = [F.when(F.col(x).isNull(), F.lit(missing_matches)).otherwise(F.coalesce(test(F.col(x)), F.lit(False))) for x in leaves]
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), each)


def missing_sheets(workbooks: DataFrame, sheets: DataFrame, requested: list[str]) -> DataFrame:
    """Requested sheets (exact names; lists separated by commas are split) that a workbook lacks; empty if a request is valid."""
    names = [name.strip() for entry in requested for name in entry.split(",") if name.strip()]
    wanted = workbooks.select("wb_id", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("sheet"))
    return wanted.join(sheets.select("wb_id", "sheet"), ["wb_id", "sheet"], "left_anti")


def with_required_headers(tables: DataFrame, headers: DataFrame, required: DataFrame) -> DataFrame:
    """Query and table pairs whose table has every header that the query requires; required: query_id, label."""
    wanted = required.select("query_id", normal(F.col("label")).alias("label")).distinct()
    have = headers.select("table_id", normal(F.col("label")).alias("label")).distinct()
    matched = wanted.join(have, "label").groupBy("query_id", "table_id").agg(F.count("*").alias("n"))
    total = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
    return matched.join(total, "query_id").where("n = needed").join(tables, "table_id", "left_semi").select("query_id", "table_id")


def authorised(sources: DataFrame, allowed: DataFrame) -> DataFrame:
    """Sources whose path, or else normalised file name, is allowed; an empty list allows all."""
    if allowed.isEmpty():
        return sources
    name = lambda x: F.lower(F.element_at(F.split(F.regexp_replace(x, r"\\", "/"), "/"), -1))
    paths, names = allowed.select("path").distinct(), allowed.select(name(F.col("path")).alias("_name")).distinct()
    by_path = sources.join(paths, "path", "left_semi")
    return by_path.unionByName(sources.join(paths, "path", "left_anti").withColumn("_name", name(F.col("path"))).join(names, "_name", "left_semi").drop("_name"))
