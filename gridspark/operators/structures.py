"""Checks of table descriptions against cells, as findings, and merging, nulling and filling in of descriptions.

headers: wb_id, sheet, table_id, header_id, parent_id, path (array of ids), ord, label, orientation, hr and dr (boxes or null).
findings: wb_id, sheet, table_id, header_id, rule, severity (error or action), detail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.addressing import BOX, LAST_COLUMN, LAST_ROW, box_a1, contains_box, extend, intersects
from gridspark.functions.lineage import cut
from gridspark.functions.text import squeezed, tidy
from gridspark.operators.reads import bands, cell_text, expand_merges

KEY = ["wb_id", "sheet", "table_id", "header_id"]
#: Labels that stand for no real header, and words for ranges that are not known. Fixed values.
PLACEHOLDERS = (
    r"column\s*\d+", r"col\s*\d+", r"placeholder\s*\d*", r"untitled\s*\d*", r"header\s*\d*", r"field\s*\d*", r"attr(?:ibute)?\s*\d*",
    r"var(?:iable)?\s*\d*", r"val(?:ue)?\s*\d*", r"empty", r"none", r"null", r"n/a", r"-",
)
UNCERTAIN = ("unknown", "uncertain", "n/a", "none", "null", "?")
#: Words of a description that say that it was not made. Fixed values.
FAILED = ("connection error", "rate limit", "quota exceeded", "unauthorized", "api key", "authentication", "timeout", "endpoint offline")


#: Rules whose detail is a box; it is written out once, for all findings together.
BOXED = {
    "hr_bounds", "dr_bounds", "hr_unused", "dr_unused", "header_merged", "header_moved", "header_blank", "data_shifted", "data_overlaps", "data_realigned", "data_blank", "data_repaired",
    "parent_data_over_child", "child_data_outside", "child_header_outside",
}


def placeholder(label: Column) -> Column:
    """Whether a label stands for no real header: blank, or one of PLACEHOLDERS as a whole."""
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).rlike("^(" + "|".join(("", *PLACEHOLDERS)) + ")$")


def certain(a1: Column) -> Column:
    """A range's text, null where it is blank or says that it is not known."""
    text = F.trim(a1)
    return F.when((text != "") & ~F.lower(text).isin(*UNCERTAIN), text)


def _findings(df: DataFrame, *rules: tuple[Column, str, str, Column]) -> DataFrame:
    """Rows of the rules (condition, name, severity, detail) that hold, in one pass; a detail is a text, or a box if its rule is in BOXED."""
    none = lambda kind: F.lit(None).cast(kind)
    each = []
    for where, rule, severity, detail in rules:
        text, box = (none("string"), detail.cast(BOX)) if rule in BOXED else (detail.cast("string"), none(BOX))
        each.append(F.when(where, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text.alias("text"), box.alias("box"))))
    return df.select(*KEY, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select(*KEY, "x.*")


def _box(sheet: Column, r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.struct(sheet.alias("sheet"), *(x.cast("bigint").alias(n) for n, x in (("r1", r1), ("c1", c1), ("r2", r2), ("c2", c2)))).cast(BOX)


def repaired_data(header: Column, data: Column, by_row: Column, used: Column | None = None) -> Column:
    """A data box moved behind its header, below it or for rows to its right, on the header's band; without a data box it reaches to the used range's end."""
    end = lambda side: F.coalesce(data[side], used[side]) if used is not None else data[side]
    down = _box(header["sheet"], header["r2"] + 1, header["c1"], end("r2"), header["c2"])
    right = _box(header["sheet"], header["r1"], header["c2"] + 1, header["r2"], end("c2"))
    return F.when(by_row, right).otherwise(down)


def _same_box(a: Column, b: Column) -> Column:
    return (a["r1"] == b["r1"]) & (a["c1"] == b["c1"]) & (a["r2"] == b["r2"]) & (a["c2"] == b["c2"])


def _banded(df: DataFrame, which: str) -> DataFrame:
    return bands(df.withColumns({"_r1": F.col(f"{which}.r1"), "_r2": F.col(f"{which}.r2")}), "_r1", "_r2").drop("_r1", "_r2")


def _texts(headers: DataFrame, cells: DataFrame, which: str) -> DataFrame:
    """Distinct visible texts in each header's box, in row-major order; boxes and cells meet by bands of rows."""
    boxes = headers.where(F.col(which).isNotNull()).select(*KEY, which)
    inside = F.col("row").between(F.col(f"{which}.r1"), F.col(f"{which}.r2")) & F.col("col").between(F.col(f"{which}.c1"), F.col(f"{which}.c2"))
    text = tidy(cell_text())
    seen = _banded(boxes, which).join(bands(cells, "row", "row"), ["wb_id", "sheet", "band"]).where(inside & (text != ""))
    first = seen.groupBy(*KEY, text.alias("t")).agg(F.min(F.struct("row", "col")).alias("at"))  # each text once, combined before it travels
    joined = first.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("x"))
    return boxes.select(*KEY).join(joined, KEY, "left").select(*KEY, F.coalesce(F.col("x.t"), F.array().cast("array<string>")).alias("texts"))


def _filled(headers: DataFrame, cells: DataFrame, which: str) -> DataFrame:
    """Keys of headers whose box holds a visible cell; one flag for each, however many cells."""
    boxes = headers.where(F.col(which).isNotNull()).select(*KEY, which)
    inside = F.col("row").between(F.col(f"{which}.r1"), F.col(f"{which}.r2")) & F.col("col").between(F.col(f"{which}.c1"), F.col(f"{which}.c2"))
    shown = bands(cells.where(F.trim(cell_text()) != ""), "row", "row")
    return _banded(boxes, which).join(shown, ["wb_id", "sheet", "band"]).where(inside).select(*KEY).distinct()


def _merged_at(df: DataFrame, keys: list[str], merges: DataFrame, which: str, name: str) -> DataFrame:
    """df with the first merge, by place, that touches its box."""
    m = merges.select("wb_id", "sheet", _box(F.lit(None).cast("string"), *(F.col(x) for x in ("r1", "c1", "r2", "c2"))).alias(name))
    pairs = _banded(df.where(F.col(which).isNotNull()).select(*keys, which), which).join(_banded(m, name), ["wb_id", "sheet", "band"]).where(intersects(F.col(which), F.col(name)))
    return df.join(pairs.groupBy(*keys).agg(F.min_by(name, F.struct(f"{name}.r1", f"{name}.c1")).alias(name)), keys, "left")


def _moved_headers(h: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Of headers that begin on a blank cell of a merge whose text isn't theirs: KEY and the next text to its right, as a box (null: none)."""
    blank = h.where(F.col("m").isNotNull() & ~_same_box(F.col("hr"), F.col("m")) & (F.trim(F.coalesce("label", F.lit(""))) != ""))
    shown = cells.where(F.trim(cell_text()) != "").select("wb_id", "sheet", "row", "col", tidy(cell_text()).alias("t"))
    at = lambda r, c, name: shown.select("wb_id", "sheet", F.col("row").alias(r), F.col("col").cast("bigint").alias(c), F.col("t").alias(name))
    places = blank.select(*KEY, "label", "hr", "m", "used", F.col("hr.r1").alias("a"), F.col("hr.c1").alias("b"), F.col("m.r1").alias("p"), F.col("m.c1").alias("q"))
    alone = places.join(at("a", "b", "own"), ["wb_id", "sheet", "a", "b"], "left_anti").join(at("p", "q", "anchor"), ["wb_id", "sheet", "p", "q"])
    other = alone.where(~F.contains(squeezed(F.col("anchor")), squeezed(F.col("label"))))
    right = other.join(shown.select("wb_id", "sheet", F.col("row").alias("a"), "col"), ["wb_id", "sheet", "a"], "left")
    nearest = right.groupBy(*KEY, "a").agg(F.min(F.when((F.col("col") > F.col("m.c2")) & (F.col("col") <= F.col("used.c2")), F.col("col"))).alias("to"))
    box = F.when(F.col("to").isNotNull(), _box(F.lit(None).cast("string"), F.col("a"), F.col("to"), F.col("a"), F.col("to")))
    found = _merged_at(nearest.withColumn("next", box), KEY, merges, "next", "n_m")
    return found.select(*KEY, F.coalesce("n_m", "next").alias("next"), F.lit(True).alias("follower"))


def verify(headers: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Findings of all rules: header boxes, then data boxes against them, then parents and children.

    Cells, boxes and merges of a sheet meet by bands of rows. Blank cells of a merge show what its first cell shows.
    """
    direct, cells = cells, expand_merges(cells, merges, overwrite=False)
    used = cells.groupBy("wb_id", "sheet").agg(_box(F.lit(None).cast("string"), F.lit(1), F.lit(1), F.max("row"), F.max("col")).alias("used"))
    by_row = F.lower(F.coalesce("orientation", F.lit("column"))) == "row"
    # header boxes grow to the first merge that they touch, or move on from a blank cell of a merge that says something else
    h = headers.join(used, ["wb_id", "sheet"], "left")
    h = _merged_at(h, KEY, merges, "hr", "m")
    h = cut(h.join(_moved_headers(h, direct, merges), KEY, "left"))
    moves = F.col("follower").isNotNull() & F.col("next").isNotNull()
    grows = F.col("m").isNotNull() & ~_same_box(F.col("hr"), F.col("m")) & F.col("follower").isNull()
    beyond = lambda b: (b["r1"] < 1) | (b["c1"] < 1) | (b["r2"] > LAST_ROW) | (b["c2"] > LAST_COLUMN)
    first = [
        (~F.lower(F.coalesce("orientation", F.lit("column"))).isin("row", "column"), "orientation", "error", F.col("orientation")), (beyond(F.col("hr")), "hr_bounds", "error", F.col("hr")), (beyond(F.col("dr")), "dr_bounds", "error", F.col("dr")),
        (~contains_box(F.col("used"), F.col("dr")), "dr_unused", "error", F.col("dr")), (grows, "header_merged", "action", F.col("m")), (moves, "header_moved", "action", F.col("next")),
    ]
    out = [_findings(h, *first)]
    new_hr = F.when(moves, F.col("next").cast(BOX)).when(F.col("m").isNotNull(), F.col("m").cast(BOX)).otherwise(F.col("hr").cast(BOX))
    h = h.withColumn("hr", new_hr).drop("m", "next", "follower")
    # data boxes leave the header and take its band
    both = F.col("hr").isNotNull() & F.col("dr").isNotNull()
    overlaps = both & intersects(F.col("hr"), F.col("dr"))
    h = h.withColumn("fixed", repaired_data(F.col("hr"), F.col("dr"), by_row, F.col("used"))).withColumn("fits", contains_box(F.col("used"), F.col("fixed")))
    h = h.withColumns({"shift": overlaps & F.col("fits"), "lost": overlaps & ~F.col("fits"), "old": F.col("dr").cast(BOX)}).withColumn("dr", F.when(F.col("shift"), F.col("fixed")).otherwise(F.col("dr").cast(BOX)))
    d, r = F.col("dr"), F.col("hr")
    off_band = both & F.when(by_row, (d["r1"] != r["r1"]) | (d["r2"] != r["r2"])).otherwise((d["c1"] != r["c1"]) | (d["c2"] != r["c2"]))
    along = _box(d["sheet"], F.when(by_row, r["r1"]).otherwise(d["r1"]), F.when(by_row, d["c1"]).otherwise(r["c1"]), F.when(by_row, r["r2"]).otherwise(d["r2"]), F.when(by_row, d["c2"]).otherwise(r["c2"]))
    h = h.withColumns({"off": off_band, "along": along})
    h = h.withColumn("dr", F.when(F.col("off"), F.col("along")).otherwise(F.col("dr"))).withColumn("again", F.when(F.col("hr").isNotNull(), repaired_data(F.col("hr"), F.lit(None).cast(BOX), by_row, F.col("used"))))
    h = cut(h.join(_texts(h, cells, "hr"), KEY, "left"))
    shown = tidy(F.array_join("texts", " "))
    other_label = (F.size("texts") > 0) & ((squeezed(shown) != squeezed(F.col("label"))) | (tidy(F.col("label")) != F.coalesce("label", F.lit(""))))
    second = [
        (~contains_box(F.col("used"), F.col("hr")), "hr_unused", "error", F.col("hr")), (F.size("texts") == 0, "header_blank", "error", F.col("hr")), (F.size("texts") > 1, "header_texts", "error", F.array_join("texts", " | ")), (other_label, "label_repaired", "action", shown),
        (F.col("shift"), "data_shifted", "action", F.col("fixed")), (F.col("lost"), "data_overlaps", "error", F.col("old")), (F.col("off"), "data_realigned", "action", F.col("along")),
    ]
    out.append(_findings(h, *second))
    # data boxes without a visible cell are repaired from the header's span, if that has one
    filled = lambda which, name: _filled(h, cells, which).withColumn(name, F.lit(True))
    h = h.join(filled("dr", "has"), KEY, "left").join(filled("again", "could"), KEY, "left")
    bare = F.col("dr").isNotNull() & F.col("has").isNull()
    saved = bare & F.col("could").isNotNull() & contains_box(F.col("used"), F.col("again"))
    h = h.withColumns({"bare": bare, "saved": F.coalesce(saved, F.lit(False))}).drop("texts", "shift", "lost", "old", "off", "along", "fixed", "fits", "has", "could")
    h = cut(h)
    out.append(_findings(h, (F.col("bare") & ~F.col("saved"), "data_blank", "error", F.col("dr")), (F.col("saved"), "data_repaired", "action", F.col("again"))))
    h = h.withColumn("dr", F.when(F.col("saved"), F.col("again")).otherwise(F.col("dr"))).drop("bare", "saved", "again")
    # parents and children
    parent = h.select("wb_id", "sheet", "table_id", F.col("header_id").alias("parent_id"), F.col("hr").alias("p_hr"), F.col("dr").alias("p_dr"), by_row.alias("p_row"))
    c = h.join(parent, ["wb_id", "sheet", "table_id", "parent_id"])
    x, p = F.col("hr"), F.col("p_hr")
    outside = F.when(F.col("p_row"), (x["r1"] < p["r1"]) | (x["r2"] > p["r2"]) | (x["c1"] <= p["c2"])).otherwise((x["c1"] < p["c1"]) | (x["c2"] > p["c2"]) | (x["r1"] <= p["r2"]))
    out.append(
        _findings(
            c, (F.col("dr").isNull(), "child_data_missing", "error", F.col("header_id")), (intersects(F.col("p_dr"), F.col("hr")), "parent_data_over_child", "action", F.col("p_dr")),
            (~contains_box(F.col("p_dr"), F.col("dr")), "child_data_outside", "error", F.col("dr")), (outside, "child_header_outside", "error", x),
        )
    )
    out.append(_uncovered(h, cells))
    return reduce(DataFrame.unionByName, out).select(*KEY, "rule", "severity", F.coalesce("text", box_a1(F.col("box"))).alias("detail"))


def _uncovered(h: DataFrame, cells: DataFrame) -> DataFrame:
    """Visible cells in the band of a parent's descendants that no descendant's header covers; the first eight by cell."""
    child = h.where(F.size("path") > 1).select("wb_id", "sheet", "table_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("header_id"), F.col("hr").alias("d_hr")).where("d_hr is not null")
    edges = child.groupBy(*KEY).agg(*(f(f"d_hr.{x}").alias(x) for x, f in (("r1", F.min), ("c1", F.min), ("r2", F.max), ("c2", F.max))))
    by_row = F.lower(F.coalesce("orientation", F.lit("column"))) == "row"
    p = h.where("hr is not null").join(edges, KEY)
    low = F.least(F.col("r2"), F.coalesce(F.col("dr.r1") - 1, F.col("r2")))
    right = F.least(F.col("c2"), F.coalesce(F.col("dr.c1") - 1, F.col("c2")))
    band = F.when(by_row, _box(F.lit(None).cast("string"), F.col("hr.r1"), F.col("c1"), F.col("hr.r2"), right)).otherwise(_box(F.lit(None).cast("string"), F.col("r1"), F.col("hr.c1"), low, F.col("hr.c2")))
    parents = p.select(*KEY, band.alias("box")).where("box.r1 <= box.r2 and box.c1 <= box.c2")
    text = tidy(cell_text())
    inside = F.col("row").between(F.col("box.r1"), F.col("box.r2")) & F.col("col").between(F.col("box.c1"), F.col("box.c2"))
    shown = _banded(parents, "box").join(bands(cells, "row", "row"), ["wb_id", "sheet", "band"]).where(inside & (text != "")).select(*KEY, "row", "col", text.alias("t"))
    under = F.col("row").between(F.col("d_hr.r1"), F.col("d_hr.r2")) & F.col("col").between(F.col("d_hr.c1"), F.col("d_hr.c2"))
    covered = shown.join(child, KEY).where(under).select(*KEY, "row", "col").distinct()
    gaps = shown.join(covered, [*KEY, "row", "col"], "left_anti").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row", "col", "t"))).alias("x"))
    return _findings(gaps, (F.lit(True), "children_uncovered", "error", F.array_join(F.slice(F.col("x.t"), 1, 8), ", ")))


def status(sheets: DataFrame, findings: DataFrame) -> DataFrame:
    """good for sheets without an error, else not_good, with the numbers of errors and actions."""
    n = findings.groupBy("wb_id", "sheet").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "action").alias("actions"))
    got = sheets.join(n, ["wb_id", "sheet"], "left").select("wb_id", "sheet", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("errors", "actions")))
    return got.withColumn("status", F.when(F.col("errors") > 0, "not_good").otherwise("good"))


def null_fields(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """Headers with the listed range fields (keys, field hr or dr) set to null."""
    listed = fields.groupBy(*KEY).agg(F.bool_or(F.col("field") == "hr").alias("n_hr"), F.bool_or(F.col("field") == "dr").alias("n_dr"))
    joined = headers.join(listed, KEY, "left")
    return joined.select(*(F.when(~F.coalesce(f"n_{c}", F.lit(False)), F.col(c)).alias(c) if c in ("hr", "dr") else F.col(c) for c in headers.columns))


def normalised(headers: DataFrame) -> DataFrame:
    """headers with texts trimmed: an id made of the label where it is blank, column as the orientation where it is neither row nor column, and ranges null where they are not known.

    headers: header_id, label, orientation, header_range and data_range as A1 texts.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    made = F.regexp_replace(F.regexp_replace(F.lower(text("label")), r"[^\p{L}\p{N}]+", "_"), r"^_|_$", "")
    by = F.lower(text("orientation"))
    changed = {"header_id": F.coalesce(F.nullif(text("header_id"), F.lit("")), F.nullif(made, F.lit("")), F.lit("header")), "label": text("label"), "orientation": F.when(by.isin("row", "column"), by).otherwise("column")}
    return headers.withColumns(changed | {c: certain(F.col(c)) for c in ("header_range", "data_range")})


def valid_structures(headers: DataFrame) -> DataFrame:
    """Sheets' structures with whether every table of them has a real header."""
    real = headers.groupBy("wb_id", "sheet", "table_id").agg(F.bool_or(~placeholder(F.col("label"))).alias("real"))
    return real.groupBy("wb_id", "sheet").agg(F.bool_and("real").alias("valid"), F.count("*").alias("tables"))


def merge_versions(new: DataFrame, old: DataFrame) -> DataFrame:
    """New headers whose data ranges are grown by those of the same path, label and header range in an older version."""
    key = lambda p: [F.col("wb_id").alias(f"{p}wb"), F.col("sheet").alias(f"{p}sheet"), F.col("table_id").alias(f"{p}table"), F.array_join("path", "/").alias(f"{p}path"), F.lower(F.col("label")).alias(f"{p}label"), box_a1(F.col("hr")).alias(f"{p}hr")]
    o = old.select(*key("o_"), F.col("dr").cast(BOX).alias("o_dr"))
    n = new.select("*", *key("n_"))
    on = reduce(lambda x, y: x & y, [n[f"n_{k}"].eqNullSafe(o[f"o_{k}"]) for k in ("wb", "sheet", "table", "path", "label", "hr")])
    grown = F.when(F.col("o_dr").isNotNull() & F.col("dr").isNotNull(), extend(F.col("dr"), F.col("o_dr"), F.lower(F.col("orientation")) == "row")).otherwise(F.col("dr").cast(BOX))
    return n.join(o, on, "left").select(*(grown.alias("dr") if c == "dr" else F.col(c) for c in new.columns))


def fallback_structures(sheets: DataFrame, tables: DataFrame) -> DataFrame:
    """One table without headers over the used range of each sheet that has none; sheets: wb_id, sheet, used (box)."""
    bare = sheets.join(tables.select("wb_id", "sheet").distinct(), ["wb_id", "sheet"], "left_anti")
    return bare.select("wb_id", "sheet", F.lit("table1").alias("table_id"), F.col("sheet").alias("name"), F.col("used").alias("bounds"))


def covered(targets: DataFrame, ranges: DataFrame) -> DataFrame:
    """target_id and whether the union of its ranges covers the target's box; ranges have target_id and a box.

    Rows change only where a range begins or ends: one row of each such stretch is looked at, so that tall boxes cost no more.
    """
    t = targets.select("target_id", F.col("r1").alias("t1"), F.col("r2").alias("t2"), "c1", "c2")
    spans = ranges.select("target_id", F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("c1").alias("a"), F.col("c2").alias("z"))
    starts = spans.select("target_id", F.explode(F.array(F.col("s1").cast("bigint"), (F.col("s2") + 1).cast("bigint"))).alias("row"))
    rows = t.join(starts, "target_id").where("row > t1 and row <= t2").select("target_id", "row").unionByName(t.select("target_id", F.col("t1").cast("bigint").alias("row"))).distinct()
    here = (F.col("s1") <= F.col("row")) & (F.col("s2") >= F.col("row")) & (F.col("a") <= F.col("c2")) & (F.col("z") >= F.col("c1"))
    per_row = rows.join(t, "target_id").join(spans, "target_id", "left").groupBy("target_id", "row", "c1", "c2").agg(F.sort_array(F.collect_list(F.when(here, F.struct("a", "z")))).alias("spans"))
    reach = F.aggregate("spans", F.col("c1") - 1, lambda end, x: F.when(x["a"] <= end + 1, F.greatest(end, x["z"])).otherwise(end))
    return targets.select("target_id").join(per_row.groupBy("target_id").agg(F.bool_and(reach >= F.col("c2")).alias("covered")), "target_id", "left").select("target_id", F.coalesce("covered", F.lit(False)).alias("covered"))
