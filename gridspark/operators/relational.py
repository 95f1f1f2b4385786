"""Joins, unions and group-bys with spreadsheet users' rules: null keys match, all-null sums are nought, names are spelled out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.lineage import cut

#: Rows of a group from which its median is found in rounds; pieces that a round cuts a group's values into.
MEDIAN_ROWS, PIECES = 10_000_000, 64
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "left_anti": "left_anti", "left_semi": "left_semi", "cross": "cross"}


def infer_keys(left: list[str], right: list[str]) -> list[str]:
    """The one shared column named id or *_id, else the one shared column; anything else raises."""
    shared = [c for c in left if c in right]
    ids = [c for c in shared if c == "id" or c.endswith("_id")]
    if len(ids) == 1:
        return ids
    if len(shared) == 1:
        return shared
    raise ValueError("no shared column to join on" if not shared else f"ambiguous join columns: {shared}")


def _assert_unique(df: DataFrame, keys: list[str], side: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"join keys are not unique on the {side} side")


def join_tables(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, how: str = "inner", suffixes: tuple[str, str] = ("_left", "_right"), validate: str | None = None) -> DataFrame:
    """Equi join. Null keys match each other; other columns of both sides get suffixes; validate is 1:1, 1:m, m:1 or m:m."""
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    if how == "cross":  # every row with every row, if that is what a user asks for
        if not (on is None and left_on is None and right_on is None):
            raise ValueError("a cross join takes no keys")
        named = lambda df, i: df.select(*(F.col(f"`{c}`").alias(c + suffixes[i] if c in left.columns and c in right.columns else c) for c in df.columns))
        return named(left, 0).crossJoin(named(right, 1))
    if (left_on is None) != (right_on is None):
        raise ValueError("left_on and right_on go together")
    if how not in HOW and how != "right_anti":
        raise ValueError(f"unknown join: {how}")
    lk, rk = (listed(left_on), listed(right_on)) if left_on is not None else (listed(on),) * 2 if on is not None else (infer_keys(left.columns, right.columns),) * 2
    if how == "right_anti":
        return join_tables(right, left, left_on=rk, right_on=lk, how="left_anti", validate=validate and validate[::-1])
    if validate in ("1:1", "1:m"):
        _assert_unique(left, lk, "left")
    if validate in ("1:1", "m:1"):
        _assert_unique(right, rk, "right")
    same = lk == rk
    both = [c for c in left.columns if c in right.columns and not (same and c in lk)]
    a = left.select(*(F.col(f"`{c}`").alias(f"l:{c}") for c in left.columns))
    b = right.select(*(F.col(f"`{c}`").alias(f"r:{c}") for c in right.columns))
    on_keys = reduce(lambda x, y: x & y, [a[f"l:{x}"].eqNullSafe(b[f"r:{y}"]) for x, y in zip(lk, rk, strict=True)])
    joined = a.join(b, on_keys, HOW[how])
    if how in ("left_anti", "left_semi"):
        return joined.select(*(F.col(f"`l:{c}`").alias(c) for c in left.columns))
    out = []
    for c in left.columns:
        column = F.col(f"`l:{c}`")
        if same and c in lk:
            column = F.coalesce(column, F.col(f"`r:{c}`"))
        out.append(column.alias(c + suffixes[0] if c in both else c))
    out += [F.col(f"`r:{c}`").alias(c + suffixes[1] if c in both else c) for c in right.columns if not (same and c in rk)]
    return joined.select(*out)


def union_tables(tables: list[DataFrame], strict_schema: bool = True, source_column: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """All rows of tables with the same set of columns, in the first one's order; source_column tells which table a row is from."""
    if not tables:
        raise ValueError("no tables to unite")
    first = tables[0].columns
    for i, t in enumerate(tables[1:], 2):
        if strict_schema and set(t.columns) != set(first):
            raise ValueError(f"table {i} has an incompatible schema; missing {sorted(set(first) - set(t.columns))}, extra {sorted(set(t.columns) - set(first))}")
    if source_column is not None:
        if any(source_column in t.columns for t in tables):
            raise ValueError(f"{source_column} is a column already")
        names = labels or [f"table_{i}" for i in range(1, len(tables) + 1)]
        tables = [t.withColumn(source_column, F.lit(name)) for t, name in zip(tables, names, strict=True)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=not strict_schema), tables)


def aggregate(column: str, how: str, order: Column | None = None) -> Column:
    """One aggregate by name, with the null rules of a data frame library: sums of nothing are 0, first and last skip nulls."""
    c = F.col(column)
    placed = order if order is not None else F.monotonically_increasing_id()
    known = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "mean": lambda: F.avg(c), "count": lambda: F.count(c), "size": lambda: F.count(F.lit(1)),
        "nunique": lambda: F.countDistinct(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "median": lambda: F.median(c),
        "std": lambda: F.stddev_samp(c), "var": lambda: F.var_samp(c), "prod": lambda: F.coalesce(F.product(c), F.lit(1.0)),
        "first": lambda: F.min_by(c, F.when(c.isNotNull(), placed)), "last": lambda: F.max_by(c, F.when(c.isNotNull(), placed)),
        "any": lambda: F.coalesce(F.bool_or(c), F.lit(False)), "all": lambda: F.coalesce(F.bool_and(c), F.lit(True)),
    }
    if how not in known:
        raise ValueError(f"unknown aggregate: {how}")
    return known[how]()


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, joined by keys; null keys match."""
    r = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(r, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)), how).drop(*(f"_k_{k}" for k in keys))


def exact_medians(df: DataFrame, keys: list[str], column: str, most_rows: int = MEDIAN_ROWS) -> DataFrame:
    """keys and the column's exact median of each group; blank without values.

    Groups of more than most_rows values aren't gathered: quantiles of a sketch cut a group's values into pieces, pieces are
    counted, and the next round looks at the piece that holds the middle. A round sees a small part of the rows of the one before;
    values that are quantiles themselves are pieces of their own, so that a value of many rows ends the search.
    """
    rows = df.select(*keys, F.col(column).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = sizes.where(F.col("_n") > most_rows)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.median("_v").alias(column))
    opened = cut(large.withColumn("_below", F.lit(0).cast("bigint")))
    found = [_beside(rows, opened.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.median("_v").alias(column))]
    hot = _beside(rows.where("_v is not null"), opened.select(*keys), keys, "left_semi")
    shares = F.array(*(F.lit(i / PIECES) for i in range(1, PIECES)))
    while not opened.isEmpty():
        inside = _beside(hot, opened.select(*keys, "_lo", "_hi"), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_v")
        edges = cut(inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, 20 * PIECES)).alias("_edges")))
        piece = 2 * F.size(F.filter("_edges", lambda e: e < F.col("_v"))) + F.array_contains("_edges", F.col("_v")).cast("int")
        counted = _beside(inside, edges, keys).groupBy(*keys, piece.alias("_piece")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        along = W.Window.partitionBy(*keys).orderBy("_piece").rowsBetween(W.Window.unboundedPreceding, 0)
        counted = _beside(counted.withColumn("_upto", F.sum("_c").over(along)), opened.select(*keys, "_n", "_below"), keys)
        start, end = F.col("_below") + F.col("_upto") - F.col("_c"), F.col("_below") + F.col("_upto")
        holds = lambda k: (start <= k) & (k < end)
        low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        middle = counted.groupBy(*keys).agg(
            F.first("_n").alias("_n"), *(F.max(F.when(holds(low), c)).alias(name) for c, name in ((F.col("_piece"), "_p"), (F.col("_min"), "_lo"), (F.col("_max"), "_hi"), (start, "_below"))),
            *(F.max(F.when(holds(high), c)).alias(name) for c, name in ((F.col("_piece"), "_q"), (F.col("_min"), "_above"))),
        )
        middle = cut(middle)
        # the middle lies between two pieces, or in one of equal values
        settled = (F.col("_p") != F.col("_q")) | (F.col("_lo") == F.col("_hi"))
        found.append(middle.where(settled).select(*keys, F.when(F.col("_p") != F.col("_q"), (F.col("_hi") + F.col("_above")) / 2).otherwise(F.col("_lo")).alias(column)))
        opened = middle.where(~settled).select(*keys, "_n", "_lo", "_hi", "_below")
    return reduce(DataFrame.unionByName, found)


def groupby_table(df: DataFrame, by, aggregations: dict, dropna: bool = False, sort: bool = True, order: Column | None = None, most_median_rows: int = MEDIAN_ROWS) -> DataFrame:
    """Group-by with a column -> aggregate map, or column -> list of aggregates, whose results are named column_aggregate.

    Medians of groups of more than most_median_rows rows come from exact_medians().
    """
    keys = [by] if isinstance(by, str) else list(by)
    rows = df.na.drop(subset=keys) if dropna else df
    named = [(c, h, c if isinstance(how, str) else f"{c}_{h}") for c, how in aggregations.items() for h in ([how] if isinstance(how, str) else how)]
    apart = [(c, name) for c, h, name in named if h == "median"]
    if apart and rows.groupBy(*keys).count().where(F.col("count") > most_median_rows).isEmpty():
        apart = []
    names = {name for _, name in apart}
    grouped = rows.groupBy(*keys).agg(*(aggregate(c, h, order).alias(name) for c, h, name in named if name not in names), *([F.count(F.lit(1)).alias("_rows")] if len(names) == len(named) else []))
    for c, name in apart:
        grouped = _beside(grouped, exact_medians(rows, keys, c, most_median_rows).withColumnRenamed(c, name), keys, "left")
    grouped = grouped.select(*keys, *(name for _, _, name in named))
    return grouped.orderBy(*keys) if sort else grouped
