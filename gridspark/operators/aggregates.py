"""Spreadsheet aggregates over cells, and roll-ups of catalogues and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.text import clipped

#: Functions of SUBTOTAL by code modulo 100. Fixed values.
SUBTOTAL = {1: "average", 2: "count", 3: "counta", 4: "max", 5: "min", 9: "sum"}


def _strict(value: Column, what: str, strict: bool) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"{what} of no numbers")).cast("double")) if strict else value


def spreadsheet_aggregates(cells: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """SUM, AVERAGE, MIN, MAX, COUNT (numbers, not truth values) and COUNTA (anything) of mixed cells by keys.

    AVERAGE, MIN and MAX of no numbers are null, or raise with strict.
    """
    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("sum"), _strict(F.avg("n"), "AVERAGE", strict).alias("average"), _strict(F.min("n"), "MIN", strict).alias("min"),
        _strict(F.max("n"), "MAX", strict).alias("max"), F.count("n").alias("count"), F.count_if(F.col("kind").isNotNull()).alias("counta"),
    )


def subtotal(code: Column, aggregates: dict[str, Column] | None = None) -> Column:
    """SUBTOTAL over the columns of spreadsheet_aggregates(); unknown codes raise."""
    value = F.raise_error(F.concat(F.lit("unsupported SUBTOTAL code "), code.cast("string"))).cast("double")
    for k, name in SUBTOTAL.items():
        value = F.when(code % 100 == k, (aggregates[name] if aggregates else F.col(name)).cast("double")).otherwise(value)
    return value


def sheet_catalogue(headers: DataFrame, tables: DataFrame) -> DataFrame:
    """Of each sheet its distinct table names, descriptions and header pairs, in first-seen order."""
    h = headers.groupBy("wb_id", "sheet").agg(F.sort_array(F.collect_list(F.struct("table_id", "ord", "label", "description"))).alias("h"))
    t = tables.groupBy("wb_id", "sheet").agg(F.sort_array(F.collect_list(F.struct("table_id", "name", "description"))).alias("t"))
    pair = F.array_distinct(F.transform("h", lambda x: F.struct(x["label"], x["description"])))
    return t.join(h, ["wb_id", "sheet"], "left").select("wb_id", "sheet", F.array_distinct("t.name").alias("tables"), F.array_distinct("t.description").alias("descriptions"), pair.alias("headers"))


def table_summaries(headers: DataFrame, most: int = 20) -> DataFrame:
    """A line per table with its first labels and how many more there are."""
    g = headers.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("h"))
    n = F.size("h")
    more = F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise("")
    return g.select("table_id", F.concat(F.col("table_id"), F.lit(": "), F.array_join(F.slice(F.col("h.label"), 1, most), ", "), more).alias("summary"))


def call_rollup(calls: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Calls, capped and failed calls, time and tokens of each run; calls: duration_ms, prompt_tokens, completion_tokens, capped, success."""
    return calls.groupBy(run_col).agg(
        F.count("*").alias("calls"), F.count_if("capped").alias("capped_calls"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"),
    )


def best_attempts(attempts: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Each key's best attempts by score, later rounds first among equals, shown oldest first."""
    best = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("score"), F.desc("round")))
    shown = F.row_number().over(W.Window.partitionBy(key).orderBy("round"))
    return attempts.withColumn("place", best).where(F.col("place") <= most).withColumn("shown", shown).drop("place")


def attempts_text(attempts: DataFrame, key: str, most: int = 5, code_chars: int = 1200, observation_chars: int = 1200, keys: DataFrame | None = None) -> DataFrame:
    """key and text: its best attempts (best_attempts()) as marked-up blocks, oldest first; long codes, reasons and observations are cut.

    attempts: key, round, subtask_id, description, reasoning, code, observation, score; null texts are empty. keys, if given, lists
    keys that get a row without any attempt as well. The marks are fixed values.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.concat(
        F.lit('<attempt round="'), of("round"), F.lit('" subtask="'), of("subtask_id"), F.lit('">\n  <description>'), of("description"), F.lit("</description>\n  <reasoning>"), clipped(of("reasoning"), observation_chars),
        F.lit("</reasoning>\n  <code>\n"), clipped(of("code"), code_chars), F.lit("\n  </code>\n  <observation>\n"), clipped(of("observation"), observation_chars), F.lit("\n  </observation>\n</attempt>"),
    )
    best = best_attempts(attempts, key, most).select(key, F.struct("shown", block.alias("text")).alias("x"))
    texts = best.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("x"))["text"], "\n\n").alias("text"))
    if keys is None:
        return texts
    return keys.select(key).distinct().join(texts, key, "left").select(key, F.coalesce("text", F.lit("No previous experience.")).alias("text"))


def completeness(selected: DataFrame, results: DataFrame) -> DataFrame:
    """Every selected sheet with its result's status; missing ones are not_good."""
    return selected.join(results, ["wb_id", "sheet"], "left").select("wb_id", "sheet", F.coalesce("status", F.lit("not_good")).alias("status"))


def failures(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Results of each run and how many of them failed: any status but good, a missing one among them."""
    return results.groupBy(run_col).agg(F.count("*").alias("results"), F.count_if(F.coalesce("status", F.lit("not_good")) != "good").alias("failures"))


def work_totals(sheets: DataFrame) -> DataFrame:
    """Workbooks, sheets and sheets per workbook, in one row."""
    files, n = F.countDistinct("wb_id"), F.count("*")
    return sheets.agg(files.alias("files"), n.alias("sheets"), (n / F.greatest(files, F.lit(1))).alias("sheets_per_file"))
