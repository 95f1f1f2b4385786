"""Structure and relation documents (YAML, or JSON, which is YAML too) as headers, tables and relations; artifact folders.

A document maps table keys to tables of nested headers, and may hold relations under the reserved key `relations`.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = "doc_id bigint, table_key string, table_id string, name string, description string, sheet string, header_id string, parent_id string, path array<string>, places array<int>, ord int, label string, header_description string, orientation string, header_range string, data_range string, is_leaf boolean"
RELATIONS = "doc_id bigint, table_id string, category string, ord int, relation_id string, expression string, description string, range string, pattern string, agg_function string, cell string, raw string, errors string"
#: Groups of relations in their order. Fixed values.
CATEGORIES = ("normal_formulas", "aggregate_formulas", "cell_formulas", "invalid_formulas")
RESERVED = "relations"


def load(text: str):
    """A document's value; None where it cannot be read."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("documents that aren't JSON need the yaml package") from error
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def _text(value):
    return None if value is None else str(value)


def _range(value):
    text = "" if value is None else str(value).strip()
    return None if text.lower() in ("", "null", "none") else text


def header_rows(value) -> list[tuple]:
    """Rows of HEADERS without doc_id: each table's headers in pre-order; a table without headers is one row without a header."""
    out = []
    for key, table in value.items() if isinstance(value, dict) else ():
        if key == RESERVED or not isinstance(table, dict):
            continue
        name = table.get("name", key)
        own = (str(key), str(table.get("id") or key), _text(name), str(table.get("description") or ""), _text(table.get("sheet") or name))
        start = len(out)

        def walk(headers, path, places, own=own, start=start):
            for i, h in enumerate(headers if isinstance(headers, list) else ()):
                if isinstance(h, dict):
                    here, at = [*path, str(h.get("id"))], [*places, i]
                    below = h.get("sub_headers") or []
                    out.append((*own, here[-1], path[-1] if path else None, here, at, len(out) - start, _text(h.get("label")), _text(h.get("description")), _text(h.get("orientation")), _range(h.get("header_range")), _range(h.get("data_range")), not below))
                    walk(below, here, at)

        walk(table.get("headers"), [], [])
        if len(out) == start:
            out.append((*own, None, None, None, None, None, None, None, None, None, None, None))
    return out


def relation_rows(value) -> list[tuple]:
    """Rows of RELATIONS without doc_id: under `relations` or at the root, of one table or by table."""
    root = value.get(RESERVED, value) if isinstance(value, dict) else None
    if not isinstance(root, dict):
        return []
    groups = [(None, root)] if any(c in root for c in CATEGORIES) else [(str(k), v) for k, v in root.items() if isinstance(v, dict) and any(c in v for c in CATEGORIES)]
    out = []
    for table_id, group in groups:
        for category in CATEGORIES:
            for r in group.get(category) if isinstance(group.get(category), list) else ():
                if isinstance(r, dict):
                    formula = next((r[k] for k in ("formula", "formula_example") if r.get(k)), None)
                    cell, raw = (formula.get("cell"), formula.get("raw")) if isinstance(formula, dict) else (None, formula)
                    own = r.get("table_id", table_id)
                    out.append((_text(own), category, len(out), _text(r.get("id")), *(_text(r.get(k)) for k in ("expression", "description", "range", "pattern", "agg_function")), _text(cell), _text(raw), json.dumps(r["errors"], ensure_ascii=False) if r.get("errors") else None))
    return out


def _parsed(docs: DataFrame, parse, ddl: str, id_col: str, text_col: str) -> DataFrame:
    columns = [part.strip().split(" ")[0] for part in ddl.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(i, *row) for i, text in zip(frame["doc_id"], frame["text"], strict=True) if text for row in parse(load(text))]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, ddl)


def structure_headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Headers of every structure document, flattened in pre-order; documents that cannot be read, and null ones, give nothing."""
    return _parsed(docs, header_rows, HEADERS, id_col, text_col)


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Relations of every structure or relation document, in their order; the table is the record's own, else its group's."""
    return _parsed(docs, relation_rows, RELATIONS, id_col, text_col)


def artifact_folders(files: DataFrame) -> DataFrame:
    """folder: those that hold both structure.yaml and metadata.json, at whatever depth; files: path."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    wanted = files.select(folder.alias("folder"), name.alias("name")).where(F.col("name").isin("structure.yaml", "metadata.json"))
    return wanted.groupBy("folder").agg(F.countDistinct("name").alias("n")).where("n = 2").select("folder")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """folder, structure_text, metadata_text of every artifact folder under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.regexp_extract("path", r"([^/]*)$", 1).isin("structure.yaml", "metadata.json"))
    one = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    both = one.groupBy("folder").agg(F.max(F.when(F.col("name") == "structure.yaml", F.col("text"))).alias("structure_text"), F.max(F.when(F.col("name") == "metadata.json", F.col("text"))).alias("metadata_text"))
    return both.where("structure_text is not null and metadata_text is not null")
