"""Results of a run in one folder: several tables that become visible together, or not at all.

Tables are written aside, under a name of the run's own; then a manifest that lists them is renamed into place. Readers follow manifests
only, so that a run that failed, or whose driver was lost, leaves nothing that anyone reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.sources.documents import CATEGORIES, RESERVED

#: Formats of a run's tables.
FORMATS = ("parquet", "json")


def _files(spark: SparkSession, path: str):
    """The file system of a path, by Hadoop, and the class of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def relation_documents(relations: DataFrame, id_col: str = "wb_id") -> DataFrame:
    """id_col and text: a document of each workbook's relations, by table and category, as documents.relations() reads them.

    relations: id_col, table_id, category, ord, relation_id, expression, description, range, pattern, agg_function, cell, raw, errors
    (JSON or null). Nulls aren't written. A workbook's relations are one document, as the format has it; ord orders them. Rows with a null
    table_id or a category that isn't known are an error, as no document can hold them.
    """
    known = F.col("table_id").isNotNull() & F.col("category").isin(*CATEGORIES)
    checked = relations.withColumn("category", F.when(known, F.col("category")).otherwise(F.raise_error(F.lit("relations need a table_id and a known category"))))
    formula = F.when(F.col("raw").isNotNull() | F.col("cell").isNotNull(), F.struct("cell", "raw"))
    one = F.struct("ord", F.struct(F.col("relation_id").alias("id"), "table_id", "expression", "description", "range", "pattern", "agg_function", formula.alias("formula"), F.parse_json("errors").alias("errors")).alias("x"))
    earlier = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    listed = checked.groupBy(id_col, "table_id", "category").agg(F.array_sort(F.collect_list(one), earlier)["x"].alias("x"))
    tables = listed.groupBy(id_col, "table_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "x"))).alias("x"))
    whole = tables.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("table_id", "x"))).alias(RESERVED))
    return whole.select(id_col, F.to_json(F.struct(RESERVED)).alias("text"))


def write_run(spark: SparkSession, path: str, run_id: str, tables: dict[str, DataFrame], facts: dict | None = None, formats: dict[str, str] | None = None) -> None:
    """Write tables, and facts (values that JSON can hold), as the run run_id under path.

    Each table is Parquet or, by formats, JSON lines. A run_id that is there already raises and stays as it is; names are for one
    driver at a time. If a table fails, what the run has written is removed and the error goes on.
    """
    if not run_id or "/" in run_id or run_id.startswith((".", "_")):
        raise ValueError(f"not a run's name: {run_id!r}")
    kinds = {name: (formats or {}).get(name, "parquet") for name in tables}
    if any(kind not in FORMATS for kind in kinds.values()):
        raise ValueError(f"formats are {FORMATS}")
    fs, at = _files(spark, path)
    final = at(f"{path}/{run_id}.run")
    if fs.exists(at(final, "manifest")):
        raise FileExistsError(f"run {run_id} is there already")
    own = f"_{run_id}-{uuid.uuid4().hex}"
    try:
        listed = []
        for name, df in tables.items():
            df.write.format(kinds[name]).save(f"{path}/{own}/{name}")
            listed.append({"name": name, "format": kinds[name], "path": f"{own}/{name}", "schema": df.schema.jsonValue()})
        manifest = json.dumps({"run_id": run_id, "facts": facts or {}, "tables": listed}, ensure_ascii=False)
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/{own}/manifest")
        fs.mkdirs(final)
        if fs.exists(at(final, "manifest")) or not fs.rename(at(f"{path}/{own}/manifest"), at(f"{path}/{run_id}.run/manifest")):
            raise FileExistsError(f"run {run_id} is there already")
    except BaseException:
        fs.delete(at(f"{path}/{own}"), True)
        raise


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs whose results are whole, in order."""
    fs, at = _files(spark, path)
    found = fs.globStatus(at(f"{path}/*.run/manifest"))
    return sorted(x.getPath().getParent().getName().removesuffix(".run") for x in found or ())


def read_run(spark: SparkSession, path: str, run_id: str) -> tuple[dict[str, DataFrame], dict]:
    """A run's tables by name, with the columns' types that they were written with, and its facts; a run that isn't whole raises."""
    if run_id not in runs(spark, path):
        raise FileNotFoundError(f"no run {run_id}")
    manifest = json.loads(spark.read.text(f"{path}/{run_id}.run/manifest").first().value)
    read = lambda t: spark.read.schema(StructType.fromJson(t["schema"])).format(t["format"]).load(f"{path}/{t['path']}")
    return {t["name"]: read(t) for t in manifest["tables"]}, manifest["facts"]
