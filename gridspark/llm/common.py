"""Helpers shared by the operators: inputs, shared scratch tables, blocks of texts."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in blocks of about this many UTF-8 bytes.
BLOCK_BYTES = 8 << 20
#: Rows handed to Python code at once inside an Arrow batch.
SLICE_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of 1,000 rows keep what the JVM and Python hold of them at a time small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """save(), dealt into files by key, so that grouping and joining by it need not shuffle the rows again."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{scratch_dir(spark).rstrip('/')}/{name}").bucketBy(buckets, key).format("parquet").saveAsTable(name)
    return spark.table(name)


def crc_bucket(column: Column, buckets: int) -> Column:
    """crc32 of a column's text form, modulo buckets; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks that gives each about block_bytes of text; one aggregate, one row to the driver."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-total // block_bytes))


def block_of(columns: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def carried(docs: DataFrame, id_col: str, carry: bool) -> tuple[Column, str]:
    """The first column of a per-row operator's result and its type: doc_id, or with carry the whole row as `row`."""
    if not carry:
        return F.col(id_col).cast("bigint").alias("doc_id"), "doc_id bigint"
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return row, f"row {docs.select(row).schema[0].dataType.simpleString()}"


_kept: dict = {}


def kept(key, build: Callable):
    """What an operator remembers in a worker process: built once, and dropped when another operator's takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


@contextlib.contextmanager
def no_cycles():
    """Without the cycle collector: walking large memories without cycles again and again takes a fifth of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def packed_longs(values: np.ndarray) -> bytes:
    """Non-negative longs in order as zstd of their differences, byte by byte of their places."""
    planes = np.diff(values.astype(np.uint64, copy=False), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(4, "little") + zstandard.compress(planes.tobytes(), 1)


def unpacked_longs(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(zstandard.decompress(raw[4:]), np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut into short ones, so that Python objects of a few rows exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string with the types used here."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()),
    }
    pairs = [part.strip().rsplit(" ", 1) for part in ddl.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])
