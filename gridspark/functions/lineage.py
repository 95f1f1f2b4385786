"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: later plans start there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table in the shared folder that grows round by round: one scan reads it, however many rounds there were, so that plans stay small."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.rounds, self.schema = spark, f"{shared_folder(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write df as the next round's part and read it back."""
        self.rounds, self.schema = self.rounds + 1, df.schema
        path = f"{self.path}/part-of-round-{self.rounds}"
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """What all rounds have written."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
