"""Intermediate tables of iterative operators: written to the folder that driver and executors share, so lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session that runs in one process may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if getattr(spark, "_hopwright_folder", None) is None:
        spark._hopwright_folder = f"file://{tempfile.mkdtemp(prefix='hopwright-')}"
    return spark._hopwright_folder


class Rounds:
    """The tables of a loop: each round is written and read again; the one before it is deleted once the next is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        before, self.last = self.last, path
        if before:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)
