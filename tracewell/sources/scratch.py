"""Cutting lineage of iterative jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Steps:
    """A table in the shared folder that an iterative job appends its steps to; what it wrote outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, None

    def append(self, df: DataFrame) -> DataFrame:
        """Write the next step and read it back."""
        self.schema = df.schema
        at = f"{self.path}/step={self.count}"
        df.write.parquet(at)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        """All steps, with the number of each as ``step``."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("step", LongType())])).parquet(self.path)
