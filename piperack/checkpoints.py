"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, set for the session, on a local master only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: for large tables that are read more than once, as columns
    take a fraction of a checkpoint's room, and a reader takes only those that it needs, and of ``by``, columns of few
    values, only the values that it asks for."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables-{uuid4()}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """The union of tables that are cut already; it is cut itself only now and then, so that plans stay short."""

    def __init__(self, first: DataFrame, every: int = 12):
        self.whole, self.every, self.parts = first, every, 1

    def add(self, more: DataFrame) -> None:
        self.whole, self.parts = self.whole.union(more), self.parts + 1
        if self.parts >= self.every:
            self.whole, self.parts = cut(self.whole), 1
