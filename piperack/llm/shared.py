"""Checkpoints in the cluster's shared folder, and connected components."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, set for the session, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table of the shared folder, which is smaller than a checkpoint, and its path for ``removed``."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` has written, once nothing will read it again."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints of tables that nothing refers to any more: it does so when the driver
    collects its garbage, which one with memory to spare may put off for longer than the disks last."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b).

    Each round hands every label to the neighbours, by one join and one minimum that is taken in part before the
    shuffle, then replaces labels by their own labels. Tables are cut by checkpoints, so both joins read plain
    exchanges, whose hot keys adaptive execution can split. It ends when a round changes no label.
    """
    both = edges.where("a != b")
    both = kept(both.union(both.select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "component"))).first())

    before = state(labels)
    while True:
        offered = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        spread = kept(offered.union(labels).groupBy("node").agg(F.min("component").alias("component")))
        own = spread.select(F.col("node").alias("of"), F.col("component").alias("root"))
        labels = kept(spread.join(own, spread.component == own.of).select("node", F.least("component", "root").alias("component")))
        if (now := state(labels)) == before:
            return labels
        before = now
