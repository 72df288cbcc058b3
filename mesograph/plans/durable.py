"""Cutting lineage by files that every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Whether frames made while it is set remove their shuffles' files as soon as they have run.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) is a temporary folder chosen where none is set; on a
    cluster the executors couldn't see it, so there a missing setting is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder. A lost executor costs nothing: its rows are files elsewhere.

    So nothing needs the shuffles that made them. Their files go at once: otherwise they stay until the driver happens to
    collect its garbage, and after many steps of many partitions those files, an index and a checksum a task, fill the disk."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        whole = df.select("*")  # a frame is bound to the setting when it is made
    finally:
        spark.conf.set(CLEAN, before)
    return whole.checkpoint(eager=True)
