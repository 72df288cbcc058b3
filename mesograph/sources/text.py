"""Text edge lists, value files and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_edges(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines ``value`` that begin with two whole numbers; what follows on a line is ignored, other lines are left out."""
    found = lambda k: F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)(?:\s|$)", k)
    return lines.select(found(1).alias("a"), found(2).alias("b")).where("a <> ''").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def write_values(result: DataFrame, value: str, path: str) -> None:
    """One value a line in vertex order; the part files in order of their names."""
    result.orderBy("id").select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_metrics(rows: DataFrame, path: str, algorithm: str, dataset: str, source: int, run: int = 0) -> None:
    """Per-round metrics added to a table of CSV files with a header; source -1: there is none."""
    first = {"algo": F.lit(algorithm), "dataset": F.lit(dataset), "source": F.lit(source).cast("long"), "run": F.lit(run)}
    rows.select(*(c.alias(k) for k, c in first.items()), *rows.columns).coalesce(1).write.mode("append").option("header", True).csv(path)


def write_visits(active: DataFrame, plan: DataFrame, path: str) -> None:
    """Lines of round, vertex, where its row begins and how many edges it has, tab-separated, in order of round and vertex."""
    rows = active.join(plan.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).orderBy("iter", "id")
    rows.select("iter", "id", "ptr", "degree").write.mode("overwrite").option("sep", "\t").csv(path)


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("iter long, id long, ptr long, degree long").csv(path)


def edge_statistics(edges: DataFrame) -> DataFrame:
    """One row: lines, vertices by the largest id, and the least and largest source."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), (F.max(F.greatest("src", "dst")) + 1).alias("vertices"), F.min("src").alias("min_source"), F.max("src").alias("max_source"))
