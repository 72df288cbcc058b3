"""Edges from text files as they arrive, and degrees that keep up with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.sources.text import parse_edges


def stream_edges(spark: SparkSession, folder: str) -> DataFrame:
    return parse_edges(spark.readStream.format("text").load(folder))


def stream_degrees(edges: DataFrame, end: str = "src") -> DataFrame:
    """(id, degree) for the complete or update output mode; the state is one number a vertex."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
