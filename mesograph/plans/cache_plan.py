"""Which vertices' edges lie in a resident prefix of the edge array, and how the rest is cut.

The prefix is counted in edges. It is what fits, or a share of it, rounded down to whole fragments; a vertex is
static if its whole row lies inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.functions.scalars import advised_ratio
from mesograph.graph import Graph
from mesograph.plans.prefix import exclusive_sum

FRAGMENT = 4096


def prefix_edges(edges: int, fits: int, fragment: int = FRAGMENT, share: float | None = 1.0) -> int:
    """Edges in the prefix. share None: the advised one; 1: as many as fit."""
    if fits <= 0:
        return 0
    k = advised_ratio(edges, fits) if share is None else share
    return min(int(k * fits), edges) // fragment * fragment


def static_plan(graph: Graph, fits: int, fragment: int = FRAGMENT, share: float | None = 1.0, start: int = 0) -> DataFrame:
    """(id, degree, ptr, is_static). ``start``: where the resident range of edges begins."""
    end = start + prefix_edges(graph.edges.count(), fits, fragment, share)
    inside = (F.col("ptr") >= start) & (F.col("ptr") < end) & (F.col("ptr") + F.col("degree") - 1 < end)
    return graph.offsets().select("id", "degree", "ptr", inside.alias("is_static"))


def range_plan(graph: Graph, most: int) -> DataFrame:
    """(part, first_id, last_id, vertices, edges): contiguous vertex ranges by where their rows begin in
    steps of ``most`` edges, so a part holds at most ``most`` edges and its last row."""
    parts = graph.offsets().withColumn("part", F.floor(F.col("ptr") / most))
    return parts.groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"))


def needed_parts(plan: DataFrame, active: DataFrame) -> DataFrame:
    """The parts of a range plan that hold an active vertex (id): those a round has to read."""
    return plan.join(active.select("id"), F.col("id").between(F.col("first_id"), F.col("last_id")), "left_semi")


def batch_plan(active: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """(iter, batch, vertices, edges): the uncached active vertices (iter, id) in id order, cut by the running
    sum of their edges."""
    rows = active.join(plan.where(~F.col("is_static")).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("iter", "id", "degree")
    rows = exclusive_sum(rows, "id", "degree", "_before", ["iter"]).withColumn("batch", F.floor(F.col("_before") / most))
    return rows.groupBy("iter", "batch").agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"))
