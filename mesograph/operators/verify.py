"""Checks of a result against the graph itself, or against another way to get it. Each gives one row; all counts are 0 for
a right result. None uses the solver that it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.operators import ranking, traversal
from mesograph.operators.components import spread_labels, star_components
from mesograph.plans import local
from mesograph.plans.durable import durable


def mismatches(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Rows (id, a, b) where two results differ; a missing vertex differs."""
    x, y = a.select("id", F.col(value).alias("a")), b.select(F.col("id").alias("_id"), F.col(value).alias("b"))
    return x.join(y, F.col("id") == F.col("_id"), "full").where(F.col("id").isNull() | F.col("_id").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("id", "_id").alias("id"), "a", "b")


def _ends(graph: Graph, values: DataFrame, value: str) -> DataFrame:
    """Edges with the value of each end: a and b."""
    a = values.select(F.col("id").alias("_s"), F.col(value).alias("a"))
    b = values.select(F.col("id").alias("_t"), F.col(value).alias("b"))
    return graph.edges.join(a, F.col("src") == F.col("_s")).join(b, F.col("dst") == F.col("_t"))


def check_bfs(graph: Graph, source: int, levels: DataFrame) -> DataFrame:
    """mismatches: vertices without a level in 1..n+1 or with two, a source that isn't at level 1, and edges that skip a level;
    reached_difference: reached vertices other than the source without an in-edge from the level before.

    Levels with none of these are the lengths of shortest paths: by induction along the in-edges no level is too
    small, and along a shortest path none is too large."""
    ends = _ends(graph, levels, "level").where(F.col("a") <= graph.n)
    skipped = ends.agg(F.count_if(~F.coalesce(F.col("b") <= F.col("a") + 1, F.lit(False))).alias("_n"))
    each = graph.vertices.join(levels.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_c"), F.min("level").alias("level")), F.col("id") == F.col("_id"), "left")
    fine = (F.col("_c") == 1) & F.col("level").between(1, graph.n + 1) & ((F.col("id") != source) | (F.col("level") == 1))
    wrong = each.agg(F.count_if(~F.coalesce(fine, F.lit(False))).alias("_m"))
    before = ends.where(F.col("b") == F.col("a") + 1).select(F.col("dst").alias("id")).distinct()
    loose = levels.where((F.col("level") <= graph.n) & (F.col("id") != source)).join(before, "id", "left_anti").agg(F.count(F.lit(1)).alias("reached_difference"))
    both = skipped.join(F.broadcast(wrong)).join(F.broadcast(loose))  # one row each
    return both.select((F.col("_n") + F.col("_m")).alias("mismatches"), "reached_difference")


def check_sssp(graph: Graph, source: int, dist: DataFrame) -> DataFrame:
    """relaxable: edges that would still shorten a path (the start counts as an edge of length 0 to the source); untight: reached
    vertices that no path of tight edges joins to the source, and a source whose distance isn't 0. Both are 0 for the
    right distances only.

    A tight edge of positive weight comes from a smaller distance; only along those of weight 0 do paths have to be followed."""
    ends = _ends(graph.with_weights(), dist, "dist")
    open_edges = ends.agg(F.count_if(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") + F.col("weight") < F.col("b")))).alias("relaxable"))
    start = dist.where(F.col("id") == source).agg(F.count_if(F.col("dist") <= 0).alias("_held"))
    tight = ends.where(F.col("a") + F.col("weight") == F.col("b"))
    level = durable(tight.where("weight = 0").select("src", "dst").distinct())
    held = tight.where("weight > 0").select(F.col("dst").alias("id")).unionByName(dist.where((F.col("id") == source) & (F.col("dist") == 0)).select("id"))
    held = durable(held.distinct())
    new = held
    while not level.isEmpty():
        step = level.join(new, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        new = durable(step.join(held, "id", "left_anti"))
        if new.isEmpty():
            break
        held = durable(held.unionByName(new))
    loose = dist.where(F.col("dist").isNotNull()).join(held, "id", "left_anti").agg(F.count(F.lit(1)).alias("untight"))
    both = open_edges.join(F.broadcast(start)).join(F.broadcast(loose))  # one row each
    return both.select((F.col("relaxable") + F.when(F.col("_held") == 0, 1).otherwise(0)).alias("relaxable"), "untight")


def _small(graph: Graph) -> bool:
    return local.fits(graph.edges, graph.n)


def compare_sssp(graph: Graph, source: int, dist: DataFrame) -> DataFrame:
    """Against distances found anew (in one task where the graph fits, so by other code): mismatches, reached vertices on either side,
    the source's distance."""
    again = traversal.sssp(graph, source, distributed=not _small(graph))
    reached = lambda df: df.agg(F.count("dist")).first()[0]
    held = dist.where(F.col("id") == source).agg(F.min("dist")).first()[0]
    out = mismatches(dist, again, "dist").agg(F.count(F.lit(1)).alias("mismatches"))
    return out.withColumns({"reached_difference": F.lit(reached(dist) - reached(again)).cast("long"), "source_distance": F.lit(held).cast("long")})


def check_components(graph: Graph, labels: DataFrame) -> DataFrame:
    """crossing_edges: edges between labels; misnamed: vertices without a label or with another than passing least labels along edges
    gives (not the star contraction that makes them)."""
    crossing = _ends(graph, labels, "component").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("crossing_edges"))
    misnamed = mismatches(labels, spread_labels(graph)[0], "component").agg(F.count(F.lit(1)).alias("misnamed"))
    return crossing.join(F.broadcast(misnamed))  # one row each


def compare_components(graph: Graph, labels: DataFrame) -> DataFrame:
    """Against components found anew by star contraction: mismatches, and how many more components there are."""
    linked = star_components(graph.edges.select("src", "dst")).withColumnRenamed("id", "_id")
    again = graph.vertices.join(linked, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component"))
    number = lambda df: df.agg(F.count_distinct("component")).first()[0]
    out = mismatches(labels, again, "component").agg(F.count(F.lit(1)).alias("mismatches"))
    return out.withColumn("component_difference", F.lit(number(labels) - number(again)).cast("long"))


def check_pagerank(graph: Graph, ranks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """How many ranks one more round would move by more than the tolerance."""
    return ranking.step(graph, ranking.shares(graph), ranks).agg(F.count_if(F.col("diff") > tolerance).alias("moving"))


def compare_pagerank(graph: Graph, ranks: DataFrame, near: float = 1e-6) -> DataFrame:
    """Against ranks found anew (in one task where the graph fits, so by other code): ranks that differ by more than ``near``."""
    again = ranking.pagerank(graph, distributed=not _small(graph)).select(F.col("id").alias("_id"), F.col("rank").alias("_rank"))
    both = ranks.join(again, F.col("id") == F.col("_id"), "full")
    return both.agg(F.count_if(~F.coalesce(F.abs(F.col("rank") - F.col("_rank")) <= near, F.lit(False))).alias("mismatches"))
