"""Connected components of any edge list by alternating star contraction.

A round has two steps. In the large step every vertex links its larger neighbours to the least
vertex of its neighbourhood, in the small step its smaller ones. Both keep the components and shrink
paths, so the rounds grow with the logarithm of the vertices and not with the diameter. Minima are
partial aggregates and the joins back to the edges are ones that adaptive execution can split, so a
vertex with very many neighbours doesn't bind one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.plans import local
from mesograph.plans.durable import durable
from mesograph.plans.fixpoint import Trace, least_values


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 200) -> DataFrame:
    """(id, component) of every vertex that some edge joins to another; component: its least vertex.

    Self-loops, repeated edges and edges with a null end link nothing. Vertices without edges are
    the caller's to add."""
    ends = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = durable(ends.distinct())
    before = None
    for _ in range(most):
        now = durable(_small(_large(now)))
        # a round that changes nothing leaves stars; sums of hashes tell whether one did
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"no fixed point after {most} rounds")


def weak_components(graph, distributed: bool = True) -> DataFrame:
    """(id, component) of every vertex of a graph, edges taken both ways; component: its least vertex.
    distributed False: by one task, for a small graph."""
    edges = graph.edges.select("src", "dst")
    if not distributed:
        local.check(edges, graph.n)
        return local.in_one_task(edges, local.components(graph.n), "id long, component long")
    linked = star_components(edges).withColumnRenamed("id", "_id")
    return graph.vertices.join(linked, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component"))


def spread_labels(graph) -> tuple[DataFrame, Trace]:
    """(id, component) by passing least labels along edges both ways, round by round, and who was active in which.

    As many rounds as the longest of the shortest ways to a least vertex: for what a round reads, and for checking."""
    start = graph.vertices.withColumn("value", F.col("id"))
    both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found, trace = least_values(both, start, F.col("value"), keep=True)
    return found.withColumnRenamed("value", "component"), trace
