"""Breadth-first levels and single-source shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.plans import local
from mesograph.plans.durable import durable
from mesograph.plans.fixpoint import Trace, least_values


def _solve(graph: Graph, sources: list[int], first: int, weighted: bool, distributed: bool, keep: bool = False) -> tuple[DataFrame, Trace]:
    """([source,] id, value) of what the sources reach."""
    if bad := [s for s in sources if not 0 <= s < graph.n]:
        raise ValueError(f"no such vertices: {bad}")
    sources = list(dict.fromkeys(sources))
    edges = graph.with_weights().edges.select("src", "dst", "weight") if weighted else graph.edges.select("src", "dst")
    if distributed:
        step = F.col("value") + (F.col("weight") if weighted else 1)
        every = graph.vertices.withColumn("source", F.explode(F.array(*(F.lit(s).cast("long") for s in sources))))
        start = every.withColumn("value", F.when(F.col("id") == F.col("source"), F.lit(first).cast("long")))
        return least_values(edges, start, step, ("source", "id") if len(sources) > 1 else ("id",), keep=keep)
    local.check(edges, graph.n)
    found = durable(local.in_one_task(edges, local.least_values(graph.n, sources, first, weighted), "source long, id long, value long"))
    sizes = found.where("id < 0").groupBy("id").agg(F.sum("value").alias("n")).orderBy(F.desc("id")).collect()
    return found.where("id >= 0"), Trace([r["n"] for r in sizes])


def bfs(graph: Graph, source: int = 0, trace: bool = False, distributed: bool = True) -> DataFrame | tuple[DataFrame, Trace]:
    """(id, level): the source's is 1, an unreached vertex's n + 1. Edges are followed from src to dst."""
    found, log = _solve(graph, [source], 1, False, distributed)
    out = graph.vertices.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    out = out.select("id", F.coalesce("value", F.lit(graph.n + 1)).alias("level"))
    return (out, log) if trace else out


#: How unreached vertices look: null, the largest signed or the largest unsigned 64-bit integer.
UNREACHED = {"null": "null", "max": "9223372036854775807", "u64": "cast('18446744073709551615' as decimal(20,0))"}


def sssp(graph: Graph, source: int = 0, unreached: str = "null", trace: bool = False, distributed: bool = True) -> DataFrame | tuple[DataFrame, Trace]:
    """(id, dist) by non-negative integer weights (1 where the graph has none); the source's is 0. The trace of the
    distributed loop also has who was active in which round."""
    found, log = _solve(graph, [source], 0, True, distributed, trace)
    out = graph.vertices.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    dist = F.col("value") if unreached == "null" else F.coalesce(F.col("value").cast("decimal(20,0)") if unreached == "u64" else F.col("value"), F.expr(UNREACHED[unreached]))
    out = out.select("id", dist.alias("dist"))
    return (out, log) if trace else out


def spaced_sources(n: int, source: int, repetitions: int) -> list[int]:
    """The sources of repeated runs: each a repetition's share of the vertices on; one out of range is the first again."""
    step = n // max(1, repetitions)
    return [s if s < n else source for s in (source + k * step for k in range(repetitions))]


def multi_source(graph: Graph, sources: list[int], weighted: bool = False, distributed: bool = True) -> DataFrame:
    """(source, id, level | dist) of the reached vertices of every source, all in one loop."""
    found, _ = _solve(graph, sources, 0 if weighted else 1, weighted, distributed)
    source = F.col("source") if "source" in found.columns else F.lit(sources[0]).cast("long").alias("source")
    return found.select(source, "id", F.col("value").alias("dist" if weighted else "level"))
