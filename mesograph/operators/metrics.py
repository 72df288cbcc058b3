"""Per-round locality metrics of a search, from who was active when (iter, id) and a static plan.

All are plain aggregates. For breadth-first search a vertex is active in the round of its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesograph.functions.scalars import ratio


def active_by_level(levels: DataFrame, n: int) -> DataFrame:
    """(iter, id) of a breadth-first search's reached vertices."""
    return levels.where(F.col("level") <= n).select(F.col("level").alias("iter"), "id")


def active_always(vertices: DataFrame, rounds: int) -> DataFrame:
    """(iter, id) where every vertex is active in every round.

    A join, not an array to explode: Spark takes exploded rows for as small as their input and would broadcast them."""
    every = vertices.sparkSession.range(1, rounds + 1).withColumnRenamed("id", "iter")
    return vertices.crossJoin(F.broadcast(every)).select("iter", "id")


def _planned(active: DataFrame, plan: DataFrame) -> DataFrame:
    return active.join(plan.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def frontier_split(active: DataFrame, plan: DataFrame) -> DataFrame:
    """(iter, is_static, vertices, edges): each round's frontier, resident and not."""
    return _planned(active, plan).groupBy("iter", "is_static").agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"))


def cache_density(active: DataFrame, plan: DataFrame) -> DataFrame:
    static = plan.agg(F.count_if("is_static").alias("static_vertex_count"))
    rows = _planned(active, plan).groupBy("iter").agg(F.count_if("is_static").alias("active_in_cache"), F.count(F.lit(1)).alias("active_total"))
    rows = rows.withColumn("active_out_of_cache", F.col("active_total") - F.col("active_in_cache")).join(F.broadcast(static))  # one row
    return rows.withColumn("per_iter_density", ratio(F.col("active_in_cache"), F.col("static_vertex_count"))).withColumn("per_iter_miss_rate", ratio(F.col("active_out_of_cache"), F.col("active_total")))


def cache_density_summary(density: DataFrame) -> DataFrame:
    """One row: rounds and the averages weighted by their denominators."""
    got = density.agg(F.count(F.lit(1)).alias("iterations"), _sum(F.col("active_in_cache")).alias("active_in_cache"), _sum(F.col("active_total")).alias("active_total"), F.max("static_vertex_count").alias("_static"))
    return got.select("iterations", "active_in_cache", "active_total", ratio(F.col("active_in_cache"), F.coalesce(F.col("iterations") * F.col("_static"), F.lit(0))).alias("average_density"), ratio(F.col("active_total") - F.col("active_in_cache"), F.col("active_total")).alias("average_miss_rate"))


def edge_path(active: DataFrame, plan: DataFrame) -> DataFrame:
    rows = _planned(active, plan).groupBy("iter").agg(_sum(F.when(F.col("is_static"), F.col("degree"))).alias("edges_static"), _sum(F.when(~F.col("is_static"), F.col("degree"))).alias("edges_overload"))
    return rows.withColumn("per_iter_static_ratio", ratio(F.col("edges_static"), F.col("edges_static") + F.col("edges_overload")))


def edge_path_summary(paths: DataFrame, edge_bytes: int = 8) -> DataFrame:
    """One row: totals, their ratios, and the bytes that uncached edges move."""
    got = paths.agg(_sum(F.col("edges_static")).alias("edges_static"), _sum(F.col("edges_overload")).alias("edges_overload"))
    whole = F.col("edges_static") + F.col("edges_overload")
    return got.select("edges_static", "edges_overload", ratio(F.col("edges_static"), whole).alias("static_ratio"), ratio(F.col("edges_overload"), whole).alias("overload_ratio"), (F.col("edges_overload") * edge_bytes).alias("overload_bytes"))


def overload_share(paths: DataFrame, edges: int) -> DataFrame:
    """One row: mean and largest share of the graph's edges that a round reads uncached."""
    share = F.col("edges_overload") / edges
    return paths.agg(F.avg(share).alias("avg_share"), F.max(share).alias("max_share"))


def chunk_visits(active: DataFrame, plan: DataFrame, chunk: int) -> DataFrame:
    """(iter, chunk, edges): active rows' edges in each stretch of ``chunk`` edges; a row over a border counts in both."""
    rows = _planned(active, plan).where("degree > 0")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("ptr") / chunk), F.floor((F.col("ptr") + F.col("degree") - 1) / chunk))))
    part = F.least(F.col("ptr") + F.col("degree"), (F.col("chunk") + 1) * chunk) - F.greatest(F.col("ptr"), F.col("chunk") * chunk)
    return rows.groupBy("iter", "chunk").agg(F.sum(part).alias("edges"))


def fragment_visits(active: DataFrame, plan: DataFrame, fragment: int) -> DataFrame:
    """(fragment, visits): active rows' edges, each counted in the row's first fragment only."""
    rows = _planned(active, plan).where("degree > 0").withColumn("fragment", F.floor(F.col("ptr") / fragment))
    return rows.groupBy("fragment").agg(F.sum(F.least(F.col("degree"), (F.col("fragment") + 1) * fragment - F.col("ptr"))).alias("visits"))


def hot_fragments(visits: DataFrame, least: int) -> DataFrame:
    """Fragments visited more than ``least`` times: those worth keeping."""
    return visits.where(F.col("visits") > least)


def visit_histogram(active: DataFrame, plan: DataFrame, edges: int, parts: int = 50) -> DataFrame:
    """(part, visits): visits times degree per equal part of the edge array, by where rows begin."""
    rows = _planned(active, plan).where("degree > 0").withColumn("part", F.floor(F.col("ptr") * parts / F.lit(max(1, edges))))
    return rows.groupBy("part").agg(F.sum("degree").alias("visits"))


def visit_counts(active: DataFrame) -> DataFrame:
    """(id, visits): in how many rounds each vertex was active."""
    return active.groupBy("id").agg(F.count(F.lit(1)).alias("visits"))
