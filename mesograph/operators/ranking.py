"""PageRank without normalisation: 0.15 + 0.85 * the sum of rank / out-degree over in-edges.

All vertices start at 0.15 and are renewed together each round; repeated edges count, vertices without
out-edges send nothing. Rounds go on while some rank moved by more than the tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.plans import local
from mesograph.plans.durable import durable
from mesograph.plans.fixpoint import Edges, static_plans

BASE, DAMPING = 0.15, 0.85


def shares(graph: Graph) -> DataFrame:
    """(src, dst, share): the edges, equal ones as one, with the part of the source's rank that they send on."""
    edges = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    degrees = edges.groupBy(F.col("src").alias("_s")).agg(F.sum("_n").alias("_d"))
    return edges.join(degrees, F.col("src") == F.col("_s")).select("src", "dst", (F.col("_n") / F.col("_d")).alias("share"))


def step(graph: Graph, sent: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, rank, diff) after one round from (id, rank)."""
    sums = sent.join(ranks.select(F.col("id").alias("_i"), F.col("rank").alias("_r")), F.col("src") == F.col("_i")).groupBy("dst").agg(F.sum(F.col("share") * F.col("_r")).alias("_sum"))
    return _renewed(ranks, sums)


def _renewed(ranks: DataFrame, sums: DataFrame) -> DataFrame:
    new = F.lit(BASE) + DAMPING * F.coalesce("_sum", F.lit(0.0))
    return ranks.join(sums, F.col("id") == F.col("dst"), "left").select("id", new.alias("rank"), F.abs(new - F.col("rank")).alias("diff"))


def pagerank(graph: Graph, tolerance: float = 0.01, most: int = 1000, trace: bool = False, distributed: bool = True) -> DataFrame | tuple[DataFrame, list[float]]:
    """(id, rank); with trace, also the largest move of each round. distributed False: by one task, for a small graph.

    Shares lie by source and ranks by vertex, in the same partitions; only sums are shuffled."""
    if not distributed:
        edges = graph.edges.select("src", "dst")
        local.check(edges, graph.n)
        found = durable(local.in_one_task(edges, local.ranks(graph.n, BASE, DAMPING, tolerance, most), "id long, rank double"))
        log = [r["rank"] for r in found.where("id < 0").orderBy(F.desc("id")).collect()] if trace else []
        return (found.where("id >= 0"), log) if trace else found.where("id >= 0")
    moves: list[float] = []
    with static_plans(graph.spark):
        sent = Edges(shares(graph))
        parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
        ranks = durable(graph.vertices.select("id", F.lit(BASE).alias("rank")).repartition(parts, "id").sortWithinPartitions("id"))
        while graph.n and (not moves or moves[-1] > tolerance) and len(moves) < most:
            seen = Observation()  # a maximum: a task that runs twice doesn't change it
            sums = sent.from_ids(ranks).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("_sum"))
            new = durable(_renewed(ranks, sums.hint("merge")).observe(seen, F.max("diff").alias("most")))
            moves.append(seen.get["most"])
            ranks = new.select("id", "rank")
        sent.release()
    return (ranks, moves) if trace else ranks


def damped_step(graph: Graph, ranks: DataFrame) -> DataFrame:
    """The other update that is sometimes used: 0.15 of the old rank and 0.85 of the sum; one round."""
    sums = step(graph, shares(graph), ranks)
    return ranks.withColumnRenamed("rank", "_old").join(sums, "id").select("id", (BASE * F.col("_old") + F.col("rank") - BASE).alias("rank"))


def frozen_step(graph: Graph, ranks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One round in which a rank is only stored if it moves by more than the tolerance."""
    new = step(graph, shares(graph), ranks)
    return ranks.withColumnRenamed("rank", "_old").join(new, "id").select("id", F.when(F.col("diff") > tolerance, F.col("rank")).otherwise(F.col("_old")).alias("rank"))
