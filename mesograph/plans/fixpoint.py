"""The loop under every iterative query: only what changed sends messages, rounds end when nothing did.

The state lies partitioned and sorted by vertex, the edges by source, in the same number of partitions. So a round
joins the vertices that changed in the last one with their edges where they lie; the messages, reduced to one a target by
each task, are its only shuffle; and they are joined with the state where that lies. One job makes the new state, writes it to
the shared checkpoint folder and counts what changed: plans don't grow with the rounds, and a lost executor loses nothing.

Sources with very many edges are few by definition (a share of all edges each). Their edges lie spread over all
partitions and meet a broadcast of the few changed ones among them, so a hub isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mesograph.plans.durable import durable

#: A source is a hub if it has more edges than this and more than this share of all edges; so there are at most 1 / HUB_SHARE.
HUB_EDGES, HUB_SHARE = 1 << 20, 1e-4


@contextmanager
def static_plans(spark: SparkSession) -> Iterator[None]:
    """Plans as they are written. Adaptive execution forgets how a checkpoint is partitioned and would
    shuffle the whole state every round."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Trace:
    """Per round: how many vertices were active in it, and, if kept, which."""

    active: list[int] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.active)

    @property
    def node_sum(self) -> int:
        return sum(self.active)

    def rows(self) -> DataFrame:
        """(iter, id): who was active in which round, from 1 on."""
        return reduce(DataFrame.unionByName, [f.select(F.lit(k).cast("long").alias("iter"), "id") for k, f in enumerate(self.frames, 1)])


class Edges:
    """Edges by source, sorted, kept for all rounds (on disk where memory ends)."""

    def __init__(self, edges: DataFrame):
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.whole = edges.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
        of_source = self.whole.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        seen = of_source.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        self.count, bound = seen["all"] or 0, max(HUB_EDGES, HUB_SHARE * (seen["all"] or 0))
        self.hubs = self.spread = None
        if (seen["most"] or 0) > bound:
            self.hubs = durable(of_source.where(F.col("n") > bound).select(F.col("src").alias("_hub")))
            split = lambda how: edges.join(F.broadcast(self.hubs), F.col("src") == F.col("_hub"), how)
            self.spread = split("left_semi").repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
            self.whole.unpersist()
            self.whole = split("left_anti").repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)

    def from_ids(self, active: DataFrame) -> DataFrame:
        """The edges whose source is an ``id`` of ``active``, with its other columns."""
        met = active.join(self.whole, F.col("id") == F.col("src"))
        if self.hubs is None:
            return met
        some = active.join(F.broadcast(self.hubs), F.col("id") == F.col("_hub"), "left_semi")
        return met.unionByName(self.spread.join(F.broadcast(some), F.col("id") == F.col("src")).select(met.columns))

    def release(self) -> None:
        self.whole.unpersist()
        if self.spread is not None:
            self.spread.unpersist()


def least_values(edges: DataFrame, start: DataFrame, candidate: Column, keys: tuple[str, ...] = ("id",), most: int | None = None, keep: bool = False) -> tuple[DataFrame, Trace]:
    """The least value of each key that steps along edges reach.

    ``start``: every key once, with its value or null. ``candidate``: the value that an edge's target gets, from ``value``
    and the edge's columns. Keys are the vertex ``id`` and whatever else tells searches apart, such as the source. ``keep``:
    the trace also says who was active. Keys that nothing reaches aren't returned."""
    others, spark = [k for k in keys if k != "id"], edges.sparkSession
    with static_plans(spark):
        kept, trace = Edges(edges), Trace()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        state = start.select(*keys, "value", F.col("value").isNotNull().alias("changed"))
        state = durable(state.repartition(parts, *keys).sortWithinPartitions(*keys))
        n = state.where("changed").count()
        while n and (most is None or trace.rounds < most):
            active = state.where("changed")
            trace.active.append(n)
            if keep:
                trace.frames.append(active)
            sent = kept.from_ids(active).select(*others, F.col("dst").alias("id"), candidate.alias("_new"))
            best = sent.groupBy(*keys).agg(F.min("_new").alias("_new")).withColumnsRenamed({k: f"_{k}" for k in keys})
            # a left join keeps the state's partitioning and order; no number of the round is in the plan, so compiled code is used again
            both = state.join(best.hint("merge"), [F.col(k) == F.col(f"_{k}") for k in keys], "left")
            better = F.col("_new").isNotNull() & (F.col("value").isNull() | (F.col("_new") < F.col("value")))
            seen = Observation()  # a count: a task that runs twice is counted once
            new = both.select(*keys, F.when(better, F.col("_new")).otherwise(F.col("value")).alias("value"), better.alias("changed"))
            state = durable(new.observe(seen, F.count_if("changed").alias("n")))
            n = seen.get["n"]
        kept.release()
    return state.where("value is not null").select(*keys, "value"), trace
