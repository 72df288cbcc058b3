"""A directed graph as two DataFrames: vertices 0..n-1 and edges (src, dst[, weight])."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.plans.prefix import exclusive_sum


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n: int

    @classmethod
    def of(cls, edges: DataFrame, n: int | None = None) -> Graph:
        """n defaults to the largest id plus one."""
        if n is None:
            n = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1 if not edges.isEmpty() else 0
        return cls(edges, int(n))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def without_weights(self) -> Graph:
        return Graph(self.edges.select("src", "dst"), self.n)

    def with_weights(self, default: int = 1) -> Graph:
        """Unweighted edges get the default weight."""
        return self if self.weighted else Graph(self.edges.withColumn("weight", F.lit(default).cast("long")), self.n)

    def reversed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.n)

    def symmetrized(self) -> Graph:
        """Each edge in both directions; multiplicity stays."""
        return Graph(self.edges.unionByName(self.reversed().edges), self.n)

    def degrees(self, end: str = "src") -> DataFrame:
        """(id, degree) of every vertex, those without edges too."""
        counted = self.edges.groupBy(F.col(end).alias("_id")).agg(F.count(F.lit(1)).alias("_d"))
        return self.vertices.join(counted, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_d", F.lit(0)).alias("degree"))

    def offsets(self, end: str = "src") -> DataFrame:
        """(id, degree, ptr): where each vertex's row begins in the edge array sorted by ``end``."""
        return exclusive_sum(self.degrees(end), "id", "degree", "ptr")

    def invalid_edges(self) -> DataFrame:
        """Edges with an end outside 0..n-1 or null, or a negative weight."""
        bad = ~F.col("src").between(0, self.n - 1) | ~F.col("dst").between(0, self.n - 1) | F.col("src").isNull() | F.col("dst").isNull()
        return self.edges.where(bad | (F.col("weight") < 0) if self.weighted else bad)

    def inspect(self, ids: list[int]) -> DataFrame:
        """(id, ptr, degree, first_dst) of some vertices."""
        some = self.offsets().where(F.col("id").isin(*ids))
        first = self.edges.where(F.col("src").isin(*ids)).groupBy("src").agg(F.min("dst").alias("first_dst"))
        return some.join(first, F.col("id") == F.col("src"), "left").select("id", "ptr", "degree", "first_dst")
