"""Wrong results that are consistent in themselves must not pass the checks."""

from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.operators import traversal, verify
from mesograph.operators.components import weak_components

EDGES = [(0, 1, 5), (1, 2, 0), (2, 0, 1), (3, 4, 0), (4, 3, 0), (5, 6, 2)]


def test_consistent_but_wrong(spark):
    g = Graph(spark.createDataFrame(EDGES, "src long, dst long, weight long"), 7)
    dist = traversal.sssp(g, 0)
    assert verify.check_sssp(g, 0, dist).first().asDict() == {"relaxable": 0, "untight": 0}
    assert verify.compare_sssp(g, 0, dist).first().asDict() == {"mismatches": 0, "reached_difference": 0, "source_distance": 0}
    nothing = dist.withColumn("dist", F.lit(None).cast("long"))
    shifted = dist.withColumn("dist", F.col("dist") + 3)
    lower = dist.withColumn("dist", F.col("dist") - 3)
    cycle = dist.withColumn("dist", F.when(F.col("id").isin(3, 4), F.lit(9)).otherwise(F.col("dist")))
    for wrong in (nothing, shifted, lower, cycle):
        assert sum(verify.check_sssp(g, 0, wrong).first()) > 0
        assert verify.compare_sssp(g, 0, wrong).first().mismatches > 0
    labels = weak_components(g)
    assert sum(verify.check_components(g, labels).first()) == 0 == sum(verify.compare_components(g, labels).first())
    merged = labels.withColumn("component", F.lit(0).cast("long"))
    assert sum(verify.check_components(g, merged).first()) > 0
    assert verify.compare_components(g, merged).first().asDict() == {"mismatches": 4, "component_difference": -2}
