"""Graphs derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.plans.durable import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_graph(spark: SparkSession, sf_dir: str, urgent: bool = True, finished: bool = False) -> Graph:
    """Customers by their orders: all of them, the urgent ones, or the urgent and finished ones."""
    n = _table(spark, sf_dir, "customer").count()
    rows = _table(spark, sf_dir, "orders")
    if urgent:
        rows = rows.where(F.col("o_orderpriority") == "1-URGENT")
    if finished:
        rows = rows.where(F.col("o_orderstatus") == "F")
    weight = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 20
    return Graph(rows.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst"), weight.alias("weight")), n)


def parts_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers by large order lines, both ways."""
    p, s = _table(spark, sf_dir, "part").count(), _table(spark, sf_dir, "supplier").count()
    rows = _table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 50)
    one = rows.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + p).alias("dst"), F.lit(1).cast("long").alias("weight"))
    return Graph(one, p + s).symmetrized()


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users by who acts next. All events are one sequence: it is cut into ranges, each event learns the next one of
    its range, and the last of a range the first of the next; only a row a range is ordered as a whole."""
    events = _table(spark, sf_dir, "events")
    n = events.agg(F.max("user_id")).first()[0] + 1
    rows = events.select("ts", "event_id", "user_id", (F.floor(F.abs("value")) % 20).alias("weight"))
    rows = durable(rows.repartitionByRange("ts", "event_id").withColumn("_range", F.spark_partition_id()))
    inside = rows.withColumn("dst", F.lead("user_id").over(Window.partitionBy("_range").orderBy("ts", "event_id")))
    firsts = rows.groupBy("_range").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("_first"))
    firsts = firsts.select(F.col("_range").alias("_r"), F.lead("_first").over(Window.orderBy("_range")).alias("_next"))
    joined = inside.join(F.broadcast(firsts), F.col("_range") == F.col("_r"))  # as many rows as there are partitions
    edges = joined.select(F.col("user_id").alias("src"), F.coalesce("dst", "_next").alias("dst"), "weight")
    return Graph(edges.where("dst is not null"), n)
