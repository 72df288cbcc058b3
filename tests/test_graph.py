"""Hand graphs with known answers, and random ones against plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from mesograph.graph import Graph
from mesograph.operators import metrics, ranking, traversal, verify
from mesograph.operators.components import star_components, weak_components
from mesograph.plans import cache_plan
from mesograph.plans.prefix import exclusive_sum

T1 = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 5), (3, 6)]
T3 = [(0, 1, 5), (1, 2, 0), (2, 0, 1), (2, 3, 7), (2, 3, 3), (3, 3, 2), (4, 5, 4)]


def graph(spark, edges, n):
    weighted = bool(edges) and len(edges[0]) == 3
    return Graph(spark.createDataFrame(edges, "src long, dst long" + (", weight long" if weighted else "")), n)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


WAYS = pytest.mark.parametrize("distributed", [True, False])


@WAYS
def test_small_graph(spark, distributed):
    g = graph(spark, T1, 7)
    levels, log = traversal.bfs(g, 0, trace=True, distributed=distributed)
    assert column(levels, "level") == [1, 2, 2, 2, 2, 3, 3]
    assert (log.active, log.node_sum, log.rounds) == ([1, 4, 2], 7, 3)
    assert column(traversal.sssp(g, 0, distributed=distributed), "dist") == [0, 1, 1, 1, 1, 2, 2]
    assert column(weak_components(g, distributed), "component") == [0] * 7
    ranks, moves = ranking.pagerank(g, trace=True, distributed=distributed)
    assert [round(x, 6) for x in column(ranks, "rank")] == [0.15, 0.181875, 0.233406, 0.332604, 0.332604, 0.291357, 0.291357]
    assert len(moves) == 4
    assert column(g.offsets(), "ptr") == [0, 4, 7, 9, 11, 11, 11]
    assert [tuple(r) for r in g.inspect([1, 6]).orderBy("id").collect()] == [(1, 4, 3, 2), (6, 11, 0, None)]


def test_plan_and_metrics(spark):
    g = graph(spark, T1, 7)
    plan = cache_plan.static_plan(g, 7, 1)
    assert column(plan, "is_static") == [True, True, False, False, False, False, False]
    active = metrics.active_by_level(traversal.bfs(g, 0), 7)
    density = metrics.cache_density(active, plan)
    rows = [(r.active_in_cache, r.active_total, r.active_out_of_cache) for r in density.orderBy("iter").collect()]
    assert rows == [(1, 1, 0), (1, 4, 3), (0, 2, 2)]
    whole = metrics.cache_density_summary(density).first()
    assert (round(whole.average_density, 4), round(whole.average_miss_rate, 4)) == (0.3333, 0.7143)
    paths = metrics.edge_path(active, plan)
    assert [(r.edges_static, r.edges_overload) for r in paths.orderBy("iter").collect()] == [(4, 0), (3, 4), (0, 0)]
    assert metrics.edge_path_summary(paths).first().overload_bytes == 32
    parts = [tuple(r) for r in cache_plan.range_plan(g, 4).orderBy("part").collect()]
    assert parts == [(0, 0, 0, 1, 4), (1, 1, 2, 2, 5), (2, 3, 6, 4, 2)]
    assert [r.part for r in cache_plan.needed_parts(cache_plan.range_plan(g, 4), spark.createDataFrame([(2,)], "id long")).collect()] == [1]
    batches = [tuple(r) for r in cache_plan.batch_plan(active, plan, 3).orderBy("iter", "batch").collect()]
    assert batches == [(2, 0, 2, 4), (2, 1, 1, 0), (3, 0, 2, 0)]
    chunks = {(r["iter"], r["chunk"]): r["edges"] for r in metrics.chunk_visits(active, plan, 3).collect()}
    assert chunks == {(1, 0): 3, (1, 1): 1, (2, 1): 2, (2, 2): 3, (2, 3): 2}


def test_always_active_is_never_taken_for_small(spark):
    """The estimate by which Spark chooses what to broadcast isn't under what the rows take."""
    active = metrics.active_always(spark.range(1000), 40)
    assert int(active._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= 40 * 1000 * 16
    assert sorted(map(tuple, metrics.active_always(spark.range(2), 2).collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert metrics.active_always(spark.range(2), 0).count() == 0


@WAYS
def test_zero_weights_loops_and_unreached(spark, distributed):
    g = graph(spark, T3, 7)
    assert column(traversal.bfs(g, 0, distributed=distributed), "level") == [1, 2, 3, 4, 8, 8, 8]
    dist, log = traversal.sssp(g, 0, trace=True, distributed=distributed)
    assert column(dist, "dist") == [0, 5, 5, 8, None, None, None] and log.active == [1, 1, 1, 1]
    assert str(column(traversal.sssp(g, 0, unreached="u64"), "dist")[4]) == "18446744073709551615"
    assert column(weak_components(g, distributed), "component") == [0, 0, 0, 0, 4, 4, 6]
    ranks, moves = ranking.pagerank(g, trace=True, distributed=distributed)
    assert [round(x, 6) for x in column(ranks, "rank")] == [0.287473, 0.394352, 0.485199, 2.783274, 0.15, 0.2775, 0.15]
    assert len(moves) == 26


def test_components_of_one_way_edges(spark):
    assert column(weak_components(graph(spark, [(0, 2), (1, 2)], 3)), "component") == [0, 0, 0]


@WAYS
def test_edge_cases(spark, distributed):
    one = Graph(spark.createDataFrame([], "src long, dst long"), 1)
    assert column(traversal.bfs(one, 0, distributed=distributed), "level") == [1]
    assert column(weak_components(one, distributed), "component") == [0]
    assert column(ranking.pagerank(one, distributed=distributed), "rank") == [0.15]
    assert one.offsets().first().ptr == 0
    with pytest.raises(ValueError):
        traversal.bfs(one, 1)
    bad = graph(spark, [(0, 5, 1), (1, 0, -2), (0, 1, 3)], 2)
    assert bad.invalid_edges().count() == 2
    assert Graph.of(bad.edges).n == 6
    assert traversal.spaced_sources(10, 8, 3) == [8, 8, 8]


@WAYS
def test_multi_source(spark, distributed):
    g = graph(spark, T1, 7)
    rows = {(r.source, r.id): r.level for r in traversal.multi_source(g, [0, 2], distributed=distributed).collect()}
    assert rows == {(0, 0): 1, (0, 1): 2, (0, 2): 2, (0, 3): 2, (0, 4): 2, (0, 5): 3, (0, 6): 3, (2, 2): 1, (2, 3): 2, (2, 4): 2, (2, 5): 3, (2, 6): 3}


def _dijkstra(edges, n, s):
    near, heap = [None] * n, [(0, s)]
    to = [[] for _ in range(n)]
    for a, b, w in edges:
        to[a].append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if near[v] is None:
            near[v] = d
            for b, w in to[v]:
                heapq.heappush(heap, (d + w, b))
    return near


@WAYS
@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed, distributed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(6)) for _ in range(90)]
    g = graph(spark, edges, n)
    dist = traversal.sssp(g, 3, distributed=distributed)
    assert column(dist, "dist") == _dijkstra(edges, n, 3)
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b, _ in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    labels = weak_components(g, distributed)
    assert column(labels, "component") == [find(v) for v in range(n)]
    assert verify.check_sssp(g, 3, dist).first().asDict() == {"relaxable": 0, "untight": 0}
    assert verify.check_components(g, labels).first().asDict() == {"crossing_edges": 0, "misnamed": 0}
    assert verify.check_bfs(g, 3, traversal.bfs(g, 3)).first().asDict() == {"mismatches": 0, "reached_difference": 0}
    assert verify.check_pagerank(g, ranking.pagerank(g)).first().moving == 0
    wrong = dist.withColumn("dist", F.when(F.col("id") == 3, F.lit(1)).otherwise(F.col("dist")))
    assert sum(verify.check_sssp(g, 3, wrong).first()) > 0
    assert verify.compare_sssp(g, 3, wrong).first().asDict() == {"mismatches": 1, "reached_difference": 0, "source_distance": 1}


def test_hubs_and_active_rows(spark, monkeypatch):
    """Edges of hubs are dealt out; the trace says who was active."""
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(1, 45)] + [(20, k) for k in range(2, 30)]
    g = graph(spark, edges, 46)
    plain = column(traversal.bfs(g, 0), "level")
    dist, log = traversal.sssp(g, 0, trace=True)
    assert [r["n"] for r in log.rows().groupBy("iter").agg(F.count(F.lit(1)).alias("n")).orderBy("iter").collect()] == log.active
    monkeypatch.setattr("mesograph.plans.fixpoint.HUB_EDGES", 10)
    assert column(traversal.bfs(g, 0), "level") == plain == column(traversal.bfs(g, 0, distributed=False), "level")
    assert column(traversal.sssp(g, 0), "dist") == column(dist, "dist")
    ranks = ranking.pagerank(g)
    assert verify.compare_pagerank(g, ranks).first().mismatches == 0
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_wrong_levels_are_found(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (4, 5), (5, 4)], 6)
    levels = traversal.bfs(g, 0)
    change = lambda **at: levels.withColumn("level", F.coalesce(*(F.when(F.col("id") == int(k[1:]), F.lit(v)) for k, v in at.items()), F.col("level")))
    assert sum(verify.check_bfs(g, 0, levels).first()) == 0
    for wrong in (change(v3=7), change(v3=3), change(v0=2), change(v4=2, v5=3), levels.where("id <> 3"), levels.withColumn("level", F.col("level") + 1)):
        assert sum(verify.check_bfs(g, 0, wrong).first()) > 0


def test_long_path_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = star_components(edges)
    assert found.count() == 301 and found.agg(F.max("component")).first()[0] == 0


def test_exclusive_sum_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("mesograph.plans.prefix.BLOCK", 7)
    rows = exclusive_sum(spark.range(50).withColumn("x", F.col("id") % 4), "id", "x", "before")
    values = [i % 4 for i in range(50)]
    assert column(rows, "before") == [sum(values[:i]) for i in range(50)]


def test_advised_share():
    from mesograph.functions.scalars import advised_ratio, dataset_name

    assert advised_ratio(100, 100) == 1.0
    assert advised_ratio(2000, 100) == 0.5
    assert advised_ratio(550, 100) == 0.5
    assert dataset_name("/a/b.c/web.2005.bcsr") == "web.2005"
    assert cache_plan.prefix_edges(100, 70, 32) == 64


def test_advised_shares_without_room(spark, tmp_path):
    """More vertices than the least memory holds; and no edges at all."""
    import duckdb

    from mesograph.source_queries import ORACLE_SQL, advised_shares

    spark.range(4000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.range(9000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4000).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    for rows in (orders, orders.limit(0)):
        rows.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        connection = duckdb.connect()
        for name in ("customer", "orders"):
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = sorted(map(tuple, advised_shares(spark, str(tmp_path)).collect()))
        assert got == sorted(connection.sql(ORACLE_SQL["advised_shares"]).fetchall()) and got[0][1] == 0 < got[2][1]
