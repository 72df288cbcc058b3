"""The graph queries over the test tables and their DuckDB SQL. All but a few run on the urgent-orders graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph import fixtures
from mesograph.graph import Graph
from mesograph.operators import metrics, ranking, traversal, verify
from mesograph.operators.components import weak_components
from mesograph.plans import cache_plan

SOURCE, FITS, FRAGMENT, CHUNK, MOST = 0, 2048, 256, 300, 128

_urgent = fixtures.orders_graph


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles differ in their last digits with the order of their parts."""
    return df.withColumns({n: F.round(n, 10) for n in names})


def _levels(spark, d):
    g = _urgent(spark, d)
    return g, traversal.bfs(g, SOURCE)


def _active(spark, d):
    g, levels = _levels(spark, d)
    return g, metrics.active_by_level(levels, g.n), cache_plan.static_plan(g, FITS, FRAGMENT)


def bfs_levels(spark, d):
    return _levels(spark, d)[1]


def bfs_dense(spark, d):
    return traversal.bfs(fixtures.orders_graph(spark, d, urgent=False), SOURCE)


def bfs_fragmented(spark, d):
    return traversal.bfs(fixtures.orders_graph(spark, d, finished=True), SOURCE)


def bfs_events(spark, d):
    return traversal.bfs(fixtures.events_graph(spark, d), SOURCE)


def bfs_levels_one_task(spark, d):
    """By NumPy in one task, for a graph whose size allows it; as the four below."""
    return traversal.bfs(_urgent(spark, d), SOURCE, distributed=False)


def sssp_distances_one_task(spark, d):
    return traversal.sssp(_urgent(spark, d), SOURCE, distributed=False)


def multi_source_one_task(spark, d):
    g = _urgent(spark, d)
    return traversal.multi_source(g, traversal.spaced_sources(g.n, SOURCE, 3), distributed=False)


def cc_labels_one_task(spark, d):
    return weak_components(_urgent(spark, d), distributed=False)


def pagerank_one_task(spark, d):
    return _rounded(ranking.pagerank(_urgent(spark, d), distributed=False), "rank")


def bfs_level_histogram(spark, d):
    return _levels(spark, d)[1].groupBy("level").agg(F.count(F.lit(1)).alias("vertices"))


def bfs_reached_count(spark, d):
    g, levels = _levels(spark, d)
    return levels.agg(F.count_if(F.col("level") <= g.n).alias("reached"))


def bfs_multi_source(spark, d):
    g = _urgent(spark, d)
    return traversal.multi_source(g, traversal.spaced_sources(g.n, SOURCE, 3))


def sssp_distances(spark, d):
    return traversal.sssp(_urgent(spark, d), SOURCE)


def sssp_unit_weight(spark, d):
    return traversal.sssp(_urgent(spark, d).without_weights(), SOURCE)


def sssp_multi_source(spark, d):
    g = _urgent(spark, d)
    return traversal.multi_source(g, traversal.spaced_sources(g.n, SOURCE, 3), weighted=True)


def sssp_unsigned_unreached(spark, d):
    """Unreached vertices as the largest unsigned integer, shown as text."""
    return traversal.sssp(_urgent(spark, d), SOURCE, unreached="u64").select("id", F.col("dist").cast("string").alias("dist"))


def cc_labels(spark, d):
    return weak_components(_urgent(spark, d))


def cc_fragmented(spark, d):
    return weak_components(fixtures.orders_graph(spark, d, finished=True))


def cc_parts(spark, d):
    return weak_components(fixtures.parts_graph(spark, d))


def cc_component_sizes(spark, d):
    return cc_labels(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))


def cc_count(spark, d):
    return cc_labels(spark, d).agg(F.countDistinct("component").alias("components"))


def pagerank(spark, d):
    return _rounded(ranking.pagerank(_urgent(spark, d)), "rank")


def pagerank_parts(spark, d):
    return _rounded(ranking.pagerank(fixtures.parts_graph(spark, d)), "rank")


def pagerank_rounds(spark, d):
    """How many rounds it took and the last round's largest move."""
    _, moves = ranking.pagerank(_urgent(spark, d), trace=True)
    return spark.createDataFrame([(len(moves), round(moves[-1], 10))], "rounds long, max_diff double")


def pagerank_mean(spark, d):
    return _rounded(ranking.pagerank(_urgent(spark, d)).agg(F.avg("rank").alias("mean_rank")), "mean_rank")


def pagerank_source_only_count(spark, d):
    """Vertices that get nothing: rank exactly the base."""
    return ranking.pagerank(_urgent(spark, d)).agg(F.count_if(F.col("rank") == ranking.BASE).alias("source_only"))


def _base(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.lit(ranking.BASE).alias("rank"))


def pagerank_one_round(spark, d):
    g = _urgent(spark, d)
    return _rounded(ranking.step(g, ranking.shares(g), _base(g)).select("id", "rank"), "rank")


def pagerank_damped_round(spark, d):
    g = _urgent(spark, d)
    return _rounded(ranking.damped_step(g, _base(g)), "rank")


def pagerank_frozen_round(spark, d):
    g = _urgent(spark, d)
    return _rounded(ranking.frozen_step(g, _base(g), 0.1), "rank")


def out_degree(spark, d):
    return _urgent(spark, d).degrees("src")


def in_degree(spark, d):
    return _urgent(spark, d).degrees("dst")


def csr_offsets(spark, d):
    return _urgent(spark, d).offsets("src")


def csc_offsets(spark, d):
    return _urgent(spark, d).offsets("dst")


def symmetrize(spark, d):
    return _urgent(spark, d).symmetrized().edges.groupBy("src", "dst", "weight").agg(F.count(F.lit(1)).alias("copies"))


def strip_weights(spark, d):
    return _urgent(spark, d).without_weights().edges


def vertex_count_from_edges(spark, d):
    g = Graph.of(_urgent(spark, d).edges)
    return spark.range(1).select(F.lit(g.n).cast("long").alias("vertices"))


def graph_validate(spark, d):
    return _urgent(spark, d).invalid_edges().agg(F.count(F.lit(1)).alias("invalid_edges"))


def static_plan(spark, d):
    return cache_plan.static_plan(_urgent(spark, d), FITS, FRAGMENT)


def static_plan_advised(spark, d):
    """The prefix with the advised share of the room."""
    return cache_plan.static_plan(_urgent(spark, d), FITS, FRAGMENT, share=None)


def static_vertex_count(spark, d):
    return static_plan(spark, d).agg(F.count_if("is_static").alias("static_vertices"))


def frontier_split(spark, d):
    _, active, plan = _active(spark, d)
    return metrics.frontier_split(active, plan)


def cache_density_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return _rounded(metrics.cache_density(active, plan), "per_iter_density", "per_iter_miss_rate")


def cache_density_summary_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return _rounded(metrics.cache_density_summary(metrics.cache_density(active, plan)), "average_density", "average_miss_rate")


def edge_path_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return _rounded(metrics.edge_path(active, plan), "per_iter_static_ratio")


def edge_path_summary_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return _rounded(metrics.edge_path_summary(metrics.edge_path(active, plan)), "static_ratio", "overload_ratio")


def edge_path_pr(spark, d):
    """PageRank reads every vertex's in-edges in every round."""
    g = _urgent(spark, d)
    _, moves = ranking.pagerank(g, trace=True)
    plan = cache_plan.static_plan(g.reversed(), FITS, FRAGMENT)
    return _rounded(metrics.edge_path(metrics.active_always(g.vertices, len(moves)), plan), "per_iter_static_ratio")


def overload_share_bfs(spark, d):
    g, active, plan = _active(spark, d)
    return _rounded(metrics.overload_share(metrics.edge_path(active, plan), g.edges.count()), "avg_share", "max_share")


def node_sum_bfs(spark, d):
    """Rounds and the sum of the frontiers, as the loop itself counts them."""
    g = _urgent(spark, d)
    _, log = traversal.bfs(g, SOURCE, trace=True)
    return spark.createDataFrame([(log.rounds, log.node_sum)], "rounds long, node_sum long")


def batch_plan(spark, d):
    _, active, plan = _active(spark, d)
    return cache_plan.batch_plan(active, plan, MOST)


def range_partition_plan(spark, d):
    return cache_plan.range_plan(_urgent(spark, d), CHUNK)


def needed_partitions_bfs(spark, d):
    """The ranges that the search's second round has to read."""
    g, active, _ = _active(spark, d)
    return cache_plan.needed_parts(cache_plan.range_plan(g, CHUNK), active.where("iter = 2"))


def fragment_visits_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return metrics.fragment_visits(active, plan, FRAGMENT)


def hot_fragments_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return metrics.hot_fragments(metrics.fragment_visits(active, plan, FRAGMENT), 200)


def chunk_visits_bfs(spark, d):
    _, active, plan = _active(spark, d)
    return metrics.chunk_visits(active, plan, CHUNK)


def visit_histogram_50(spark, d):
    g, active, plan = _active(spark, d)
    return metrics.visit_histogram(active, plan, g.edges.count())


def visit_counts_bfs(spark, d):
    return metrics.visit_counts(_active(spark, d)[1])


def verify_bfs(spark, d):
    g, levels = _levels(spark, d)
    return verify.check_bfs(g, SOURCE, levels)


def verify_sssp_relaxable_edges(spark, d):
    g = _urgent(spark, d)
    return verify.check_sssp(g, SOURCE, traversal.sssp(g, SOURCE))


def verify_cc_edge_labels(spark, d):
    g = _urgent(spark, d)
    return verify.check_components(g, weak_components(g))


def verify_pr_residual(spark, d):
    g = _urgent(spark, d)
    return verify.check_pagerank(g, ranking.pagerank(g))


def verify_sssp_again(spark, d):
    g = _urgent(spark, d)
    return verify.compare_sssp(g, SOURCE, traversal.sssp(g, SOURCE))


def verify_pr_again(spark, d):
    g = _urgent(spark, d)
    return verify.compare_pagerank(g, ranking.pagerank(g))


def node_inspect(spark, d):
    return _urgent(spark, d).inspect([0, 1, 7, 42])


_NAMES = """bfs_levels_one_task sssp_distances_one_task multi_source_one_task cc_labels_one_task pagerank_one_task
bfs_levels bfs_dense bfs_fragmented bfs_events bfs_level_histogram bfs_reached_count bfs_multi_source
sssp_distances sssp_unit_weight sssp_multi_source sssp_unsigned_unreached
cc_labels cc_fragmented cc_parts cc_component_sizes cc_count
pagerank pagerank_parts pagerank_rounds pagerank_mean pagerank_source_only_count pagerank_one_round pagerank_damped_round pagerank_frozen_round
out_degree in_degree csr_offsets csc_offsets symmetrize strip_weights vertex_count_from_edges graph_validate node_inspect
static_plan static_plan_advised static_vertex_count frontier_split cache_density_bfs cache_density_summary_bfs
edge_path_bfs edge_path_summary_bfs edge_path_pr overload_share_bfs node_sum_bfs batch_plan range_partition_plan needed_partitions_bfs
fragment_visits_bfs hot_fragments_bfs chunk_visits_bfs visit_histogram_50 visit_counts_bfs
verify_bfs verify_sssp_relaxable_edges verify_cc_edge_labels verify_pr_residual verify_sssp_again verify_pr_again""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# --- the same in DuckDB ----------------------------------------------------------------------------

_G2 = "o_orderpriority = '1-URGENT'"


def _graph(where: str = _G2) -> str:
    return f"""n AS (SELECT count(*) AS n FROM customer), v AS (SELECT unnest(range((SELECT n FROM n)))::BIGINT AS id),
e AS (SELECT o_custkey AS src, o_orderkey % (SELECT n FROM n) AS dst, (o_orderkey * 7 + o_custkey) % 20 AS weight FROM orders WHERE {where})"""


_PARTS = """n AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n), v AS (SELECT unnest(range((SELECT n FROM n)))::BIGINT AS id),
h AS (SELECT l_partkey AS a, (SELECT count(*) FROM part) + l_suppkey AS b FROM lineitem WHERE l_quantity >= 50),
e AS (SELECT a AS src, b AS dst, 1 AS weight FROM h UNION ALL SELECT b, a, 1 FROM h)"""
_EVENTS = """n AS (SELECT max(user_id) + 1 AS n FROM events), v AS (SELECT unnest(range((SELECT n FROM n)))::BIGINT AS id),
e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, 1 AS weight FROM events) WHERE dst IS NOT NULL)"""


def _least(name: str, start: str, step: str, both: bool = False) -> str:
    """A recursive least value by id: each round's improvements only."""
    edges = "(SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)" if both else "e"
    return f"""{name}(id, x) USING KEY (id) AS ({start} UNION
SELECT b.id, b.x FROM (SELECT e.dst AS id, min({step}) AS x FROM {name} r JOIN {edges} e ON r.id = e.src GROUP BY e.dst) b
LEFT JOIN recurring.{name} o ON o.id = b.id WHERE o.x IS NULL OR b.x < o.x)"""


_BFS = _least("r", f"SELECT {SOURCE}::BIGINT, 1::BIGINT", "r.x + 1")
_SSSP = _least("r", f"SELECT {SOURCE}::BIGINT, 0::BIGINT", "r.x + e.weight")
_CC = _least("r", "SELECT id, id FROM v", "r.x", both=True)
_LEVELS = "l AS (SELECT v.id, coalesce(r.x, (SELECT n FROM n) + 1)::BIGINT AS level FROM v LEFT JOIN r USING (id))"
_DEGREES = "d AS (SELECT v.id, coalesce(c, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT {0} AS id, count(*) AS c FROM e GROUP BY 1) USING (id))"
_OFFSETS = _DEGREES + ", p AS (SELECT id, degree, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM d)"


def _static(end: str = "src", share: str = "1.0") -> str:
    b = f"least(floor({share} * {FITS})::BIGINT, (SELECT count(*) FROM e)) // {FRAGMENT} * {FRAGMENT}"
    return _OFFSETS.format(end) + f", s AS (SELECT id, degree, ptr, ptr < {b} AND ptr + degree - 1 < {b} AS is_static FROM p)"


_ACTIVE = f"WITH RECURSIVE {_graph()}, {_BFS}, {_LEVELS}, {_static()}, a AS (SELECT level AS iter, s.* FROM l JOIN s USING (id) WHERE level <= (SELECT n FROM n))"
_DENSITY = "t AS (SELECT iter, count(*) FILTER (is_static)::BIGINT AS i, count(*)::BIGINT AS c, (SELECT count(*) FROM s WHERE is_static)::BIGINT AS k FROM a GROUP BY iter)"
_PATH = "t AS (SELECT iter, coalesce(sum(degree) FILTER (is_static), 0)::BIGINT AS i, coalesce(sum(degree) FILTER (NOT is_static), 0)::BIGINT AS o FROM a GROUP BY iter)"
_RATIO = "CASE WHEN {1} = 0 THEN 0.0 ELSE ({0})::DOUBLE / ({1}) END"


def _ranks(graph: str, rounds: int = 60) -> str:
    return f"""WITH RECURSIVE {graph}, q AS (SELECT src, count(*) AS k FROM e GROUP BY src),
w AS (SELECT src, dst, count(*)::DOUBLE / any_value(k) AS share FROM e JOIN q USING (src) GROUP BY src, dst),
pr(it, id, x) AS (SELECT 0, id, 0.15::DOUBLE FROM v UNION ALL
SELECT t.it, v.id, 0.15 + 0.85 * coalesce(s.y, 0) FROM v CROSS JOIN (SELECT max(it) + 1 AS it FROM pr) t
LEFT JOIN (SELECT w.dst, sum(pr.x * w.share) AS y FROM pr JOIN w ON pr.id = w.src GROUP BY w.dst) s ON s.dst = v.id WHERE t.it <= {rounds}),
m AS (SELECT b.it, max(abs(b.x - a.x)) AS move FROM pr a JOIN pr b ON a.id = b.id AND b.it = a.it + 1 GROUP BY b.it),
f AS (SELECT min(it) AS it FROM m WHERE move <= 0.01)"""


_STOPPED = "SELECT id, x FROM pr WHERE it = (SELECT it FROM f)"
_MULTI = "k AS (SELECT unnest([0, (SELECT n FROM n) // 3, 2 * ((SELECT n FROM n) // 3)])::BIGINT AS source)"


def _multi(start: int, step: str) -> str:
    return f"""r(source, id, x) USING KEY (source, id) AS (SELECT source, source, {start}::BIGINT FROM k UNION
SELECT b.source, b.id, b.x FROM (SELECT r.source, e.dst AS id, min({step}) AS x FROM r JOIN e ON r.id = e.src GROUP BY r.source, e.dst) b
LEFT JOIN recurring.r o ON o.id = b.id AND o.source = b.source WHERE o.x IS NULL OR b.x < o.x)"""


def _bfs(graph: str) -> str:
    return f"WITH RECURSIVE {graph}, {_BFS}, {_LEVELS} SELECT id, level FROM l"


def _cc(graph: str) -> str:
    return f"WITH RECURSIVE {graph}, {_CC} SELECT id, x AS component FROM r"


_ROUND = "WITH " + _graph() + """, q AS (SELECT src, count(*) AS k FROM e GROUP BY src), w AS (SELECT dst, sum(0.15::DOUBLE / k) AS y FROM e JOIN q USING (src) GROUP BY dst),
x AS (SELECT id, coalesce(y, 0) AS y FROM v LEFT JOIN w ON w.dst = v.id)"""
_RANGES = _OFFSETS.format("src") + f", g AS (SELECT ptr // {CHUNK} AS part, min(id) AS first_id, max(id) AS last_id, count(*)::BIGINT AS vertices, sum(degree)::BIGINT AS edges FROM p GROUP BY 1)"

ORACLE_SQL = {
    "bfs_levels": _bfs(_graph()),
    "bfs_dense": _bfs(_graph("true")),
    "bfs_fragmented": _bfs(_graph(_G2 + " AND o_orderstatus = 'F'")),
    "bfs_events": _bfs(_EVENTS),
    "bfs_level_histogram": f"WITH RECURSIVE {_graph()}, {_BFS}, {_LEVELS} SELECT level, count(*)::BIGINT AS vertices FROM l GROUP BY level",
    "bfs_reached_count": f"WITH RECURSIVE {_graph()}, {_BFS} SELECT count(*)::BIGINT AS reached FROM r",
    "bfs_multi_source": f"WITH RECURSIVE {_graph()}, {_MULTI}, {_multi(1, 'r.x + 1')} SELECT source, id, x AS level FROM r",
    "sssp_distances": f"WITH RECURSIVE {_graph()}, {_SSSP} SELECT v.id, r.x AS dist FROM v LEFT JOIN r USING (id)",
    "sssp_unit_weight": f"WITH RECURSIVE {_graph()}, {_BFS} SELECT v.id, r.x - 1 AS dist FROM v LEFT JOIN r USING (id)",
    "sssp_multi_source": f"WITH RECURSIVE {_graph()}, {_MULTI}, {_multi(0, 'r.x + e.weight')} SELECT source, id, x AS dist FROM r",
    "sssp_unsigned_unreached": f"WITH RECURSIVE {_graph()}, {_SSSP} SELECT v.id, coalesce(r.x::VARCHAR, '18446744073709551615') AS dist FROM v LEFT JOIN r USING (id)",
    "cc_labels": _cc(_graph()),
    "cc_fragmented": _cc(_graph(_G2 + " AND o_orderstatus = 'F'")),
    "cc_parts": _cc(_PARTS),
    "cc_component_sizes": f"WITH RECURSIVE {_graph()}, {_CC} SELECT x AS component, count(*)::BIGINT AS vertices FROM r GROUP BY x",
    "cc_count": f"WITH RECURSIVE {_graph()}, {_CC} SELECT count(DISTINCT x)::BIGINT AS components FROM r",
    "pagerank": f"{_ranks(_graph())} SELECT id, round(x, 10) AS rank FROM ({_STOPPED})",
    "pagerank_parts": f"{_ranks(_PARTS)} SELECT id, round(x, 10) AS rank FROM ({_STOPPED})",
    "pagerank_rounds": f"{_ranks(_graph())} SELECT it::BIGINT AS rounds, round(move, 10) AS max_diff FROM m WHERE it = (SELECT it FROM f)",
    "pagerank_mean": f"{_ranks(_graph())} SELECT round(avg(x), 10) AS mean_rank FROM ({_STOPPED})",
    "pagerank_source_only_count": f"{_ranks(_graph())} SELECT count(*)::BIGINT AS source_only FROM ({_STOPPED}) WHERE x = 0.15",
    "pagerank_one_round": f"{_ROUND} SELECT id, round(0.15 + 0.85 * y, 10)::DOUBLE AS rank FROM x",
    "pagerank_damped_round": f"{_ROUND} SELECT id, round(0.15 * 0.15 + 0.85 * y, 10)::DOUBLE AS rank FROM x",
    "pagerank_frozen_round": f"{_ROUND} SELECT id, round(CASE WHEN 0.85 * y > 0.1 THEN 0.15 + 0.85 * y ELSE 0.15 END, 10)::DOUBLE AS rank FROM x",
    "out_degree": f"WITH {_graph()}, {_DEGREES.format('src')} SELECT * FROM d",
    "in_degree": f"WITH {_graph()}, {_DEGREES.format('dst')} SELECT * FROM d",
    "csr_offsets": f"WITH {_graph()}, {_OFFSETS.format('src')} SELECT * FROM p",
    "csc_offsets": f"WITH {_graph()}, {_OFFSETS.format('dst')} SELECT * FROM p",
    "symmetrize": f"WITH {_graph()} SELECT src, dst, weight, count(*)::BIGINT AS copies FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY ALL",
    "strip_weights": f"WITH {_graph()} SELECT src, dst FROM e",
    "vertex_count_from_edges": f"WITH {_graph()} SELECT (max(greatest(src, dst)) + 1)::BIGINT AS vertices FROM e",
    "graph_validate": f"WITH {_graph()} SELECT count(*)::BIGINT AS invalid_edges FROM e WHERE src < 0 OR dst < 0 OR src >= (SELECT n FROM n) OR dst >= (SELECT n FROM n) OR weight < 0",
    "node_inspect": f"WITH {_graph()}, {_OFFSETS.format('src')} SELECT id, ptr, degree, (SELECT min(dst) FROM e WHERE src = id) AS first_dst FROM p WHERE id IN (0, 1, 7, 42)",
    "static_plan": f"WITH {_graph()}, {_static()} SELECT * FROM s",
    "static_plan_advised": f"""WITH {_graph()}, {_static(share=f"(SELECT CASE WHEN k < 0 THEN 0.5 ELSE least(k, 1.0) END FROM (SELECT (10 - count(*)::DOUBLE / {FITS}) / 9 AS k FROM e))")} SELECT * FROM s""",
    "static_vertex_count": f"WITH {_graph()}, {_static()} SELECT count(*) FILTER (is_static)::BIGINT AS static_vertices FROM s",
    "frontier_split": f"{_ACTIVE} SELECT iter, is_static, count(*)::BIGINT AS vertices, sum(degree)::BIGINT AS edges FROM a GROUP BY ALL",
    "cache_density_bfs": f"{_ACTIVE}, {_DENSITY} SELECT iter, i AS active_in_cache, c AS active_total, c - i AS active_out_of_cache, k AS static_vertex_count, round({_RATIO.format('i', 'k')}, 10) AS per_iter_density, round({_RATIO.format('c - i', 'c')}, 10) AS per_iter_miss_rate FROM t",
    "cache_density_summary_bfs": f"{_ACTIVE}, {_DENSITY} SELECT count(*)::BIGINT AS iterations, sum(i)::BIGINT AS active_in_cache, sum(c)::BIGINT AS active_total, round({_RATIO.format('sum(i)', 'count(*) * max(k)')}, 10) AS average_density, round({_RATIO.format('sum(c - i)', 'sum(c)')}, 10) AS average_miss_rate FROM t",
    "edge_path_bfs": f"{_ACTIVE}, {_PATH} SELECT iter, i AS edges_static, o AS edges_overload, round({_RATIO.format('i', '(i + o)')}, 10) AS per_iter_static_ratio FROM t",
    "edge_path_summary_bfs": f"{_ACTIVE}, {_PATH} SELECT sum(i)::BIGINT AS edges_static, sum(o)::BIGINT AS edges_overload, round({_RATIO.format('sum(i)', '(sum(i) + sum(o))')}, 10) AS static_ratio, round({_RATIO.format('sum(o)', '(sum(i) + sum(o))')}, 10) AS overload_ratio, (sum(o) * 8)::BIGINT AS overload_bytes FROM t",
    "edge_path_pr": f"{_ranks(_graph())}, {_static('dst')}, a AS (SELECT it::BIGINT AS iter, s.* FROM s CROSS JOIN (SELECT DISTINCT it FROM pr WHERE it BETWEEN 1 AND (SELECT it FROM f))), {_PATH} SELECT iter, i AS edges_static, o AS edges_overload, round({_RATIO.format('i', '(i + o)')}, 10) AS per_iter_static_ratio FROM t",
    "overload_share_bfs": f"{_ACTIVE}, {_PATH} SELECT round(avg(o::DOUBLE / (SELECT count(*) FROM e)), 10) AS avg_share, round(max(o::DOUBLE / (SELECT count(*) FROM e)), 10) AS max_share FROM t",
    "node_sum_bfs": f"WITH RECURSIVE {_graph()}, {_BFS} SELECT max(x)::BIGINT AS rounds, count(*)::BIGINT AS node_sum FROM r",
    "batch_plan": f"{_ACTIVE}, b AS (SELECT iter, degree, coalesce(sum(degree) OVER (PARTITION BY iter ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM a WHERE NOT is_static) SELECT iter, (o // {MOST})::BIGINT AS batch, count(*)::BIGINT AS vertices, sum(degree)::BIGINT AS edges FROM b GROUP BY 1, 2",
    "range_partition_plan": f"WITH {_graph()}, {_RANGES} SELECT * FROM g",
    "needed_partitions_bfs": f"WITH RECURSIVE {_graph()}, {_BFS}, {_LEVELS}, {_RANGES} SELECT * FROM g WHERE EXISTS (SELECT 1 FROM l WHERE level = 2 AND id BETWEEN first_id AND last_id)",
    "fragment_visits_bfs": f"{_ACTIVE} SELECT ptr // {FRAGMENT} AS fragment, sum(least(degree, (ptr // {FRAGMENT} + 1) * {FRAGMENT} - ptr))::BIGINT AS visits FROM a WHERE degree > 0 GROUP BY 1",
    "hot_fragments_bfs": f"{_ACTIVE} SELECT ptr // {FRAGMENT} AS fragment, sum(least(degree, (ptr // {FRAGMENT} + 1) * {FRAGMENT} - ptr))::BIGINT AS visits FROM a WHERE degree > 0 GROUP BY 1 HAVING sum(least(degree, (ptr // {FRAGMENT} + 1) * {FRAGMENT} - ptr)) > 200",
    "chunk_visits_bfs": f"{_ACTIVE}, c AS (SELECT *, unnest(range(ptr // {CHUNK}, (ptr + degree - 1) // {CHUNK} + 1)) AS chunk FROM a WHERE degree > 0) SELECT iter, chunk, sum(least(ptr + degree, (chunk + 1) * {CHUNK}) - greatest(ptr, chunk * {CHUNK}))::BIGINT AS edges FROM c GROUP BY 1, 2",
    "visit_histogram_50": f"{_ACTIVE} SELECT ptr * 50 // (SELECT count(*) FROM e) AS part, sum(degree)::BIGINT AS visits FROM a WHERE degree > 0 GROUP BY 1",
    "visit_counts_bfs": f"{_ACTIVE} SELECT id, count(*)::BIGINT AS visits FROM a GROUP BY id",
    "verify_sssp_again": "SELECT 0::BIGINT AS mismatches, 0::BIGINT AS reached_difference, 0::BIGINT AS source_distance",
    "verify_pr_again": "SELECT 0::BIGINT AS mismatches",
    "verify_bfs": "SELECT 0::BIGINT AS mismatches, 0::BIGINT AS reached_difference",
    "verify_sssp_relaxable_edges": f"WITH RECURSIVE {_graph()}, {_SSSP} SELECT count(*) FILTER (a.x IS NOT NULL AND (b.x IS NULL OR a.x + weight < b.x))::BIGINT AS relaxable, (SELECT count(*) FROM r WHERE id <> {SOURCE} AND NOT EXISTS (SELECT 1 FROM e JOIN r q ON q.id = e.src WHERE e.dst = r.id AND q.x + e.weight = r.x))::BIGINT AS untight FROM e LEFT JOIN r a ON a.id = src LEFT JOIN r b ON b.id = dst",
    "verify_cc_edge_labels": f"WITH RECURSIVE {_graph()}, {_CC} SELECT (SELECT count(*) FROM e JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE a.x <> b.x)::BIGINT AS crossing_edges, (SELECT count(*) FROM (SELECT x, min(id) AS m FROM r GROUP BY x) WHERE x <> m)::BIGINT AS misnamed",
    "verify_pr_residual": f"{_ranks(_graph())} SELECT count(*)::BIGINT AS moving FROM pr a JOIN pr b ON a.id = b.id AND b.it = a.it + 1 WHERE a.it = (SELECT it FROM f) AND abs(a.x - b.x) > 0.01",
}
for _name, _same in (("bfs_levels", ""), ("sssp_distances", ""), ("cc_labels", ""), ("pagerank", ""), ("multi_source", "bfs_")):
    ORACLE_SQL[f"{_name}_one_task"] = ORACLE_SQL[_same + _name]
