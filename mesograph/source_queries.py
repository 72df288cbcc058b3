"""Queries that write a graph, a result or a table of metrics and read it back, and rounds of the other algorithms, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph import fixtures
from mesograph.graph import Graph
from mesograph.operators import metrics, ranking, traversal
from mesograph.operators.components import spread_labels, weak_components
from mesograph.plans import cache_plan
from mesograph.plans.durable import shared_folder
from mesograph.queries import _ACTIVE, _CC, _DEGREES, _DENSITY, _PATH, _RATIO, FITS, FRAGMENT, SOURCE, _bfs, _cc, _graph, _ranks, _rounded, _static
from mesograph.sources import csr, text
from mesograph.sources.layouts import LAYOUTS

_urgent = fixtures.orders_graph
ABOVE = 100


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, without the scheme where that is one of plain files."""
    folder = shared_folder(spark)
    path = f"{folder.removeprefix('file://').removeprefix('file:') if folder.startswith('file:') else folder}/files-{uuid.uuid4().hex}"
    if "://" not in path:
        Path(path).mkdir(parents=True)
    return f"{path}/{name}"


def layout(name: str, spark, d) -> DataFrame:
    path = _place(spark, f"g.{name}")
    csr.write_graph(_urgent(spark, d), path, name)
    return csr.read_graph(spark, path, name).edges


def pairs(spark, d):
    path = _place(spark, "g.toB")
    csr.write_pairs(_urgent(spark, d), path)
    return csr.read_graph(spark, path).edges


def converted(spark, d):
    """Wide and weighted to narrow without weights."""
    one, two = _place(spark, "a.bwcsr64"), _place(spark, "b.bcsr")
    csr.write_graph(_urgent(spark, d), one, "wcsr64")
    csr.convert(spark, one, two, "csr32")
    return csr.read_graph(spark, two).edges


def weights_added(spark, d):
    path = _place(spark, "g.bcsr")
    csr.write_graph(_urgent(spark, d), path, "csr32")
    return csr.read_graph(spark, path, weights="add").edges


def weights_dropped(spark, d):
    path = _place(spark, "g.bwcsr")
    csr.write_graph(_urgent(spark, d), path, "wcsr32")
    return csr.read_graph(spark, path, weights="drop").edges


def suffix_default(spark, d):
    """Vertices and edges of a file whose layout its suffix tells."""
    path = _place(spark, "g.bcsr64")
    csr.write_graph(_urgent(spark, d), path, "csr64")
    g = csr.read_graph(spark, path)
    return g.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("vertices", F.lit(g.n).cast("long"))


def file_out_degrees(spark, d):
    """The block of out-degrees that a file by targets holds."""
    path, g = _place(spark, "g.bcsc"), _urgent(spark, d)
    csr.write_graph(g, path, "csc64")
    return csr.out_degrees(spark, path).select(F.col("place").alias("id"), F.col("value").alias("degree"))


def bel(spark, d):
    """The edges that the three files of pointers, targets and weights hold."""
    path, g = _place(spark, "g"), _urgent(spark, d)
    csr.write_bel(g, path)
    return csr.read_bel(spark, path).edges


def text_edges(spark, d):
    path = _place(spark, "edges")
    _urgent(spark, d).edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    return text.read_edges(spark, path)


def text_edge_statistics(spark, d):
    path = _place(spark, "edges")
    _urgent(spark, d).edges.select(F.concat_ws("\t", "src", "dst", "weight").alias("value")).write.text(path)
    return text.edge_statistics(text.read_edges(spark, path))


def _written(result: DataFrame, value: str, kind: str) -> DataFrame:
    path = _place(result.sparkSession, "values")
    text.write_values(result, value, path)
    lines = result.sparkSession.read.text(path).select(F.col("value").cast(kind).alias(value))
    return lines.groupBy(value).agg(F.count(F.lit(1)).alias("vertices"))


def level_file(spark, d):
    return _written(traversal.bfs(_urgent(spark, d), SOURCE), "level", "long")


def component_file(spark, d):
    return _written(weak_components(_urgent(spark, d)), "component", "long")


def distance_file(spark, d):
    """Unreached vertices as the largest unsigned number."""
    return _written(traversal.sssp(_urgent(spark, d), SOURCE, unreached="u64"), "dist", "string")


def rank_file_base_count(spark, d):
    """Lines of a file of ranks that say exactly the base."""
    path = _place(spark, "ranks")
    text.write_values(ranking.pagerank(_urgent(spark, d)), "rank", path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").cast("double") == ranking.BASE).alias("base"))


def _bfs_active(spark, d):
    g = _urgent(spark, d)
    return metrics.active_by_level(traversal.bfs(g, SOURCE), g.n), cache_plan.static_plan(g, FITS, FRAGMENT)


def _table(spark, rows: DataFrame, types: str, source: int) -> DataFrame:
    path = _place(spark, "metrics")
    for run in (0, 1):
        text.append_metrics(rows, path, "bfs", "orders", source, run)
    return spark.read.option("header", True).schema(f"algo string, dataset string, source long, run int, {types}").csv(path)


def cache_density_file(spark, d):
    rows = metrics.cache_density(*_bfs_active(spark, d))
    got = _table(spark, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), SOURCE)
    return _rounded(got, "per_iter_density", "per_iter_miss_rate")


def edge_path_file(spark, d):
    rows = metrics.edge_path(*_bfs_active(spark, d))
    got = _table(spark, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), -1)
    return _rounded(got, "per_iter_static_ratio")


def visit_file(spark, d):
    path = _place(spark, "visits")
    text.write_visits(*_bfs_active(spark, d), path)
    return text.read_visits(spark, path)


def _sssp_active(spark, d):
    return traversal.sssp(_urgent(spark, d), SOURCE, trace=True)[1].rows()


def active_sssp(spark, d):
    """How many vertices each round of shortest paths starts from, all renewed together."""
    return _sssp_active(spark, d).groupBy("iter").agg(F.count(F.lit(1)).alias("vertices"))


def cache_density_sssp(spark, d):
    plan = cache_plan.static_plan(_urgent(spark, d), FITS, FRAGMENT)
    return _rounded(metrics.cache_density(_sssp_active(spark, d), plan), "per_iter_density", "per_iter_miss_rate")


def edge_path_cc(spark, d):
    g = _urgent(spark, d)
    return _rounded(metrics.edge_path(spread_labels(g)[1].rows(), cache_plan.static_plan(g, FITS, FRAGMENT)), "per_iter_static_ratio")


def cc_labels_spread(spark, d):
    return spread_labels(_urgent(spark, d))[0]


def degree_above_id(spark, d):
    """The degree of vertices beyond an id, 0 for the others, and whether they are beyond."""
    rows = _urgent(spark, d).degrees()
    return rows.select("id", F.when(F.col("id") > ABOVE, F.col("degree")).otherwise(0).alias("degree"), (F.col("id") > ABOVE).alias("is_active"))


def static_plan_shifted(spark, d):
    """The resident range from the third fragment on."""
    return cache_plan.static_plan(_urgent(spark, d), FITS // 2, FRAGMENT, start=2 * FRAGMENT)


def advised_shares(spark, d):
    """The advised share of the room and the edges that fit, for some sizes of memory."""
    e, n = _urgent(spark, d).edges.count(), _urgent(spark, d).n
    from mesograph.functions.scalars import advised_ratio, edges_that_fit

    rows = [(m, edges_that_fit(m, 64, n, 16), round(advised_ratio(e, edges_that_fit(m, 64, n, 16)), 10)) for m in (200_000, 400_000, 800_000)]
    return spark.createDataFrame(rows, "memory long, fits long, share double")


def start_mean(spark, d):
    """The mean rank before the first round."""
    return _rounded(_urgent(spark, d).vertices.agg(F.avg(F.lit(ranking.BASE)).alias("mean_rank")), "mean_rank")


def idle_fragment_degrees(spark, d):
    """Edges, in the first fragment of their row, of the vertices that are idle in the second round."""
    active, plan = _bfs_active(spark, d)
    idle = plan.join(active.where("iter = 2").select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return metrics.fragment_visits(idle.select(F.lit(2).cast("long").alias("iter"), "id"), plan, FRAGMENT)


_NAMES = """pairs converted weights_added weights_dropped suffix_default file_out_degrees bel text_edges text_edge_statistics
level_file component_file distance_file rank_file_base_count cache_density_file edge_path_file visit_file
active_sssp cache_density_sssp edge_path_cc cc_labels_spread degree_above_id static_plan_shifted advised_shares start_mean idle_fragment_degrees""".split()
QUERIES = {f"layout_{name}": partial(layout, name) for name in LAYOUTS} | {name: globals()[name] for name in _NAMES}

# --- the same in DuckDB ----------------------------------------------------------------------------

_EDGES = f"WITH {_graph()} SELECT src, dst FROM e"
_WEIGHTED = f"WITH {_graph()} SELECT src, dst, weight FROM e"


def _rounds(start: str, step: str, both: bool = False) -> str:
    """Every improvement with the round it was made in: the vertices active in the next one."""
    edges = "(SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)" if both else "e"
    return f"""r(it, id, x) USING KEY (it, id) AS ({start} UNION
SELECT b.it, b.id, b.x FROM (SELECT r.it + 1 AS it, e.dst AS id, min({step}) AS x FROM r JOIN {edges} e ON r.id = e.src GROUP BY r.it, e.dst) b
LEFT JOIN (SELECT id, min(x) AS x FROM recurring.r GROUP BY id) o ON o.id = b.id WHERE o.x IS NULL OR b.x < o.x)"""


_SSSP_ROUNDS = _rounds(f"SELECT 1::BIGINT, {SOURCE}::BIGINT, 0::BIGINT", "r.x + e.weight")
_CC_ROUNDS = _rounds("SELECT 1::BIGINT, id, id FROM v", "r.x", both=True)
_A = "a AS (SELECT it AS iter, s.* FROM r JOIN s USING (id))"
_DENSITY_ROWS = f"iter, i AS active_in_cache, c AS active_total, c - i AS active_out_of_cache, k AS static_vertex_count, round({_RATIO.format('i', 'k')}, 10) AS per_iter_density, round({_RATIO.format('c - i', 'c')}, 10) AS per_iter_miss_rate FROM t"
_PATH_ROWS = f"iter, i AS edges_static, o AS edges_overload, round({_RATIO.format('i', '(i + o)')}, 10) AS per_iter_static_ratio FROM t"
_TWICE = "CROSS JOIN (SELECT unnest([0, 1]) AS run)"
_SSSP_DIST = f"WITH RECURSIVE {_graph()}, {_SSSP_ROUNDS}"
_FIT = f"greatest(0, m - 64 * (SELECT n FROM n)) // 16"
_SHIFT = f"(SELECT {2 * FRAGMENT} + least({FITS // 2}, (SELECT count(*) FROM e)) // {FRAGMENT} * {FRAGMENT})"

ORACLE_SQL = {f"layout_{name}": _WEIGHTED if form.weight else _EDGES for name, form in LAYOUTS.items()} | {
    "pairs": _EDGES,
    "converted": _EDGES,
    "weights_added": f"WITH {_graph()} SELECT src, dst, 1::BIGINT AS weight FROM e",
    "weights_dropped": _EDGES,
    "suffix_default": f"WITH {_graph()} SELECT count(*)::BIGINT AS edges, (SELECT n FROM n)::BIGINT AS vertices FROM e",
    "file_out_degrees": f"WITH {_graph()}, {_DEGREES.format('src')} SELECT * FROM d",
    "bel": _WEIGHTED,
    "text_edges": _EDGES,
    "text_edge_statistics": f"WITH {_graph()} SELECT count(*)::BIGINT AS edges, (max(greatest(src, dst)) + 1)::BIGINT AS vertices, min(src) AS min_source, max(src) AS max_source FROM e",
    "level_file": f"SELECT level, count(*)::BIGINT AS vertices FROM ({_bfs(_graph())}) GROUP BY level",
    "component_file": f"SELECT component, count(*)::BIGINT AS vertices FROM ({_cc(_graph())}) GROUP BY component",
    "distance_file": f"{_SSSP_DIST} SELECT dist, count(*)::BIGINT AS vertices FROM (SELECT v.id, coalesce(min(r.x)::VARCHAR, '18446744073709551615') AS dist FROM v LEFT JOIN r USING (id) GROUP BY v.id) GROUP BY dist",
    "rank_file_base_count": f"{_ranks(_graph())} SELECT count(*)::BIGINT AS lines, count(*) FILTER (x = 0.15)::BIGINT AS base FROM pr WHERE it = (SELECT it FROM f)",
    "cache_density_file": f"{_ACTIVE}, {_DENSITY} SELECT 'bfs' AS algo, 'orders' AS dataset, {SOURCE}::BIGINT AS source, run, {_DENSITY_ROWS} {_TWICE}",
    "edge_path_file": f"{_ACTIVE}, {_PATH} SELECT 'bfs' AS algo, 'orders' AS dataset, -1::BIGINT AS source, run, {_PATH_ROWS} {_TWICE}",
    "visit_file": f"{_ACTIVE} SELECT iter, id, ptr, degree FROM a",
    "active_sssp": f"WITH RECURSIVE {_graph()}, {_SSSP_ROUNDS} SELECT it AS iter, count(*)::BIGINT AS vertices FROM r GROUP BY it",
    "cache_density_sssp": f"WITH RECURSIVE {_graph()}, {_SSSP_ROUNDS}, {_static()}, {_A}, {_DENSITY} SELECT {_DENSITY_ROWS}",
    "edge_path_cc": f"WITH RECURSIVE {_graph()}, {_CC_ROUNDS}, {_static()}, {_A}, {_PATH} SELECT {_PATH_ROWS}",
    "cc_labels_spread": f"WITH RECURSIVE {_graph()}, {_CC} SELECT id, x AS component FROM r",
    "degree_above_id": f"WITH {_graph()}, {_DEGREES.format('src')} SELECT id, CASE WHEN id > {ABOVE} THEN degree ELSE 0 END AS degree, id > {ABOVE} AS is_active FROM d",
    "static_plan_shifted": f"WITH {_graph()}, {_static()} SELECT id, degree, ptr, ptr >= {2 * FRAGMENT} AND ptr < {_SHIFT} AND ptr + degree - 1 < {_SHIFT} AS is_static FROM s",
    "advised_shares": f"WITH {_graph()} SELECT m::BIGINT AS memory, f::BIGINT AS fits, round(CASE WHEN k < 0 THEN 0.5 ELSE least(k, 1.0) END, 10) AS share FROM (SELECT m, f, (10 - (SELECT count(*) FROM e)::DOUBLE / f) / 9 AS k FROM (SELECT m, {_FIT} AS f FROM (SELECT unnest([200000, 400000, 800000]) AS m)))",
    "start_mean": "SELECT 0.15::DOUBLE AS mean_rank",
    "idle_fragment_degrees": f"{_ACTIVE} SELECT ptr // {FRAGMENT} AS fragment, sum(least(degree, (ptr // {FRAGMENT} + 1) * {FRAGMENT} - ptr))::BIGINT AS visits FROM s WHERE degree > 0 AND id NOT IN (SELECT id FROM a WHERE iter = 2) GROUP BY 1",
}
