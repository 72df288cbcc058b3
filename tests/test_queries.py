"""Every query with SQL against DuckDB on the smallest tables, and the entry module as a whole."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from mesograph.sources.layouts import LAYOUTS

DATA = "/root/testdata/sf0.001"
SQL = entry.graph_queries.ORACLE_SQL | entry.source_queries.ORACLE_SQL


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["bfs_levels", "bfs_events", "bfs_multi_source", "sssp_distances", "cc_fragmented", "pagerank", "symmetrize", "static_plan_advised", "cache_density_bfs", "edge_path_pr", "batch_plan", "needed_partitions_bfs", "chunk_visits_bfs", "verify_sssp_relaxable_edges",
    *(f"layout_{x}" for x in LAYOUTS), "pairs", "converted", "bel", "file_out_degrees", "text_edge_statistics", "visit_file", "cache_density_file", "cache_density_sssp", "edge_path_cc", "static_plan_shifted"])
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for p in Path(DATA).iterdir():
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    names, got = rows(entry.queries()[name](spark, DATA))
    found = connection.sql(SQL[name])
    order = [found.columns.index(n) for n in names]
    assert sorted(found.columns) == names
    assert got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) == set(entry.graph_queries.QUERIES) | set(entry.source_queries.QUERIES)
