"""python -m mesograph.cli --input FILE --type bfs|cc|sssp|pr ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from mesograph.functions.scalars import dataset_name, edges_that_fit
from mesograph.operators import metrics, ranking, traversal, verify
from mesograph.operators.components import spread_labels, weak_components
from mesograph.plans.cache_plan import FRAGMENT, static_plan
from mesograph.sources.csr import read_graph
from mesograph.sources.text import append_metrics, write_values, write_visits

#: State of a vertex beside its edges: value, degree, pointer, and flags, in whole words.
VERTEX_BYTES = 64
VALUE = {"bfs": "level", "sssp": "dist", "cc": "component", "pr": "rank"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mesograph")
    p.add_argument("--input", required=True)
    p.add_argument("--layout", help="byte layout of the input; by suffix if not given")
    p.add_argument("--type", choices=list(VALUE), default="bfs")
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--testTime", type=int, default=1, help="repetitions; each has the next of evenly spaced sources")
    p.add_argument("--model", type=int, choices=(0, 7), default=7, help="how the resident prefix is planned: 7 as much as fits, 0 the advised share; never changes a result")
    p.add_argument("--adviseK", type=float, help="share of the edge budget that the resident prefix takes, whatever the model")
    p.add_argument("--gpuMemory", type=float, help="gigabytes for the vertices' state and the resident edges, instead of --edgeBudget")
    p.add_argument("--edgeBudget", type=int, default=1 << 20, help="edges that fit beside the vertices' state")
    p.add_argument("--fragment", type=int, default=FRAGMENT)
    p.add_argument("--verify", action="store_true")
    p.add_argument("--cache_csv")
    p.add_argument("--path_csv")
    p.add_argument("--visits", help="folder for tab-separated lines: round, vertex, first edge, degree of who was active")
    p.add_argument("--output", help="folder for one value a line, in vertex order")
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    """What was measured: seconds of each repetition, rounds, and the checks' figures if asked for."""
    a = parser().parse_args(argv)
    graph = read_graph(spark, a.input, a.layout, "add" if a.type == "sssp" else "drop")
    sources = traversal.spaced_sources(graph.n, a.source, a.testTime) if a.type in ("bfs", "sssp") else [a.source] * a.testTime
    report: dict = {"type": a.type, "input": a.input, "vertices": graph.n, "sources": sources, "seconds": []}
    fits = a.edgeBudget if a.gpuMemory is None else edges_that_fit(int(a.gpuMemory * 2**30), VERTEX_BYTES, graph.n, 16 if graph.weighted else 8)
    share = a.adviseK or (1.0 if a.model == 7 else None)
    plan = static_plan(graph.reversed() if a.type == "pr" else graph, fits, a.fragment, share) if a.cache_csv or a.path_csv or a.visits else None
    for k, source in enumerate(sources):
        began, active = time.time(), None
        if a.type == "bfs":
            result, log = traversal.bfs(graph, source, trace=True)
            report["rounds"], report["node_sum"] = log.rounds, log.node_sum
            active = metrics.active_by_level(result, graph.n)
        elif a.type == "sssp":
            result, log = traversal.sssp(graph, source, trace=True)
            report["rounds"], report["node_sum"] = log.rounds, log.node_sum
            active = log.rows()
        elif a.type == "cc":
            result = weak_components(graph)
            if plan is not None:  # who is active is a matter of passing labels round by round
                _, log = spread_labels(graph)
                report["rounds"], report["node_sum"], active = log.rounds, log.node_sum, log.rows() if log.frames else None
        else:
            result, moves = ranking.pagerank(graph, trace=True)
            report["rounds"], report["max_diff"] = len(moves), moves[-1] if moves else None
            active = metrics.active_always(graph.vertices, len(moves))
        result = result.persist()
        report["rows"] = result.count()
        report["seconds"].append(round(time.time() - began, 3))
        if a.type != "cc":
            report.setdefault("round_seconds", []).append(round(report["seconds"][-1] / max(1, report["rounds"]), 4))
        if plan is not None and active is not None:
            of = source if a.type in ("bfs", "sssp") else -1
            if a.cache_csv:
                append_metrics(metrics.cache_density(active, plan), a.cache_csv, a.type, dataset_name(a.input), of, k)
            if a.path_csv:
                append_metrics(metrics.edge_path(active, plan), a.path_csv, a.type, dataset_name(a.input), of, k)
            if a.visits:
                write_visits(active, plan, f"{a.visits}/run={k}")
        if a.verify:
            check = {"bfs": lambda: verify.check_bfs(graph, source, result), "sssp": lambda: verify.check_sssp(graph, source, result), "cc": lambda: verify.check_components(graph, result), "pr": lambda: verify.check_pagerank(graph, result)}[a.type]()
            found = check.first().asDict()
            if a.type == "sssp":
                found |= verify.compare_sssp(graph, source, result).first().asDict()
            elif a.type == "pr":
                found |= verify.compare_pagerank(graph, result).first().asDict()
            report["verify"] = found
            report["passed"] = report.get("passed", True) and not any(found.values())
        if a.output and k == len(sources) - 1:
            write_values(result, VALUE[a.type], a.output)
        result.unpersist()
    report["mean_seconds"] = round(sum(report["seconds"]) / max(1, len(report["seconds"])), 3)
    return report


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("mesograph").getOrCreate()
    said = run(session, sys.argv[1:])
    print(said)
    sys.exit(0 if said.get("passed", True) else 1)
