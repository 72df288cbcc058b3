"""Round trips through every file layout."""

import numpy as np
import pytest

from mesograph import cli
from mesograph.graph import Graph
from mesograph.sources import csr, text
from mesograph.sources.layouts import LAYOUTS, by_suffix
from mesograph.streaming.edges import stream_degrees, stream_edges

EDGES = [(0, 1, 5), (1, 2, 0), (2, 0, 1), (2, 3, 3), (2, 3, 7), (3, 3, 2), (4, 5, 4)]  # vertices 5 and 6 have no out-edges


@pytest.fixture
def weighted(spark):
    return Graph(spark.createDataFrame(EDGES, "src long, dst long, weight long"), 7)


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_round_trip(spark, weighted, tmp_path, layout):
    path = str(tmp_path / "g.bin")
    csr.write_graph(weighted, path, layout)
    again = csr.read_graph(spark, path, layout, partitions=3)
    assert again.n == 7
    want = EDGES if LAYOUTS[layout].weight else [e[:2] for e in EDGES]
    assert sorted(tuple(r) for r in again.edges.collect()) == sorted(want)
    if LAYOUTS[layout].by_target:
        assert [r.value for r in csr.out_degrees(spark, path, layout).orderBy("place").collect()] == [1, 1, 3, 1, 1, 0, 0]


def test_bytes_of_a_layout(weighted, tmp_path):
    path = str(tmp_path / "g.bcsr")
    csr.write_graph(weighted.without_weights(), path, "csr32")
    assert np.fromfile(path, dtype="<u4").tolist() == [7, 7, 0, 1, 2, 5, 6, 7, 7, 1, 2, 0, 3, 3, 3, 5]


def test_weights_added_and_dropped(spark, weighted, tmp_path):
    path, other = str(tmp_path / "g.bwcsr"), str(tmp_path / "h.bcsr")
    csr.write_graph(weighted, path, "wcsr32")
    assert csr.read_graph(spark, path, weights="drop").edges.columns == ["src", "dst"]
    csr.convert(spark, path, other, "csr32")
    added = csr.read_graph(spark, other, weights="add").edges
    assert {r.weight for r in added.collect()} == {1}
    hashed = csr.hashed_weights(weighted).edges
    assert all(0 <= r.weight < 20 for r in hashed.collect())


def test_broken_files(spark, weighted, tmp_path):
    path = str(tmp_path / "g.bcsr")
    csr.write_graph(weighted.without_weights(), path, "csr32")
    with pytest.raises(ValueError):
        csr.read_graph(spark, path, "csr64")
    data = bytearray(open(path, "rb").read())
    data[8:12] = (6).to_bytes(4, "little")  # the first pointer
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="order"):
        csr.read_graph(spark, path).edges.collect()


def test_pairs_text_and_bel(spark, weighted, tmp_path):
    csr.write_pairs(weighted, str(tmp_path / "g.toB"))
    again = csr.read_graph(spark, str(tmp_path / "g.toB"))
    assert again.n == 6 and again.edges.count() == 7
    csr.write_bel(weighted, str(tmp_path / "g.bel"))
    assert np.fromfile(tmp_path / "g.bel.col", dtype="<u8").tolist() == [7, 0, 0, 1, 2, 5, 6, 7, 7]
    assert np.fromfile(tmp_path / "g.bel.val", dtype="<u4")[4:].tolist() == [5, 0, 1, 3, 7, 2, 4]
    (tmp_path / "t.txt").write_text("# comment\n0 1\n 1\t2 99\nx 3\n\n")
    assert sorted(tuple(r) for r in text.read_edges(spark, str(tmp_path / "t.txt")).collect()) == [(0, 1), (1, 2)]
    assert by_suffix("/x/a.bwcsr64") == "wcsr64" and by_suffix("/x/a") == "csr64"


def test_empty_graph(spark, tmp_path):
    path = str(tmp_path / "e.bcsr64")
    csr.write_graph(Graph(spark.createDataFrame([], "src long, dst long"), 3), path, "csr64")
    again = csr.read_graph(spark, path)
    assert again.n == 3 and again.edges.count() == 0


def test_command_line(spark, weighted, tmp_path):
    path = str(tmp_path / "g.bwcsr64")
    csr.write_graph(weighted, path, "wcsr64")
    for kind in ("bfs", "sssp", "cc", "pr"):
        said = cli.run(spark, ["--input", path, "--type", kind, "--verify", "--fragment", "1", "--edgeBudget", "4", "--cache_csv", str(tmp_path / "c"), "--path_csv", str(tmp_path / "p"), "--output", str(tmp_path / kind)])
        assert said["passed"] and said["rows"] == 7
    said = cli.run(spark, ["--input", path, "--model", "0", "--gpuMemory", "0.000001", "--testTime", "2", "--path_csv", str(tmp_path / "q")])
    assert len(said["seconds"]) == 2 and said["sources"] == [0, 3]
    levels = [r.value for r in spark.read.text(str(tmp_path / "bfs")).collect()]
    assert sorted(levels) == sorted(["1", "2", "3", "4", "8", "8", "8"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert rows.columns[:5] == ["algo", "dataset", "source", "run", "iter"] and {r.algo for r in rows.collect()} == {"bfs", "sssp", "cc", "pr"}


def test_streamed_degrees(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("0 1\n0 2\n1 2\n")
    query = stream_degrees(stream_edges(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    (folder / "b.txt").write_text("1 0\n")
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.degree for r in spark.table("degrees").collect()} == {0: 2, 1: 2}
