"""Binary graph files as a Spark data source, and their writers.

spark.read.format("csrgraph").option("layout", ...).load(path) gives (src, dst[, weight]). A partition is a range of
edges, not of vertices, so one vertex with very many edges is read by many tasks; each finds its first row by
bisecting the pointers. Writers sort edges by range partitioning, turn each partition to bytes on the
executors, and write them there, each at its own place of the one file (places follow from the counts), if all see its
path: under a local master, or where the caller says so (``shared=True``). Into other stores, whose files can only
be appended to, the driver writes one block after another and holds one at a time; all bytes then pass through it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mesograph.graph import Graph
from mesograph.plans.durable import durable
from mesograph.sources.layouts import LAYOUTS, Layout, by_suffix

BATCH = 1 << 16
#: Bytes of edges that a task reads at most, and the least for which a file is cut at all.
PART, SMALL = 128 << 20, 1 << 20
PAIR = np.dtype([("src", "<u4"), ("dst", "<u4")])


def _open(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def _longs(values: np.ndarray) -> pa.Array:
    if values.dtype.itemsize == 8 and len(values) and int(values.max()) >= 1 << 63:
        raise ValueError("a number over 2^63 - 1")
    return pa.array(values.astype(np.int64))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    def __init__(self, options: dict, weighted: bool):
        self.path = options.get("path")
        self.layout = options.get("layout") or by_suffix(self.path)
        self.parts = int(options.get("partitions") or 0)
        self.default = int(options.get("defaultweight", 1))
        self.weighted = weighted

    def _header(self, file) -> tuple[int, int]:
        if self.layout == "pairs":
            if file.size() % PAIR.itemsize:
                raise ValueError(f"{self.path}: not a whole number of pairs")
            return 0, file.size() // PAIR.itemsize
        layout = LAYOUTS[self.layout]
        raw = file.read_at(2 * layout.head, 0)
        if len(raw) < 2 * layout.head:
            raise ValueError(f"{self.path}: shorter than its header")
        v, e = (int(x) for x in np.frombuffer(raw, dtype=f"<u{layout.head}"))
        if file.size() != layout.size(v, e):
            raise ValueError(f"{self.path}: {file.size()} bytes, but {v} vertices and {e} edges take {layout.size(v, e)} as {self.layout}")
        return v, e

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as file:
            _, e = self._header(file)
        size = e * (PAIR.itemsize if self.layout == "pairs" else LAYOUTS[self.layout].edge.itemsize)
        # by the bytes: a part for each PART, but some for middling files
        parts = self.parts or max(1, -(-size // PART), min(8, size // SMALL))
        cuts = [e * k // parts for k in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as file:
            v, e = self._header(file)
            for first in range(part.first, part.last, BATCH):
                last = min(first + BATCH, part.last)
                yield self._pairs(file, first, last) if self.layout == "pairs" else self._rows(file, LAYOUTS[self.layout], v, e, first, last)

    def _batch(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None) -> pa.RecordBatch:
        columns = [_longs(src), _longs(dst)]
        if self.weighted:
            columns.append(_longs(weight if weight is not None else np.full(len(src), self.default, dtype=np.int64)))
        return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "weight"][: len(columns)])

    def _pairs(self, file, first: int, last: int) -> pa.RecordBatch:
        rows = np.frombuffer(file.read_at((last - first) * PAIR.itemsize, first * PAIR.itemsize), dtype=PAIR)
        return self._batch(rows["src"], rows["dst"], None)

    def _rows(self, file, layout: Layout, v: int, e: int, first: int, last: int) -> pa.RecordBatch:
        at, width = layout.pointers_at(v), layout.head
        pointer = lambda i: int.from_bytes(file.read_at(width, at + i * width), "little") if i < v else e
        low, high = 0, v  # the last row that begins at or before ``first``
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if pointer(mid) <= first else (low, mid)
        row = np.empty(last - first, dtype=np.int64)
        done, r = first, low
        while done < last:
            begins = np.frombuffer(file.read_at(min(BATCH, v - r) * width, at + r * width), dtype=f"<u{width}").astype(np.int64)
            ends = np.append(begins[1:], pointer(r + len(begins)))
            if not len(begins) or begins[0] > done or (np.diff(np.append(begins, ends[-1])) < 0).any():
                raise ValueError(f"{self.path}: row pointers aren't in order near row {r}")
            stop = min(last, int(ends[-1]))
            if stop > done:
                row[done - first : stop - first] = r + np.searchsorted(ends, np.arange(done, stop), side="right")
            done, r = max(done, stop), r + len(begins)
        edges = np.frombuffer(file.read_at((last - first) * layout.edge.itemsize, layout.edges_at(v) + first * layout.edge.itemsize), dtype=layout.edge)
        weight = edges["weight"] if layout.weight else None
        return self._batch(edges["to"], row, weight) if layout.by_target else self._batch(row, edges["to"], weight)


class CsrSource(DataSource):
    """Options: layout (default: by suffix), weights (auto, drop, or add), defaultWeight, partitions."""

    @classmethod
    def name(cls) -> str:
        return "csrgraph"

    def _weighted(self) -> bool:
        layout = self.options.get("layout") or by_suffix(self.options["path"])
        has = layout in LAYOUTS and bool(LAYOUTS[layout].weight)
        return {"auto": has, "drop": False, "add": True}[self.options.get("weights", "auto")]

    def schema(self) -> str:
        return "src long, dst long" + (", weight long" if self._weighted() else "")

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options), "weight" in schema.names)


def read_graph(spark: SparkSession, path: str, layout: str | None = None, weights: str = "auto", partitions: int | None = None) -> Graph:
    """The graph of a file. weights: auto keeps what there is, drop takes them off, add puts 1 where there are none."""
    layout = layout or by_suffix(path)
    spark.dataSource.register(CsrSource)
    edges = spark.read.format("csrgraph").option("layout", layout).option("weights", weights).option("partitions", partitions or 0).load(path)
    if layout == "pairs":
        return Graph.of(edges)
    with _open(path) as file:
        n, _ = CsrReader({"path": path, "layout": layout}, False)._header(file)
    return Graph(edges, n)


def _packed(kind: np.dtype, batch: pa.RecordBatch) -> bytes:
    out = np.empty(batch.num_rows, dtype=kind)
    for k, name in enumerate(kind.names):
        values = batch.column(k).to_numpy(zero_copy_only=False)
        if len(values) and (values.min() < 0 or kind[name].itemsize < 8 and values.max() >= 1 << 8 * kind[name].itemsize):
            raise ValueError(f"{name} doesn't fit {kind[name].itemsize} bytes")
        out[name] = values
    return out.tobytes()


def _blocks(rows: DataFrame, kind: np.dtype) -> Iterator[bytes]:
    """The sorted rows' bytes, made on the executors, partition after partition."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(kind, batch)], pa.binary())], names=["b"])

    for row in rows.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
        yield bytes(row["b"])


def _in_place(rows: DataFrame, kind: np.dtype, path: str, at: int) -> int:
    """Writes the sorted rows' bytes into an existing file from byte ``at`` on, each partition by its own task; the end."""
    rows = durable(rows)  # so that partitions are the same when they are counted and when they are written
    counted = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, end = {}, at
    for p in sorted(counted):
        starts[p], end = end, end + counted[p] * kind.itemsize

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = starts.get(TaskContext.get().partitionId()), 0
        if place is not None:
            with open(path, "r+b") as file:
                file.seek(place)
                for batch in batches:
                    done += file.write(_packed(kind, batch))
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    done = rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if at + done != end:
        raise OSError(f"{path}: {done} bytes written, {end - at} expected")
    return end


def _write(path: str, head: np.ndarray, parts: list[tuple[DataFrame, np.dtype]], spark: SparkSession, shared: bool) -> None:
    """One file: the header's numbers, then the rows of each part."""
    if "://" not in path and (shared or spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")):
        with open(path, "wb") as file:
            file.write(head.tobytes())
        at = head.nbytes
        for rows, kind in parts:
            at = _in_place(rows, kind, path, at)
        return
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(place) as out:
        out.write(head.tobytes())
        for rows, kind in parts:
            for block in _blocks(rows, kind):
                out.write(block)


def _number(width: int) -> np.dtype:
    return np.dtype([("x", f"<u{width}")])


def write_graph(graph: Graph, path: str, layout: str, shared: bool = False) -> None:
    """One file of the layout. Rows are in order of the other end; missing weights are 1."""
    form = LAYOUTS[layout]
    row, to = ("dst", "src") if form.by_target else ("src", "dst")
    if form.weight:
        graph = graph.with_weights()
    columns = [to, *(["weight"] if form.weight else [])]
    parts = [(graph.degrees("src").orderBy("id").select("degree"), _number(4))] if form.by_target else []
    parts += [(graph.offsets(row).orderBy("id").select("ptr"), _number(form.head)), (graph.edges.orderBy(row, *columns).select(*columns), form.edge)]
    _write(path, np.array([graph.n, graph.edges.count()], dtype=f"<u{form.head}"), parts, graph.spark, shared)


def write_pairs(graph: Graph, path: str, shared: bool = False) -> None:
    """Headerless (u32, u32) pairs."""
    _write(path, np.zeros(0, dtype="<u8"), [(graph.edges.orderBy("src", "dst").select("src", "dst"), PAIR)], graph.spark, shared)


def write_bel(graph: Graph, path: str, shared: bool = False) -> None:
    """Three files, path.col, .dst and .val, each a count, a zero and its numbers: pointers, targets, weights."""
    graph = graph.with_weights()
    edges, e = graph.edges.orderBy("src", "dst", "weight"), graph.edges.count()
    for name, rows, width, n in (("col", graph.offsets().orderBy("id").select("ptr"), 8, graph.n), ("dst", edges.select("dst"), 8, e), ("val", edges.select("weight"), 4, e)):
        _write(f"{path}.{name}", np.array([n, 0], dtype="<u8"), [(rows, _number(width))], graph.spark, shared)


def read_numbers(spark: SparkSession, path: str, width: int, skip: int = 16, n: int | None = None) -> DataFrame:
    """(place, value) of ``n`` (or all) unsigned numbers of a file after ``skip`` bytes. Each task reads its own bytes."""
    if n is None:
        with _open(path) as file:
            n = (file.size() - skip) // width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as file:
            for batch in batches:
                for first in batch.column("id").to_pylist():
                    last = min(n, first + BATCH)
                    values = np.frombuffer(file.read_at((last - first) * width, skip + first * width), dtype=f"<u{width}")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), _longs(values)], names=["place", "value"])

    return spark.range(0, n, BATCH).mapInArrow(run, "place long, value long")


def out_degrees(spark: SparkSession, path: str, layout: str = "csc64") -> DataFrame:
    """(place, value): the out-degree block of a file by targets."""
    with _open(path) as file:
        n, _ = CsrReader({"path": path, "layout": layout}, False)._header(file)
    return read_numbers(spark, path, 4, 2 * LAYOUTS[layout].head, n)


def read_bel(spark: SparkSession, path: str) -> Graph:
    """The weighted graph of three files, path.col, .dst and .val. Edges are joined with their sources and weights by their place."""
    sizes = {}
    for name in ("col", "dst", "val"):
        with _open(f"{path}.{name}") as file:
            sizes[name] = int.from_bytes(file.read_at(8, 0), "little")
    if sizes["dst"] != sizes["val"]:
        raise ValueError(f"{path}: {sizes['dst']} targets, but {sizes['val']} weights")
    rows = read_numbers(spark, f"{path}.col", 8).select(F.col("place").alias("src"), F.col("value").alias("ptr"))
    ends = read_numbers(spark, f"{path}.col", 8).select((F.col("place") - 1).alias("_before"), F.col("value").alias("_next"))
    rows = rows.join(ends, F.col("src") == F.col("_before"), "left").withColumn("end", F.coalesce("_next", F.lit(sizes["dst"])))
    rows = rows.where("end > ptr").select("src", F.explode(F.sequence("ptr", F.col("end") - 1)).alias("_at"))
    targets = read_numbers(spark, f"{path}.dst", 8).toDF("place", "dst")
    weights = read_numbers(spark, f"{path}.val", 4).toDF("_place", "weight")
    edges = targets.join(weights, F.col("place") == F.col("_place")).join(rows, F.col("place") == F.col("_at"))
    return Graph(edges.select("src", "dst", "weight"), sizes["col"])


def convert(spark: SparkSession, path: str, into: str, layout: str, from_layout: str | None = None) -> None:
    """One layout to another: strips, adds or keeps weights, widens or narrows."""
    write_graph(read_graph(spark, path, from_layout, "auto" if LAYOUTS[layout].weight else "drop"), into, layout)


def hashed_weights(graph: Graph, below: int = 20) -> Graph:
    """The graph with weights 0..below-1 that depend on the edge alone."""
    return Graph(graph.edges.select("src", "dst", F.pmod(F.xxhash64("src", "dst"), F.lit(below)).alias("weight")), graph.n)
