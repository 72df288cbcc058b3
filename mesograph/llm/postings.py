"""Who meets whom in an inverted index, without bringing a posting to one task.

Postings are range-partitioned by key and node and streamed in order, so a posting with very many nodes lies in
several partitions. Each row learns the node before it in its posting; rows that are alone in theirs go. The first
and the last row of a partition always stay, since their postings may go on in the next one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesograph.operators.components import star_components

from .common import durable, join_groups


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.zeros(0, dtype=bool)  # whether the row held back meets the one before it
    last, first = None, True

    def out(k: np.ndarray, v: np.ndarray, other: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(other, mask=~has)], names=["key", "node", "before"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # the last row of the batch before is held back until it is known who comes next
        key = np.concatenate([key, batch.column("key").to_numpy()])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        same = key[1:] == key[:-1]
        has = np.concatenate([before if len(before) else [False], same])
        other = np.concatenate([[last if last is not None else 0], node[:-1]]).astype(np.int64)
        keep = has[:-1] | same
        if first and len(keep):
            keep[0], first = True, False
        if keep.any():
            yield out(key[:-1][keep], node[:-1][keep], other[:-1][keep], has[:-1][keep])
        key, node, before, last = key[-1:], node[-1:], has[-1:], other[-1]
    if len(key):
        yield out(key, node, np.array([last], dtype=np.int64), before)


def meetings(posts: DataFrame) -> DataFrame:
    """(key, node, before) of the rows (key, node), both longs, that may meet another; before: the node that
    stands before it in the posting, or null."""
    ordered = posts.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return durable(ordered.mapInArrow(_stream, "key long, node long, before long"))


def labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label); ``labels``: (id, component) of some nodes, a node without one is its own."""
    return met.select("key", "node").join(labels, F.col("node") == F.col("id"), "left").select("key", "node", F.coalesce("component", "node").alias("label"))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, node, label) of the postings whose nodes have different labels."""
    several = rows.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("key")
    return durable(rows.join(several, "key", "left_semi"))


def still_open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the postings whose nodes have different labels; ``labels``: (id, component) of some nodes,
    a node without one is its own."""
    return mixed(labelled(met, labels))


def across(rows: DataFrame, near: Column) -> DataFrame:
    """(x, y): labels that pairs of nodes ``a`` and ``b`` of one posting join, by the condition ``near`` on both."""
    one, two = rows.toDF("key", "a", "x"), rows.toDF("key", "b", "y")
    return one.join(two, (one.key == two.key) & (F.col("x") < F.col("y")) & near).select("x", "y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the nodes that links (a, b) join."""
    return durable(star_components(links, "a", "b"))


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further links (a, b): only the labels that they join are contracted."""
    of = lambda side, to: labels.select(F.col("id").alias(f"_{side}"), F.col("component").alias(to))
    named = links.join(of("a", "x"), F.col("a") == F.col("_a"), "left").join(of("b", "y"), F.col("b") == F.col("_b"), "left")
    named = durable(named.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct())
    if named.isEmpty():
        return labels
    top = components(named)
    old = join_groups(labels, top.toDF("component", "_top"), ["component"], F.col("id"), "left").select("id", F.coalesce("_top", "component").alias("component"))
    # labels of nodes that had no link so far are the nodes themselves
    new = top.join(labels.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return durable(old.unionByName(new))
