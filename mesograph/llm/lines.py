"""Line dedup: a line that several documents hold stays only in the document with the least id.

1. Each slice of documents hashes its lines' keys to 128 bits. Within the slice only the least
   document with a hash stays a candidate; the others' positions are dropped at once. So a line that a
   third of all documents hold sends one row a slice to the shuffle, not one a document.
2. Candidates are range-partitioned by hash and sorted by hash, document and position. Each partition is
   streamed: the first document of a hash keeps its lines, the rest lose theirs.
3. The positions come together per document as a compressed keep bitmap. No text is in any of these
   shuffles.

Defined results: null text is one empty line; a null id is the largest id; rows with the same id are one
document, and each is judged by its own text; keys shorter than ``LEAST`` code points stay; an empty
table gives an empty one; other columns pass through ``dedup_lines``, whatever their names. Ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import LOWER_TABLE, durable, fresh, pieces, table, utf8

LEAST = 10
SLICE = 16 << 20
STRIP = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1

_MARKS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.list_(pa.int32()))])
_LOST = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.list_(pa.int32()))])


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None where it is too short."""
    key = line.strip(STRIP)
    if len(key) < LEAST or not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return key.translate(LOWER_TABLE)


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its lines, and positions dropped already) and one for each candidate."""
    digest = xxhash.xxh3_128_digest
    for batch in pieces(batches, "text", SLICE):
        docs = batch.column("doc").to_pylist()
        hashes = batch.column("text_hash").to_pylist()
        counts, dropped, first = [], [[] for _ in docs], {}
        for r, (doc, text) in enumerate(zip(docs, batch.column("text").to_pylist(), strict=True)):
            lines = text.split(b"\n")
            counts.append(len(lines))
            for i, line in enumerate(lines):
                if (key := line_key(line)) is None:
                    continue
                at = digest(key)
                seen = first.get(at)
                if seen is None:
                    first[at] = [doc, [(r, i)]]
                elif seen[0] == doc:
                    seen[1].append((r, i))
                elif seen[0] < doc:
                    dropped[r].append(i)
                else:
                    for row, place in seen[1]:
                        dropped[row].append(place)
                    first[at] = [doc, [(r, i)]]
        n = len(docs)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int32()), pa.array(dropped, pa.list_(pa.int32()))], schema=_MARKS)
        keys, rows, places = [], [], []
        for at, (_, held) in first.items():
            own: dict[int, list[int]] = {}
            for r, i in held:
                own.setdefault(r, []).append(i)
            for r, some in own.items():
                keys.append(at)
                rows.append(r)
                places.append(some)
        if keys:
            halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array([docs[r] for r in rows], pa.int64()), pa.array([hashes[r] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int32()), pa.array(places, pa.list_(pa.int32()))], schema=_MARKS)


def _losers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document, those that aren't of their hash's first document."""
    last, keeper = (None, None), None
    for batch in batches:
        lost = []
        keys = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)
        for r, (key, doc) in enumerate(zip(keys, batch.column("doc").to_pylist(), strict=True)):
            if key != last:
                last, keeper = key, doc
            elif doc != keeper:
                lost.append(r)
        if lost:
            rows = batch.take(pa.array(lost, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(c.name) for c in _LOST], schema=_LOST)


def pack(n_lines: int, dropped: list[int]) -> bytes:
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("n_lines").to_pylist()
        lost = [sorted({i for some in many for i in some}) for many in batch.column("pos").to_pylist()]
        columns = [batch.column("doc"), batch.column("text_hash"), batch.column("n_lines").cast(pa.int64()), pa.array(map(len, lost), pa.int64()), pa.array(map(pack, lines, lost), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "n_lines", "n_dropped", "bitmap"])


def _keys(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, text_hash, n_lines, n_dropped, bitmap: one row for each id and text (LAST: a null id)."""
    keyed = docs.select(*_keys(doc_id, text), utf8(text).alias("text"))
    marks = durable(keyed.mapInArrow(_marks, "h1 long, h2 long, doc long, text_hash long, n_lines int, pos array<int>"))
    ordered = marks.where("h1 is not null").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
    lost = ordered.mapInArrow(_losers, "doc long, text_hash long, n_lines int, pos array<int>")
    known = marks.where("h1 is null").select("doc", "text_hash", "n_lines", "pos")
    grouped = known.unionByName(lost).groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("pos"))
    return grouped.mapInArrow(_bitmaps, "doc long, text_hash long, n_lines long, n_dropped long, bitmap binary")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their remaining lines as text, and n_lines (before) and n_dropped (with a ``_``
    added where the caller has columns of these names).

    Only documents that lose a line have a row on the other side of the join, and only their texts go to Python;
    the join sorts and may spill, and adaptive execution may split it."""

    @pandas_udf("string")
    def kept(texts, bitmaps, counts):
        import pandas as pd

        out = []
        for t, b, n in zip(texts, bitmaps, counts, strict=True):
            out.append(None if t is None else "\n".join(x for x, k in zip(t.split("\n"), unpack(b, int(n)), strict=True) if k))
        return pd.Series(out, dtype=object)

    maps = keep_bitmaps(docs, doc_id, text).where("n_dropped > 0").withColumnsRenamed({"doc": "m_doc", "text_hash": "m_hash"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(doc_id, text))
    joined = rows.join(maps, (F.col("doc") == F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash")), "left")
    whole, lost = F.coalesce(F.col("row")[text], F.lit("")), F.col("bitmap").isNotNull()
    counted = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    left = F.coalesce(kept(F.when(lost, whole), "bitmap", "n_lines"), whole)
    joined = joined.select("row", left.alias("kept"), counted.alias("lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("lost"))
    n_lines, n_dropped = fresh(docs.columns, "n_lines", "n_dropped")
    columns = [F.col("kept" if c == text else f"row.{c}").alias(c) for c in docs.columns]
    return joined.select(*columns, F.col("lines").alias(n_lines), F.col("lost").alias(n_dropped))


def op9_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM k LEFT JOIN s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
