"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has eight bytes. Two that differ in at most ``bits`` = 4 bits differ in at most four
bytes, so they share at least four bytes at their positions, the guaranteed minimum, and ``probe`` of them lie among the
first 4 + probe positions. The index has a posting for each choice of ``probe`` of those positions and the bytes there:
single positions have 256 postings each, which no large corpus can pair up. A pair's shared positional bytes are
tallied where it meets, from the two fingerprints (shuffling a row for each posting that a pair shares would give the same
number); pairs that met by chance and are under the minimum go, and the rest is verified bit by bit.

Exact copies are one fingerprint and never pairs. Dense groups of different fingerprints aren't paired
with each other either: first each posting, in order, links only neighbours, and those links are
contracted to components; then only postings that still hold two or more components are joined,
across components only. A link inside a component adds nothing to the components, so none is lost.

Defined results: null and empty text have fingerprint zero, linked like any other; null ids never are
a component's id unless all are null; repeated rows give a row each; an empty table gives an empty one;
other columns are ignored by ``near_duplicates`` and kept by ``one_of_each``, whatever their names. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import LOWER_TABLE, durable, join_groups, pieces, table, utf8, where_id

SHINGLE, BITS, SEED = 4, 4, 42
BYTES = 8
#: Up to so many different fingerprints a posting key has three bytes, beyond them four: N / 256**3 chance
#: meetings in a posting. Either gives the same links.
MANY = 1 << 27
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64 bits, unsigned. Hashes are counted in blocks, so a very long text needs little more memory than its words."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the bits as a signed long), one row a document."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - position)).bitwiseAND(255)


def keys(fps: DataFrame, bits: int, probe: int) -> DataFrame:
    """(key, node): the postings of each fingerprint ``fp``, one for each choice of positions."""
    out = []
    for n, chosen in enumerate(combinations(range(bits + probe), probe)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), i))
        out.append(key)
    return fps.select(F.explode(F.array(*out)).alias("key"), F.col("fp").alias("node"))


def components(fps: DataFrame, bits: int = BITS, probe: int = 3) -> DataFrame:
    """(fp, label) for the different fingerprints ``fps`` (fp) that link to another: one label a component."""
    if not 0 <= bits < BYTES or not 1 <= probe <= BYTES - bits:
        raise ValueError("bits must be under 8 and probe from 1 to 8 - bits")

    def near(a: str, b: str) -> Column:
        both = F.col(a).bitwiseXOR(F.col(b))
        tally = sum((_byte(both, i) == 0).cast("int") for i in range(BYTES))
        return (tally >= BYTES - bits) & (F.bit_count(both) <= bits)

    met = postings.meetings(keys(fps, bits, probe))
    first = postings.components(met.where(F.col("before").isNotNull() & near("node", "before")).select(F.col("node").alias("a"), F.col("before").alias("b")).distinct())
    pairs = postings.across(postings.still_open(met, first), near("a", "b"))
    second = postings.components(pairs.toDF("a", "b")).toDF("_id", "_c")
    top = first.toDF("id", "label").unionByName(second.select(F.col("_id").alias("id"), F.col("_id").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
    return top.join(second, F.col("label") == F.col("_id"), "left").select(F.col("id").alias("fp"), F.coalesce("_c", "label").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, probe: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row a document. probe None: by how many fingerprints there are."""
    made = durable(fingerprints(docs, doc_id, text))
    least = durable(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    probe = probe or min(BYTES - bits, 3 if least.count() <= MANY else 4)
    linked = durable(components(least.select("fp"), bits, probe).withColumnRenamed("fp", "_fp").join(least, F.col("_fp") == F.col("fp")).select("fp", "label", "least"))
    # a component may have very many fingerprints: minima are partial, and the way back is salted
    whole = durable(linked.groupBy("label").agg(F.min("least").alias("component_id")))
    by_fp = join_groups(linked, whole, ["label"], F.col("fp")).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_c"))
    by_fp = durable(least.join(by_fp, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("_c", "least").alias("component_id")))
    out = made.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are their component's least id; rows that repeat that id give one row."""
    return least_of_each(docs, near_duplicates(docs, doc_id, text), doc_id)


def least_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are their component's least id, by ``found`` (doc_id, component_id)."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = durable(found.groupBy("doc_id").agg(F.count_if(stays).alias("n")))
    kept = where_id(docs, doc_id, durable(by_id.where("n = 0").select("doc_id")), inside=False)
    return kept if by_id.where("n > 1").isEmpty() else kept.dropDuplicates([doc_id])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
