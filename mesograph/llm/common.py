"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesograph.plans.durable import durable  # noqa: F401

#: White space between words: space and \t \n \v \f \r. A fixed value of the contracts.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes.translate table for the lower case of A-Z only.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str) -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like ``names`` that none of the columns has (Spark compares names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of one column, so that what is made of a slice stays small."""
    for batch in batches:
        sizes = batch.column(column)
        start = total = 0
        for i, value in enumerate(sizes):
            total += len(value.as_buffer()) if value.is_valid else 0
            if total >= most:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once a row, even where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A side of a join is broadcast only if it has been counted and holds no more than this.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20
SALTS = 64


def few(groups: DataFrame, keys: list[str]) -> bool:
    """Whether the groups, counted, are within BROADCAST_ROWS and BROADCAST_BYTES."""
    text = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text + 200), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_BYTES


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, how: str = "inner", small: bool | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a key, already durable); null keys match.

    Few groups are broadcast; ``small`` says so where they, or a table that has all of them, have been counted before.
    Otherwise each group is repeated SALTS times and a hot key's rows are dealt over SALTS tasks by ``spread``.
    What ``groups`` adds must have names that ``rows`` doesn't; names used in between are chosen so."""
    small = few(groups, keys) if small is None else small
    *theirs, salt, their_salt = fresh([*rows.columns, *groups.columns], *(f"_g_{k}" for k in keys), "_salt", "_g_salt")
    other = groups.withColumnsRenamed(dict(zip(keys, theirs, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)]
    if small:
        joined = rows.join(F.broadcast(other), same, how)
    else:
        salted = other.withColumn(their_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, [*same, F.col(salt) == F.col(their_salt)], how).drop(salt, their_salt)
    return joined.drop(*theirs)


#: A list of 64-bit ids is broadcast only if it has been counted and has no more than this: some 16 MB.
BROADCAST_IDS = 500_000


def where_id(docs: DataFrame, doc_id: str, ids: DataFrame, inside: bool) -> DataFrame:
    """The rows whose id is in ``ids`` (one column, durable, each once; null equals null), or isn't.

    Few ids are broadcast, so that texts needn't be shuffled; more are joined by a shuffle, which skew may split."""
    (name,) = fresh(docs.columns, "_id")
    ids = ids.toDF(name)
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(some, F.col(doc_id).cast("long").eqNullSafe(F.col(name)), "left_semi" if inside else "left_anti")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, most_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text as bytes, y) of labelled documents of each class outside the held-out fold, in the order of a hash of
    their ids, and how many labels of each class there are.

    The sample's bounds: ``per_class`` documents of each class, which also bounds the id list that is broadcast, and, of
    these, as many as have ``most_bytes`` of text a class (the first of them always)."""
    y = F.col(label)
    known = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held_out))
    known = durable(known.groupBy("doc_id").agg(F.max(y).alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = durable(chosen[0].unionByName(chosen[1])).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    sized = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(sized), F.lit(0))).where(F.col("_before") <= most_bytes)
    return rows.select("doc_id", "text", "y"), counts
