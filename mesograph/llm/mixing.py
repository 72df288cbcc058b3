"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Sources in code point order, null last, take the weights in turn and share the
size of the whole corpus; a source's target stops at ``cap`` times its own size and what it leaves is
shared again by weight. A document is emitted floor(rate) times, rate = target / source size, plus
one Bernoulli copy with the fraction as its probability. The draw is a hash of the document's id and a
seed: reruns agree, another seed draws anew, and each document's draw is independent of the others'. So a
source's total comes near its target as such sums do: within a few times sqrt(f * (1 - f) * sum of size^2).

The only windows without a partition order the table of sources (one row a source), not of documents.

Defined results: null text has size 0; a source without words has rate 0; null ids hash as the empty
text; repeated ids draw alike; an empty table gives an empty one; other columns pass through ``mix``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, join_groups

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1): 52 bits of a SHA-256 of the id and the seed."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substr(F.sha2(said.cast("binary"), 256), F.lit(1), F.lit(13)), 16, 10).cast("double") / 2.0**52


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with weight, target and rate.

    One row a source, so the windows without a partition order a table of sources, not of documents.
    Sources by cap / weight: those before the first at which the level fits are held at their caps."""
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumn("_total", F.sum("source_size").over(whole)).withColumn("_weights", F.sum("weight").over(whole))
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("_level", left / rest).withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("weight"))
    first = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_level").alias("level")))).over(whole)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(first["level"] * F.col("weight"), F.col("_cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: str) -> Column:
    """floor(rate), and one more with the fraction as its probability."""
    return F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: source_size, weight, target and rate."""
    return durable(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken (words, repeats counted)."""
    sizes = sized(docs)
    rows = join_groups(sizes, plan(sizes, weights, cap), ["source"], F.col("doc_id"))
    rows = rows.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: each of the documents' rows as often as the mix takes it."""
    rate, copy = fresh(docs.columns, "rate", "copy")
    chosen = plan(sized(docs), weights, cap).select("source", F.col("rate").alias(rate))
    rows = join_groups(docs, chosen, ["source"], F.col("doc_id"))
    times = copies(F.col("doc_id"), F.col(rate), seed).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return taken(table(spark, sf_dir, "documents"))


#: The same shares, caps and draws in DuckDB.
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, {CAP} * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), l AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w
), f AS (
  SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * weight, cap::DOUBLE)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, floor(r.rate)::BIGINT + CASE WHEN d.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM c
"""
