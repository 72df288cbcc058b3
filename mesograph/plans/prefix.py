"""Running sums over an ordered id without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a block. The table of block sums has one row for so many ids, so its own window stays small.
BLOCK = 1 << 16


def exclusive_sum(rows: DataFrame, order: str, value: str, into: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of smaller ``order`` (of the same ``by``, if given).

    Sums inside blocks of ids, plus the running sum of the blocks before."""
    by = by or []
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    sums = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col("_block") == F.col("_b"), *(F.col(c) == F.col(f"_{c}") for c in by)]
    return rows.join(starts, same).withColumn(into, F.col("_start") + F.col("_in")).drop("_block", "_b", "_start", "_in", *(f"_{c}" for c in by))
