"""What a step leaves on disk."""

import time

import pytest
from pyspark.sql import functions as F

from mesograph.plans.durable import CLEAN, durable


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffles_go_with_their_step(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
        rows = sums.join(spark.range(70).withColumnRenamed("id", "v_of").repartitionByRange(3, "v_of"), F.col("v_of") % 7 == F.col("k"))
        there, setting = shuffle_files(spark), spark.conf.get(CLEAN, "false")
        kept = durable(rows)
        end = time.time() + 20  # files are removed by threads of their own
        while (left := shuffle_files(spark) - there) and time.time() < end:
            time.sleep(0.1)
        assert not left and spark.conf.get(CLEAN, "false") == setting
        want = [(i, i % 7, sum(range(i % 7, 1000, 7))) for i in range(70)]
        for df in (kept, rows):  # the frame itself can still be used
            assert sorted((r.v_of, r.k, r.v) for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
