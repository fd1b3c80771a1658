"""Scratch writes leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from dialogweave.llm.common import give_back, written


def _shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b.split("_")[1] for b in blocks.split(",") if b.startswith("shuffle_")}


def test_written_frees_its_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), _shuffles(spark)
    sums = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("total"))
    kept = written(sums.join(sums.withColumnRenamed("total", "again"), "k"), "sums")
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before and spark.conf.get(key) == setting
    assert kept.where("total = again").count() == 700 == sums.count()
    give_back(kept)
