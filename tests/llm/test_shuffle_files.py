"""Shuffle files of written tables."""

import time

from pyspark.sql import functions as F

from rangeloom.llm.common import materialize


def test_shuffle_files_go_with_the_write(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in files.split() if "/shuffle_" in f and f.endswith(".data")}

    before = shuffles()
    table = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids")), "grouped")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
    assert table.agg(F.sum(F.size("ids"))).head()[0] == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
