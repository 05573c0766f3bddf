import time

from pyspark.sql import functions as F

from shelfwatch.llm import common


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_pin_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h")).repartition(5, "h")
    assert rows.count() == 1000  # own files, which its lineage may need again
    before, setting = shuffles(spark), spark.conf.get(common.SHUFFLE_CLEANUP, "false")
    written = common.pin(rows, "rows")
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:  # deleted in the background
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    assert written.count() == rows.count() == 1000 and common.pin(rows, "again").agg(F.sum("id")).first()[0] == 499500
