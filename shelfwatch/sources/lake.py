"""The date-partitioned data lake of crawl rows."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwatch.schemas import LAKE_ROW


# Messages that the stream could not take, as they came.
REJECTED = "urlId string, html string, timestamp timestamp, reason string, date date"


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """All days. The schema is given, so no file is opened to infer it; folders of batches are no column."""
    return spark.read.schema(LAKE_ROW).parquet(root).select(*LAKE_ROW.fieldNames())


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REJECTED).parquet(root).select("urlId", "html", "timestamp", "reason", "date")


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """One micro-batch of dated rows into ``path``, in folders ``date=.../batch=<number>``; done again, it replaces itself.

    Only the folders of this batch are replaced. The same messages have the same dates, so a repeated batch meets
    exactly the folders it wrote before.
    """
    (rows.withColumn("batch", F.lit(number)).hint("rebalance", F.col("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path))


def _has_commit_log(spark: SparkSession, root: str) -> bool:
    """Whether a stream wrote the lake; readers of its root then see finished batches only."""
    try:
        spark.read.text(f"{root.rstrip('/')}/_spark_metadata")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_day(spark: SparkSession, root: str, day: date | str) -> DataFrame:
    """One day, ``date`` column included.

    A streamed lake is read through its commit log and pruned, so files of failed or running
    batches stay out. A lake without a log is read from the folder of the day alone: listing
    thousands of days to prune them again would cost more than reading one.
    """
    if _has_commit_log(spark, root):
        return read_lake(spark, root).where(F.col("date") == F.lit(str(day)).cast("date"))
    path = f"{root.rstrip('/')}/date={day}"
    return spark.read.schema(LAKE_ROW).option("basePath", root).parquet(path).select(*LAKE_ROW.fieldNames())


def write_lake_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                      files: int | None = None) -> StreamingQuery:
    """Append a stream of lake rows by date. The file sink's commit log makes it exactly-once.

    Every task of a micro-batch writes a file per date it meets. With many small tasks, ``files``
    gathers a batch into that many tasks after the parsing.
    """
    if files is not None:
        rows = rows.repartition(files)
    return (rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .partitionBy("date")
            .trigger(**(trigger or {"processingTime": "10 seconds"}))
            .outputMode("append")
            .start())


def append_lake(rows: DataFrame, path: str) -> None:
    """Batch counterpart of the stream sink, for lakes that no stream writes.

    Rebalancing by date avoids a file per task and date, and still splits a large date.
    """
    rows.hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").parquet(path)
