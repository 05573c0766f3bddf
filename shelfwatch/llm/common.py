"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from shelfwatch.session import joinable, scratch_path, tune  # noqa: F401

ROW_FILE, ROW_INDEX = "__row_file", "__row_index"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of an execution


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # rows that operators hold while they work on a batch
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a fixed table with short lineage.

    What was shuffled for it is deleted as soon as it is written, not when the driver happens to collect its garbage."""
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that a result is about to bring, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[_quoted(c) for c in df.columns if c.lower() not in taken])


def shield(df: DataFrame, names: list[str]):
    """``df`` with columns named like ``names`` (any case) put aside under other names, and a function
    that takes a result back to exactly the columns of ``df``."""
    taken = {n.lower() for n in names}
    inner = {c: f"__aside_{i}" if c.lower() in taken else c for i, c in enumerate(df.columns)}

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[_quoted(v).alias(k) for k, v in inner.items()])

    return df.select(*[_quoted(k).alias(v) for k, v in inner.items()]), back


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [_quoted(c) for c in df.columns]


def identified(df: DataFrame) -> DataFrame:
    """``df`` with a row identity that every later read repeats: hash of the file, place in the file.

    ``df`` must be a read of Parquet files, perhaps with columns left out; any other frame is
    written to the shared folder first. ``doc_id`` is no identity, as rows may repeat.
    """
    def marked(frame: DataFrame) -> DataFrame:
        meta = frame.metadataColumn("_metadata")
        return frame.select(*columns_of(frame), F.xxhash64(meta["file_path"]).alias(ROW_FILE),
                            meta["row_index"].alias(ROW_INDEX))

    try:
        return marked(df)
    except AnalysisException:
        return marked(pin(df, "rows"))


def map_batches(df: DataFrame, arrays_of: Callable[[pa.RecordBatch], list[pa.Array]], schema: StructType) -> DataFrame:
    """``df`` through a function of Arrow batches that returns the columns of ``schema``, in order.

    Columns go by position, so their names may hold dots or clash with others.
    """
    inner = [f"c{i}" for i in range(len(schema.fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(arrays_of(batch), names=inner)

    out = StructType([StructField(n, f.dataType) for n, f in zip(inner, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, out).toDF(*schema.names)


def before(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, str], name: str) -> DataFrame:
    """For every row the sum of each amount over the rows before it in its group.

    ``amounts`` maps a result column to the integer column that it sums. A group may hold most
    rows: rows are range-partitioned by group and order, so a group is many blocks; sums inside
    a block and sums of the blocks before it are two separate steps, and neither sees a group as
    a whole. The ranges are written down, since a second evaluation could cut them elsewhere.
    Pass narrow rows. Rows that agree in ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = pin(df.repartitionByRange(parts, *group, *order).withColumn("__block", F.spark_partition_id()), name)
    keys = [*group, "__block"]
    blocks = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"__all_{k}") for k, v in amounts.items()])
    earlier = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"__of_{k}") for k in keys],
                           *[F.coalesce(F.sum(f"__all_{k}").over(earlier), F.lit(0)).alias(f"__base_{k}") for k in amounts])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__in_{k}") for k, v in amounts.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return summed.join(blocks, same).select(
        *[c for c in df.columns], *[(F.col(f"__in_{k}") + F.col(f"__base_{k}")).cast("long").alias(k) for k in amounts])
