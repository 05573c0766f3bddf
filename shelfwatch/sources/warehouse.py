"""Warehouse tables: replaceable dimensions and the day-partitioned fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

from shelfwatch.operators.dimensions import DIMENSIONS, SEEN, merge_streamed
from shelfwatch.schemas import SNAPSHOT_FACT
from shelfwatch.session import scratch_path
from shelfwatch.sources.slots import read_parts, replace_parts


def overwrite_table(df: DataFrame, target: str | Mapping[str, str]) -> None:
    """Replace the contents of a Parquet path, or of a JDBC table given by its options.

    A JDBC table is truncated rather than dropped, so its definition survives. Connection
    details come from the caller.
    """
    if isinstance(target, str):
        df.write.mode("overwrite").parquet(target)
    else:
        options = {"truncate": "true", **target}
        df.write.mode("overwrite").format("jdbc").options(**options).save()


def load_fact(fact: DataFrame, path: str) -> None:
    """Replace exactly the days the frame holds; other days stay, and a load that dies has replaced none.

    Files are sorted, so readers skip row groups by product.
    """
    days = [str(r[0]) for r in fact.select("date").distinct().collect()]  # a value per loaded day
    replace_parts(fact, path, "date", days, sort=("urlId", "timestamp"))


def read_fact(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_parts(spark, f"{warehouse}/productSnapshotFact", SNAPSHOT_FACT, "date")


# Fewest hash buckets of a new dimension table, and rows in each of a larger one. A table keeps the number it was made with;
# a bucket that has grown is written by several tasks.
BUCKETS = {"brandDim": 4, "sellerDim": 4, "productDim": 16}
BUCKET_ROWS = 500_000
BROADCAST_ROWS = 20_000  # incoming rows of a load; a broadcast passes whole through the driver
_SLOTS = ("a", "b")
_COMMITS = "loadNo long, bucket int, slot string, buckets int"


def _state_schema(name: str) -> StructType:
    contract = DIMENSIONS[name][0]
    return StructType(contract.fields + [StructField(SEEN, TimestampType())])


def _versions(spark: SparkSession, warehouse: str, name: str) -> list[Row]:
    """Per bucket the slot of its newest finished load; a row per bucket."""
    try:
        commits = spark.read.schema(_COMMITS).parquet(f"{warehouse}/{name}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = commits.groupBy("bucket", "buckets").agg(F.max_by("slot", "loadNo").alias("slot"), F.max("loadNo").alias("loadNo"))
    return newest.collect()


def _rows_of(spark: SparkSession, warehouse: str, name: str, versions: list[Row]) -> DataFrame:
    schema = StructType(_state_schema(name).fields + [StructField("bucket", IntegerType()), StructField("slot", StringType())])
    wanted = F.concat_ws("/", "bucket", "slot").isin([f"{v['bucket']}/{v['slot']}" for v in versions])
    return spark.read.schema(schema).parquet(f"{warehouse}/{name}/rows").where(wanted).drop("bucket", "slot")


def dimension_state(spark: SparkSession, warehouse: str, name: str) -> DataFrame | None:
    """Current rows of a dimension with the time each was last seen; None before the first load."""
    versions = _versions(spark, warehouse, name)
    return _rows_of(spark, warehouse, name, versions) if versions else None


def read_dimension(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    state = dimension_state(spark, warehouse, name)
    contract = DIMENSIONS[name][0]
    if state is None:
        return spark.createDataFrame([], contract)
    return state.select(*contract.fieldNames())


def merged_rows(spark: SparkSession, warehouse: str, name: str, incoming: DataFrame, old: list[Row], rows: int) -> DataFrame:
    """``rows`` incoming ones, one per key, merged with what the buckets ``old`` hold."""
    if not old:
        return incoming
    return merge_streamed(_rows_of(spark, warehouse, name, old), incoming, DIMENSIONS[name][1], few=rows <= BROADCAST_ROWS)


def merge_into_dimension(spark: SparkSession, warehouse: str, name: str, incoming: DataFrame) -> None:
    """Merge ``incoming`` (dimension rows with ``lastSeen``) into the table; the row seen last wins.

    Rows lie in hash buckets of the key, and a load rewrites only the buckets it touches. A bucket has
    two slots: the load reads the current one and writes the other, then commits by adding a line
    per bucket to the commit log. A load that dies before that line, even with files of a slot half
    in place, has changed nothing that is read. One load at a time.

    The day's rows are written down and counted first. Up to ``BROADCAST_ROWS`` of them are broadcast to the old rows, which
    are then read and written but not shuffled before the write; more are joined by shuffle. The write is
    rebalanced: adaptive execution splits a bucket that is larger than a task should be.
    """
    key = DIMENSIONS[name][1]
    path = scratch_path(spark, f"incoming-{name}")
    incoming.select(*_state_schema(name).fieldNames()).write.parquet(path)
    incoming = spark.read.schema(_state_schema(name)).parquet(path)
    versions = _versions(spark, warehouse, name)
    buckets = versions[0]["buckets"] if versions else max(BUCKETS[name], -(-incoming.count() // BUCKET_ROWS))
    load = max((v["loadNo"] for v in versions), default=0) + 1
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    counts = {r[0]: r[1] for r in incoming.groupBy(bucket.alias("of")).count().collect()}  # a row per bucket
    touched, rows = sorted(counts), sum(counts.values())
    if not touched:
        return
    current = {v["bucket"]: v["slot"] for v in versions}
    free = {b: _SLOTS[1] if current.get(b) == _SLOTS[0] else _SLOTS[0] for b in touched}
    merged = merged_rows(spark, warehouse, name, incoming, [v for v in versions if v["bucket"] in free], rows)
    slots = F.create_map(*[F.lit(x) for b, s in free.items() for x in (b, s)])
    (merged.withColumn("bucket", bucket).withColumn("slot", slots[F.col("bucket")])
     .hint("rebalance", F.col("bucket"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "slot").parquet(f"{warehouse}/{name}/rows"))
    lines = F.array(*[F.struct(F.lit(load).cast("long").alias("loadNo"), F.lit(b).alias("bucket"), F.lit(s).alias("slot"),
                               F.lit(buckets).alias("buckets")) for b, s in free.items()])
    commit = spark.range(1, numPartitions=1).select(F.explode(lines).alias("line")).select("line.*")
    commit.write.mode("append").parquet(f"{warehouse}/{name}/commits")


def export_tables(spark: SparkSession, warehouse: str, targets: Mapping[str, str | Mapping[str, str]]) -> None:
    """Replace outside tables by the current warehouse ones, e.g. for a dashboard database.

    ``targets`` maps table names to what ``overwrite_table`` takes: a path or JDBC options.
    """
    for name, target in targets.items():
        if name == "productSnapshotFact":
            overwrite_table(read_fact(spark, warehouse), target)
        else:
            overwrite_table(read_dimension(spark, warehouse, name), target)
