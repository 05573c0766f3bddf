"""From when to when a product snapshot is the newest one, kept up by every load.

The table holds the report columns of the newest rows of each product and day, with ``date``, the day they count from, and
``validTo``, the day of the product's next snapshot (not included), or ``OPEN``. It is partitioned by ``validTo``. So what
counts now is one folder with a row per product, and what counted on a day is a filter on both ends
that prunes folders; no report aggregates the history.

A load of a day changes the product's snapshot before that day, which now ends there, and the day's own rows.
Only folders that hold or get such rows are rewritten: for a new day the open one and its own; for a day
loaded late or again also those in which the touched products end. The days' names reach the driver.
"""

from __future__ import annotations

from datetime import date

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from shelfwatch.operators.snapshot import latest_snapshot
from shelfwatch.schemas import SNAPSHOT_FACT
from shelfwatch.session import joinable
from shelfwatch.sources.slots import current_parts, read_parts, replace_parts

OPEN = "9999-12-31"
COLUMNS = ("urlId", "timestamp", "brandId", "sellerId", "sold", "date")
VALIDITY = StructType([StructField(c, SNAPSHOT_FACT[c].dataType) for c in COLUMNS] + [StructField("validTo", DateType())])


def _root(warehouse: str) -> str:
    return f"{warehouse}/snapshotValidity"


def _day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def snapshots_valid(spark: SparkSession, warehouse: str, as_of: date | str | None = None) -> DataFrame:
    """The newest snapshot of every product, or the newest at the end of the day ``as_of``; ties kept.

    Give it to the reports with ``history=True``, as these rows may be added up as they are.
    """
    parts = current_parts(spark, _root(warehouse))
    if as_of is None:
        open_part = {p: r for p, r in parts.items() if p == OPEN}
        return read_parts(spark, _root(warehouse), VALIDITY, "validTo", open_part).drop("validTo")
    later = {p: r for p, r in parts.items() if p > str(as_of)}
    rows = read_parts(spark, _root(warehouse), VALIDITY, "validTo", later)
    return rows.where(F.col("date") <= _day(as_of)).drop("validTo")


def update_validity(fact_day: DataFrame, warehouse: str, day: date | str) -> None:
    """Take in the fact rows of one day, which replace what the table had of that day. Days may come in any order."""
    spark, root, at = fact_day.sparkSession, _root(warehouse), _day(day)
    own = latest_snapshot(fact_day.where(F.col("date") == at).select(*COLUMNS))
    parts = current_parts(spark, root)
    near = read_parts(spark, root, VALIDITY, "validTo", {p: r for p, r in parts.items() if p >= str(day)})
    before = F.col("date") < at
    touched = own.select("urlId").unionByName(near.where(F.col("date") == at).select("urlId")).distinct()
    new = own.select("urlId").distinct().withColumn("_new", F.lit(True))
    # Per touched product the day of its next snapshot, and whether the day has it.
    after = near.where(F.col("date") > at).groupBy("urlId").agg(F.min("date").alias("_next"))
    plan = touched.join(after, "urlId", "left").join(new, "urlId", "left").select(
        "urlId", F.coalesce("_next", _day(OPEN)).alias("_next"), F.coalesce("_new", F.lit(False)).alias("_new"))
    plan = plan.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touches = joinable(plan)  # kept in columns, sorted keys take a byte or two each, and many times that in a broadcast
        old = near.where(F.col("date") <= at).join(touches, "urlId")  # what is replaced: the rows before the day and those of it
        ended = old.where(before).withColumn("validTo", F.when(F.col("_new"), at).otherwise(F.col("_next"))).select(*VALIDITY.fieldNames())
        started = own.join(touches, "urlId").withColumn("validTo", F.col("_next")).select(*VALIDITY.fieldNames())
        changed = ended.unionByName(started).persist(StorageLevel.MEMORY_AND_DISK)
        gone = {str(r[0]) for r in old.select("validTo").distinct().collect()}
        come = {str(r[0]) for r in changed.select("validTo").distinct().collect()}
        rewritten = {p: r for p, r in parts.items() if p in gone | come}
        held = read_parts(spark, root, VALIDITY, "validTo", rewritten)
        stays = held.where(F.col("date") > at).unionByName(held.where(F.col("date") <= at).join(touches.select("urlId"), "urlId", "left_anti"))
        rows = stays.unionByName(changed)
        filled = {str(r[0]) for r in rows.select("validTo").distinct().collect()}
        replace_parts(rows, root, "validTo", filled, emptied=gone - filled, sort=("urlId",))
        changed.unpersist()
    finally:
        plan.unpersist()
