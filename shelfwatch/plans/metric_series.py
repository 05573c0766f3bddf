"""Machine-metric series, from points to what a chart shows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.functions.time import to_local
from shelfwatch.operators.align import (
    align_delta,
    align_mean,
    at_least,
    drop_null_points,
    join_series,
    point_value,
    wants_delta,
    with_hostnames,
)
from shelfwatch.sources.points import RESOURCE_TYPE, metric_type_of, read_points

# Labels tell the series of one instance apart; as a sorted list they can be grouped.
_SERIES = ("instance_id", "_labels")


def _labelled(points: DataFrame) -> DataFrame:
    return points.select(
        "instance_id",
        F.array_sort(F.map_entries("labels")).alias("_labels"),
        "ts",
        point_value().alias("metric_value"),
    )


def metric_series(
    points: DataFrame,
    hosts: DataFrame,
    metric_type: str,
    start: datetime | Column,
    end: datetime | Column,
    period: str = "1 minute",
    kind: str = "delta",
    zone: str | None = None,
    resource_type: str = RESOURCE_TYPE,
    offset: str | None = None,
) -> DataFrame:
    """Aligned series ``(timestamp, instance_id, hostname, metric_value)`` of one metric.

    Counters of time spent are aligned as change, everything else as mean. ``kind`` says whether
    counter points hold changes or running totals. With ``zone`` the timestamp is wall clock
    there. Buckets start at full periods, or ``offset`` later. Names are looked up after alignment,
    on one row per bucket.
    """
    metric_type = metric_type.strip()
    raw = _labelled(read_points(points, metric_type, start, end, resource_type))
    if wants_delta(metric_type):
        aligned = align_delta(raw, _SERIES, period=period, kind=kind, offset=offset)
    else:
        aligned = align_mean(raw, _SERIES, period=period, offset=offset)
    named = with_hostnames(drop_null_points(aligned), hosts)
    stamp = F.col("timestamp") if zone is None else to_local(F.col("timestamp"), zone)
    return named.select(stamp.alias("timestamp"), "instance_id", "hostname", "metric_value")


def _scaled(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("metric_value", F.col("metric_value") / F.lit(factor))


def named_series(points, hosts, metric: str, start, end, **options) -> DataFrame:
    """Series of a catalogue entry, by its display name."""
    return metric_series(points, hosts, metric_type_of(metric), start, end, **options)


def cpu_utilization(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "CPU utilization", start, end, **options)


def system_load(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "System Load per vCPU", start, end, **options)


def process_cpu_time(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "Processes by CPU Usage", start, end, **options)


def disk_percent_used(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "Disk percent used", start, end, **options)


def memory_percent_used(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "Memory percent used", start, end, **options)


def memory_used_mib(points, hosts, start, end, **options) -> DataFrame:
    return _scaled(named_series(points, hosts, "Memory Bytes Used", start, end, **options), 1024.0 * 1024.0)


def network_bytes_sent(points, hosts, start, end, **options) -> DataFrame:
    return named_series(points, hosts, "Network sent bytes", start, end, **options)


def cores_from_seconds(series: DataFrame, seconds: float = 60.0) -> DataFrame:
    """CPU seconds spent in a bucket to cores in use."""
    return _scaled(series, seconds)


def cores_used(points, hosts, start, end, **options) -> DataFrame:
    return cores_from_seconds(named_series(points, hosts, "vCPU Core Usage", start, end, **options))


def unused_from(reserved: DataFrame, used: DataFrame) -> DataFrame:
    """Reserved minus used per time and host, never below zero.

    Where both series say which instance a row is of, instances that share a name are kept apart.
    """
    known = "instance_id" in reserved.columns and "instance_id" in used.columns
    on = ("timestamp", "instance_id", "hostname") if known else ("timestamp", "hostname")
    both = join_series(reserved, used, ("_reserved", "_used"), on)
    free = F.col("metric_value_reserved") - F.col("metric_value_used")
    return both.withColumn("metric_value", at_least(free, 0.0))


def cores_unused(points, hosts, start, end, **options) -> DataFrame:
    reserved = named_series(points, hosts, "Unused vCPU Cores", start, end, **options)
    return unused_from(reserved, cores_used(points, hosts, start, end, **options))


# The limit each chart draws, in the unit of its series.
THRESHOLDS = {
    "CPU utilization": 1.0,
    "System Load per vCPU": 10.0,
    "vCPU Core Usage": 2.0,
    "Unused vCPU Cores": 5.0,
    "Memory percent used": 100.0,
    "Memory Bytes Used": 10000.0,
}


def threshold_breach(series: DataFrame, limits: Mapping[str, float] = THRESHOLDS,
                     metric: str = "metric") -> DataFrame:
    """Points at or above the limit of their metric; metrics without a limit have none."""
    spark = series.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in limits.items()], f"{metric} string, limit double")
    # The caller's mapping is the whole table: a handful of rows.
    joined = series.join(F.broadcast(table), metric)
    return joined.where(F.col("metric_value") >= F.col("limit"))
