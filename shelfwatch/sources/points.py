"""Metric points, host names and the metric catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Resource, display name and type of each metric.
METRIC_CATALOG = (
    ("CPU", "CPU utilization", "compute.googleapis.com/instance/cpu/utilization"),
    ("CPU", "Processes by CPU Usage", "agent.googleapis.com/processes/cpu_time"),
    ("CPU", "System Load per vCPU", "agent.googleapis.com/cpu/load_1m"),
    ("CPU", "vCPU Core Usage", "compute.googleapis.com/instance/cpu/usage_time"),
    ("CPU", "Unused vCPU Cores", "compute.googleapis.com/instance/cpu/reserved_cores"),
    ("Disk", "Disk percent used", "agent.googleapis.com/disk/percent_used"),
    ("Memory", "Memory percent used", "agent.googleapis.com/memory/percent_used"),
    ("Memory", "Memory Bytes Used", "agent.googleapis.com/memory/bytes_used"),
    ("Network", "Network sent bytes", "compute.googleapis.com/instance/network/sent_bytes_count"),
)

# The resource all metrics belong to, and the types read for one state only.
RESOURCE_TYPE = "gce_instance"
USED_STATE_NAMES = ("memory/percent_used", "memory/bytes_used")
RANGE_HOURS = (1, 2, 4, 6, 8, 10, 12, 24)


def metric_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRIC_CATALOG, "resource string, metric string, metric_type string")


def metric_type_of(metric: str) -> str:
    return {name: kind for _, name, kind in METRIC_CATALOG}[metric]


def in_range(ts: Column, start: datetime | Column, end: datetime | Column) -> Column:
    return (ts >= start) & (ts <= end)


def trailing_hours(ts: Column, end: datetime | Column, hours: int) -> Column:
    """The last ``hours`` before a fixed end."""
    end = end if isinstance(end, Column) else F.lit(end)
    return in_range(ts, F.timestamp_add("HOUR", F.lit(-hours), end), end)


def metric_filter(metric_type: str, resource_type: str = RESOURCE_TYPE) -> Column:
    wanted = (F.col("metric_type") == metric_type) & (F.col("resource_type") == resource_type)
    if any(name in metric_type for name in USED_STATE_NAMES):
        wanted = wanted & (F.col("labels")["state"] == "used")
    return wanted


def read_points(points: DataFrame, metric_type: str, start: datetime | Column, end: datetime | Column,
                resource_type: str = RESOURCE_TYPE) -> DataFrame:
    """Points of one metric in a closed time range; the filters reach the scan."""
    return points.where(metric_filter(metric_type.strip(), resource_type) & in_range(F.col("ts"), start, end))
