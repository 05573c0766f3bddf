"""Alignment of metric points to fixed buckets, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Metric names holding one of these are counters of time spent.
DELTA_NAMES = ("cpu_time", "usage_time")


def wants_delta(metric_type: str) -> bool:
    return any(part in metric_type for part in DELTA_NAMES)


def wants_delta_column(metric_type: Column) -> Column:
    return metric_type.contains(DELTA_NAMES[0]) | metric_type.contains(DELTA_NAMES[1])


def point_value() -> Column:
    """The typed value as a double: the double if there is one, else the integer."""
    return F.coalesce(F.col("double_value"), F.col("int64_value").cast("double"))


def drop_null_points(df: DataFrame, value: str = "metric_value") -> DataFrame:
    return df.dropna(subset=[value])


def _bucket(period: str, ts: str, offset: str | None) -> Column:
    return F.window(ts, period, startTime=offset) if offset else F.window(ts, period)


def align_mean(df: DataFrame, series: Sequence[str], value: str = "metric_value", ts: str = "ts",
               period: str = "1 minute", offset: str | None = None) -> DataFrame:
    """Mean per series and bucket, stamped with the bucket end. Works on a stream, too."""
    out = df.groupBy(_bucket(period, ts, offset).alias("_w"), *series).agg(F.avg(value).alias(value))
    return out.select(F.col("_w.end").alias("timestamp"), *series, value)


def last_in_bucket(df: DataFrame, series: Sequence[str], value: str = "metric_value", ts: str = "ts",
                   period: str = "1 minute", offset: str | None = None) -> DataFrame:
    """The newest value per series and bucket as ``_last``; of points of one time, the greatest. Works on a stream, too."""
    out = df.groupBy(_bucket(period, ts, offset).alias("_w"), *series).agg(F.max(F.struct(ts, value))[value].alias("_last"))
    return out.select(F.col("_w.end").alias("timestamp"), *series, "_last")


def align_delta(df: DataFrame, series: Sequence[str], value: str = "metric_value", ts: str = "ts",
                period: str = "1 minute", kind: str = "delta", offset: str | None = None) -> DataFrame:
    """Change per series and bucket, stamped with the bucket end.

    ``kind="delta"`` points already hold changes, which are summed. ``kind="cumulative"`` points
    hold a counter: the last value of a bucket minus that of the preceding one; a counter that
    fell was reset and counts from zero. The first bucket of a series has no change (NULL).
    """
    window = _bucket(period, ts, offset).alias("_w")
    if kind == "delta":
        out = df.groupBy(window, *series).agg(F.sum(value).alias(value))
        return out.select(F.col("_w.end").alias("timestamp"), *series, value)
    if kind != "cumulative":
        raise ValueError("kind must be 'delta' or 'cumulative'")
    last = last_in_bucket(df, series, value, ts, period, offset)
    # At most one row per bucket: a series is bounded by the time range, not by its points.
    change = F.col("_last") - F.lag("_last").over(Window.partitionBy(*series).orderBy("timestamp"))
    out = last.withColumn("_change", change)
    return out.select("timestamp", *series,
                      F.when(F.col("_change") < 0, F.col("_last")).otherwise(F.col("_change")).alias(value))


def with_hostnames(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host names by instance id; unknown instances are called ``Unknown-<id>``.

    ``hosts`` has ``(instance_id, hostname)``, one row per instance. It is broadcast only when
    the optimizer measures it as small.
    """
    joined = df.join(hosts.select("instance_id", "hostname"), "instance_id", "left")
    unknown = F.concat(F.lit("Unknown-"), F.col("instance_id"))
    return joined.withColumn("hostname", F.coalesce("hostname", unknown))


def join_series(left: DataFrame, right: DataFrame, suffixes: tuple[str, str],
                on: Sequence[str] = ("timestamp", "hostname"), value: str = "metric_value") -> DataFrame:
    """Inner join of two series on time and host; value columns get the suffixes."""
    a = left.select(*on, F.col(value).alias(value + suffixes[0]))
    b = right.select(*on, F.col(value).alias(value + suffixes[1]))
    return a.join(b, list(on))


def at_least(column: Column, bound: float = 0.0) -> Column:
    return F.when(column < bound, F.lit(bound)).otherwise(column)
