"""Rollups of metric points: partial results by minute, hour and day, so that long periods need no raw points.

Under one folder lie ``level=<minute, hour, day>`` tables in parts ``<yyyy-MM-dd>.<n>`` of a day and a share of the metrics; a row has a series' sum, count, first and
last point of one bucket (``firstAt``, ``firstValue``, ``lastAt``, ``lastValue``). All of it merges: sums add up, first and last are the least and
greatest by time. Each level is made from the finer one. A metric's share goes by the hash of its type.

A series over ``[start, end]`` with some period and offset takes, for every bucket, the coarsest rows that fit in: days if
buckets begin at midnight, else hours, else minutes; a period that is no multiple of a minute is read from the raw
points. Where the range cuts a rollup bucket, at most one at each end, the finer level and in the end the raw points
fill the edge. Only the parts of the days and the metric are read.

Loads go by day: ``roll_up`` replaces the days its points are in, which must be whole days of points. A level's parts
count from one commit line each, so a load that dies leaves that level as it was; running it again mends all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from shelfwatch.sources.slots import current_parts, read_parts, replace_parts

LEVELS = ("minute", "hour", "day")
SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
METRIC_SHARES = 16
_MEASURES = "at timestamp, total double, points long, firstAt timestamp, firstValue double, lastAt timestamp, lastValue double"


def _schema(series: Sequence[str]) -> StructType:
    return StructType.fromDDL(", ".join(["metric_type string", *[f"`{s}` string" for s in series], _MEASURES, "part string"]))


def _share(metric_type: Column) -> Column:
    return F.pmod(F.xxhash64(metric_type), F.lit(METRIC_SHARES)).cast("string")


def _partial(points: DataFrame, series: Sequence[str], ts: str, value: str) -> DataFrame:
    """Raw points by minute. A point without a value counts in no sum, but it can be the last of its bucket."""
    point = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    return points.groupBy("metric_type", *series, F.date_trunc("minute", ts).alias("at")).agg(
        F.sum(value).alias("total"), F.count(value).alias("points"), F.min(point).alias("f"), F.max(point).alias("l")).select(
        "metric_type", *series, "at", "total", "points", F.col("f.t").alias("firstAt"), F.col("f.v").alias("firstValue"),
        F.col("l.t").alias("lastAt"), F.col("l.v").alias("lastValue"))


def merge_partials(rows: DataFrame, series: Sequence[str], at: Column, metric: Sequence[str] = ("metric_type",)) -> DataFrame:
    """Partial results of finer buckets as those of the coarser ones that ``at`` names."""
    first, last = F.struct("firstAt", "firstValue"), F.struct("lastAt", "lastValue")
    return rows.groupBy(*metric, *series, at.alias("at")).agg(
        F.sum("total").alias("total"), F.sum("points").alias("points"), F.min(first).alias("f"), F.max(last).alias("l")).select(
        *metric, *series, "at", "total", "points", "f.firstAt", "f.firstValue", "l.lastAt", "l.lastValue")


def roll_up(points: DataFrame, path: str, series: Sequence[str], ts: str = "ts", value: str = "metric_value") -> None:
    """Write all levels for the days of ``points (metric_type, *series, ts, value)``, replacing what they had."""
    spark = points.sparkSession
    days = {str(r[0]) for r in points.select(F.to_date(ts)).distinct().collect()}  # a value per loaded day
    for level, finer in zip(LEVELS, (None, *LEVELS)):
        if finer is None:
            rows = _partial(points, series, ts, value)
        else:
            rows = merge_partials(_read(spark, path, finer, series, lambda day, share: day in days), series, F.date_trunc(level, "at"))
        rows = rows.withColumn("part", F.concat_ws(".", F.to_date("at").cast("string"), _share(F.col("metric_type"))))
        held = {p for p in current_parts(spark, f"{path}/level={level}") if p.split(".")[0] in days}
        filled = {r[0] for r in rows.select("part").distinct().collect()}
        replace_parts(rows, f"{path}/level={level}", "part", filled, emptied=held - filled, sort=("metric_type", *series, "at"))


def _read(spark: SparkSession, path: str, level: str, series: Sequence[str], wanted: Callable[[str, str], bool]) -> DataFrame:
    """Rows of the parts whose day and share are ``wanted``."""
    root = f"{path}/level={level}"
    parts = {p: r for p, r in current_parts(spark, root).items() if wanted(*p.split("."))}
    return read_parts(spark, root, _schema(series), "part", parts).drop("part")


def level_for(period: int, offset: int) -> str | None:
    """The coarsest level whose buckets never cross a bucket of so many seconds that starts at ``offset``."""
    fits = [level for level in LEVELS if period % SECONDS[level] == 0 and offset % SECONDS[level] == 0]
    return fits[-1] if fits else None


def pieces(start: datetime, end: datetime, level: str | None) -> list[tuple[str | None, datetime, datetime]]:
    """``[start, end)`` as ranges of levels, the coarsest in the middle and finer ones at the edges; None is the raw points."""
    if start >= end:
        return []
    if level is None:
        return [(None, start, end)]
    step, zero = timedelta(seconds=SECONDS[level]), datetime(1970, 1, 1)
    low = zero + -((zero - start) // step) * step
    high = zero + ((end - zero) // step) * step
    finer = LEVELS[LEVELS.index(level) - 1] if level != LEVELS[0] else None
    if low >= high:
        return pieces(start, end, finer)
    return [*pieces(start, low, finer), (level, low, high), *pieces(high, end, finer)]


def rolled_series(points: DataFrame, path: str, metric_type: str, series: Sequence[str], start: datetime, end: datetime,
                  period: int = 60, offset: int = 0, aligner: str = "mean", kind: str = "delta", ts: str = "ts",
                  value: str = "metric_value") -> DataFrame:
    """``(timestamp, *series, value)`` of one metric over the closed range, as aligning its raw points in it gives.

    ``period`` and ``offset`` are in seconds, times in UTC. ``aligner`` is mean or delta, and ``kind`` that of
    ``align_delta``. ``points`` are the raw points, of which only the edges of the range are read.
    """
    spark = points.sparkSession
    parts, upto = None, end + timedelta(microseconds=1)
    share = spark.range(1).select(_share(F.lit(metric_type))).first()[0]
    for level, low, high in pieces(start, upto, level_for(period, offset)):
        if level is None:
            inside = (F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high)) & (F.col("metric_type") == metric_type)
            one = _partial(points.where(inside), series, ts, value)
            if level_for(period, offset) is None:  # buckets cut minutes: a row per point
                own = points.where(inside)
                one = own.select("metric_type", *series, F.col(ts).alias("at"), F.col(value).alias("total"),
                                 F.col(value).isNotNull().cast("long").alias("points"), F.col(ts).alias("firstAt"), F.col(value).alias("firstValue"),
                                 F.col(ts).alias("lastAt"), F.col(value).alias("lastValue"))
        else:
            days = str(low.date()), str((high - timedelta(microseconds=1)).date())
            one = _read(spark, path, level, series, lambda day, own, days=days: days[0] <= day <= days[1] and own == share).where(
                (F.col("metric_type") == metric_type) & (F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high)))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = _partial(points.limit(0), series, ts, value)
    bucket = F.window("at", f"{period} seconds", startTime=f"{offset % period} seconds")["end"]
    rows = merge_partials(parts, series, bucket, metric=())
    if aligner == "mean":
        out = F.when(F.col("points") > 0, F.col("total") / F.col("points"))
    elif kind == "delta":
        out = F.col("total")
    else:
        change = F.col("lastValue") - F.lag("lastValue").over(Window.partitionBy(*series).orderBy("at"))
        rows = rows.withColumn("_change", change)
        out = F.when(F.col("_change") < 0, F.col("lastValue")).otherwise(F.col("_change"))
    return rows.select(F.col("at").alias("timestamp"), *series, out.alias(value))
