"""Machine-metric series, on events as points."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shelfwatch.operators import align as A
from shelfwatch.plans import metric_series as M, rollups
from shelfwatch.registry import query
from shelfwatch.registry.tables import (
    EVENT_METRICS,
    SQL_HOSTS,
    SQL_POINTS,
    hosts,
    instant,
    points,
    sql_bucket_end,
    sql_stamp,
    stamp,
    table,
    time_range,
)
from shelfwatch.session import scratch_path
from shelfwatch.sources.points import METRIC_CATALOG, metric_catalog, metric_type_of, trailing_hours

_KEYS = ("event_type", "user_id")


def _events(spark, d):
    return table(spark, d, "events").select(*_KEYS, "ts", F.col("value").alias("metric_value"))


def _rounded(df, *keys):
    return df.select(stamp("timestamp").alias("ts"), *keys, F.round("metric_value", 6).alias("metric_value"))


def _sql_aligned(period, aggregate, source="events", keys="event_type, user_id"):
    return (f"SELECT {sql_bucket_end(period)} AS t, {keys}, {aggregate} AS v FROM {source} "
            f"GROUP BY {sql_bucket_end(period)}, {keys}")


@query("series_mean_1m", f"""
SELECT {sql_stamp('t')} AS ts, event_type, user_id, round(v, 6) AS metric_value
FROM ({_sql_aligned('1 minute', 'avg(value)')})""")
def series_mean_1m(spark, d):
    return _rounded(A.align_mean(_events(spark, d), _KEYS), *_KEYS)


@query("series_delta_1d", f"""
SELECT {sql_stamp('t')} AS ts, event_type, user_id, round(v, 6) AS metric_value
FROM ({_sql_aligned('1 day', 'sum(value)')})""")
def series_delta_1d(spark, d):
    return _rounded(A.align_delta(_events(spark, d), _KEYS, period="1 day"), *_KEYS)


@query("series_counter_1d", f"""
WITH last AS (
    SELECT {sql_bucket_end('1 day')} AS t, event_type, user_id, value AS v FROM events
    QUALIFY row_number() OVER (
        PARTITION BY {sql_bucket_end('1 day')}, event_type, user_id ORDER BY ts DESC, value DESC) = 1),
moved AS (
    SELECT *, v - lag(v) OVER (PARTITION BY event_type, user_id ORDER BY t) AS change FROM last)
SELECT {sql_stamp('t')} AS ts, event_type, user_id,
       round(CASE WHEN change < 0 THEN v ELSE change END, 6) AS metric_value
FROM moved""")
def series_counter_1d(spark, d):
    return _rounded(A.align_delta(_events(spark, d), _KEYS, period="1 day", kind="cumulative"), *_KEYS)


_ROLLED = "2024-01-03 05:07:03", "2024-01-27 18:30:20"


@query("series_rolled_6h", f"""
WITH inside AS (SELECT * FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '{_ROLLED[0]}' AND TIMESTAMP '{_ROLLED[1]}')
SELECT {sql_stamp('t')} AS ts, user_id, round(v, 6) AS metric_value
FROM ({_sql_aligned('6 hours', 'avg(value)', 'inside', 'user_id')})""")
def series_rolled_6h(spark, d):
    """A mean over a range whose ends cut hours and minutes: hours in the middle, minutes and raw points at the edges."""
    points = table(spark, d, "events").select(
        F.col("event_type").alias("metric_type"), F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("metric_value"))
    path = scratch_path(spark, "rollups")
    rollups.roll_up(points, path, ["user_id"])
    start, end = (datetime.fromisoformat(t) for t in _ROLLED)
    series = rollups.rolled_series(points, path, "click", ["user_id"], start, end, period=6 * 3600)
    return _rounded(series.withColumn("user_id", F.col("user_id").cast("long")), "user_id")


@query("aligner_choice", f"""
WITH {SQL_POINTS}
SELECT metric_type, contains(metric_type, 'cpu_time') OR contains(metric_type, 'usage_time') AS delta,
       count(*) AS points, count(v) AS valued
FROM points GROUP BY metric_type""")
def aligner_choice(spark, d):
    kinds = points(spark, d).select("metric_type", A.wants_delta_column(F.col("metric_type")).alias("delta"),
                                    A.point_value().alias("v"))
    return kinds.groupBy("metric_type", "delta").agg(F.count(F.lit(1)).alias("points"), F.count("v").alias("valued"))


_SQL_CATALOG = ", ".join(str(row) for row in METRIC_CATALOG)


@query("metric_catalog_points", f"""
WITH {SQL_POINTS},
catalog(resource, metric, metric_type) AS (VALUES {_SQL_CATALOG})
SELECT resource, metric, count(p.metric_type) AS points
FROM catalog c LEFT JOIN points p ON c.metric_type = p.metric_type GROUP BY resource, metric""")
def metric_catalog_points(spark, d):
    counts = points(spark, d).groupBy("metric_type").agg(F.count(F.lit(1)).alias("points"))
    joined = metric_catalog(spark).join(counts, "metric_type", "left")
    return joined.select("resource", "metric", F.coalesce("points", F.lit(0)).alias("points"))


@query("series_with_hosts", f"""
WITH {SQL_HOSTS}, aligned AS ({_sql_aligned('1 minute', 'avg(value)')})
SELECT {sql_stamp("t + INTERVAL '7 hours'")} AS ts, event_type, CAST(user_id AS VARCHAR) AS instance_id,
       coalesce(hostname, 'Unknown-' || CAST(user_id AS VARCHAR)) AS hostname, round(v, 6) AS metric_value
FROM aligned LEFT JOIN hosts ON instance_id = CAST(user_id AS VARCHAR)""")
def series_with_hosts(spark, d):
    """Aligned, named, and on the wall clock of the dashboard's zone."""
    aligned = A.align_mean(_events(spark, d), _KEYS)
    keyed = aligned.withColumn("instance_id", F.col("user_id").cast("string"))
    named = A.with_hostnames(keyed, hosts(spark, d))
    local = named.withColumn("timestamp", M.to_local(F.col("timestamp"), "Asia/Ho_Chi_Minh"))
    return _rounded(local, "event_type", "instance_id", "hostname")


# -- catalogue series ---------------------------------------------------------------------------

def _series_sql(metric, aggregate="avg(v)", period="1 minute", factor=None, where="TRUE"):
    value = "v" if factor is None else f"v / {factor}"
    return f"""
    SELECT t AS timestamp, a.instance_id, coalesce(hostname, 'Unknown-' || a.instance_id) AS hostname,
           {value} AS metric_value
    FROM ({_sql_aligned(period, aggregate, 'points', 'metric_type, instance_id, state')}) a
    LEFT JOIN hosts h ON h.instance_id = a.instance_id
    WHERE metric_type = '{metric_type_of(metric)}' AND v IS NOT NULL AND {where}"""


def _final_sql(series, digits=6):
    return f"""
WITH {SQL_POINTS}, {SQL_HOSTS}
SELECT {sql_stamp('timestamp')} AS ts, instance_id, hostname, round(metric_value, {digits}) AS metric_value
FROM ({series})"""


def _final(df, digits=6):
    return df.select(stamp("timestamp").alias("ts"), "instance_id", "hostname",
                     F.round("metric_value", digits).alias("metric_value"))


def _whole(spark, d):
    """Points, hosts and the range that holds all points."""
    rows = points(spark, d)
    return rows, hosts(spark, d), *time_range(rows)


_USED = "state = 'used'"


@query("cpu_utilization", _final_sql(_series_sql("CPU utilization")))
def cpu_utilization(spark, d):
    return _final(M.cpu_utilization(*_whole(spark, d)))


@query("memory_percent_used", _final_sql(_series_sql("Memory percent used", where=_USED)))
def memory_percent_used(spark, d):
    return _final(M.memory_percent_used(*_whole(spark, d)))


@query("memory_used_mib", _final_sql(
    _series_sql("Memory Bytes Used", where=_USED, factor="(1024.0::DOUBLE * 1024.0::DOUBLE)"), 9))
def memory_used_mib(spark, d):
    return _final(M.memory_used_mib(*_whole(spark, d)), 9)


_SQL_USED_CORES = _series_sql("vCPU Core Usage", "sum(v)", "1 day", "60.0::DOUBLE")


@query("cores_used", _final_sql(_SQL_USED_CORES))
def cores_used(spark, d):
    return _final(M.cores_used(*_whole(spark, d), period="1 day"))


_SQL_UNUSED = f"""
    SELECT r.timestamp, r.hostname, r.metric_value AS reserved, u.metric_value AS used,
           greatest(0.0::DOUBLE, r.metric_value - u.metric_value) AS metric_value
    FROM ({_series_sql('Unused vCPU Cores', period='1 day')}) r
    JOIN ({_SQL_USED_CORES}) u ON r.timestamp = u.timestamp AND r.hostname = u.hostname"""


@query("cores_unused", f"""
WITH {SQL_POINTS}, {SQL_HOSTS}
SELECT {sql_stamp('timestamp')} AS ts, hostname, round(reserved, 6) AS reserved, round(used, 6) AS used,
       round(metric_value, 6) AS metric_value
FROM ({_SQL_UNUSED})""")
def cores_unused(spark, d):
    rows = M.cores_unused(*_whole(spark, d), period="1 day")
    return rows.select(stamp("timestamp").alias("ts"), "hostname",
                       F.round("metric_value_reserved", 6).alias("reserved"),
                       F.round("metric_value_used", 6).alias("used"), F.round("metric_value", 6).alias("metric_value"))


def _catalogue_series(name, metric, event_type, function, aggregate):
    """A catalogued metric without points of its own: the events of one type stand in for it."""
    source = f"""
    SELECT t AS timestamp, a.instance_id, coalesce(hostname, 'Unknown-' || a.instance_id) AS hostname,
           v AS metric_value
    FROM ({_sql_aligned('1 minute', aggregate, 'points', 'metric_type, instance_id, state')}) a
    LEFT JOIN hosts h ON h.instance_id = a.instance_id
    WHERE metric_type = '{EVENT_METRICS[event_type]}' AND v IS NOT NULL"""

    @query(name, _final_sql(source))
    def run(spark, d):
        renamed = F.when(F.col("metric_type") == EVENT_METRICS[event_type], metric_type_of(metric))
        moved = points(spark, d).withColumn("metric_type", renamed)
        return _final(function(moved, hosts(spark, d), *time_range(moved)))
    return run


_catalogue_series("system_load", "System Load per vCPU", "error", M.system_load, "avg(v)")
_catalogue_series("process_cpu_time", "Processes by CPU Usage", "click", M.process_cpu_time, "sum(v)")
_catalogue_series("disk_percent_used", "Disk percent used", "signup", M.disk_percent_used, "avg(v)")
_catalogue_series("network_bytes_sent", "Network sent bytes", "view", M.network_bytes_sent, "avg(v)")


@query("threshold_breach", f"""
WITH limits(event_type, "limit") AS (VALUES
    ('click', 10.0::DOUBLE), ('error', 1.0::DOUBLE), ('purchase', 100.0::DOUBLE), ('view', 5.0::DOUBLE)),
aligned AS ({_sql_aligned('1 minute', 'avg(value)')})
SELECT {sql_stamp('t')} AS ts, a.event_type, user_id, round(v, 6) AS metric_value, "limit"
FROM aligned a JOIN limits l ON a.event_type = l.event_type WHERE v >= "limit" """)
def threshold_breach(spark, d):
    aligned = A.align_mean(_events(spark, d), _KEYS)
    rows = M.threshold_breach(aligned, {"click": 10, "error": 1, "purchase": 100, "view": 5}, "event_type")
    return _rounded(rows, "event_type", "user_id", "limit")


@query("range_filter", f"""
WITH {SQL_POINTS}
SELECT metric_type, instance_id, {sql_stamp('ts')} AS ts, v AS metric_value FROM points
WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '24 hours' AND ts <= TIMESTAMP '2024-01-15 12:00:00'
  AND v IS NOT NULL""")
def range_filter(spark, d):
    """The trailing 24 hours before a fixed end, NULL points dropped."""
    recent = points(spark, d).where(trailing_hours(F.col("ts"), instant("2024-01-15 12:00:00"), 24))
    values = recent.select("metric_type", "instance_id", stamp("ts").alias("ts"), A.point_value().alias("metric_value"))
    return A.drop_null_points(values)
