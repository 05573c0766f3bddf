"""Alignment and derived series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import align as A
from shelfwatch.plans import metric_series as M
from shelfwatch.schemas import METRIC_POINT
from shelfwatch.sources import points as P


def at(minute, second=0, hour=0):
    return dt.datetime(2026, 1, 1, hour, minute, second)


def series(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, ts timestamp, metric_value double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mean_is_stamped_with_the_bucket_end(spark):
    df = series(spark, [("a", at(0, 10), 1.0), ("a", at(0, 50), 2.0), ("a", at(1, 0), 5.0), ("b", at(0, 0), 9.0)])
    assert rows(A.align_mean(df, ["instance_id"]), "instance_id", "timestamp", "metric_value") == [
        ("a", at(1), 1.5), ("a", at(2), 5.0), ("b", at(1), 9.0)]


def test_bucket_offset(spark):
    df = series(spark, [("a", at(0, 10), 1.0), ("a", at(0, 50), 2.0)])
    assert rows(A.align_mean(df, ["instance_id"], offset="30 seconds"), "timestamp", "metric_value") == [
        (at(0, 30), 1.0), (at(1, 30), 2.0)]


def test_counter_with_increase_reset_gap_and_single_point(spark):
    df = series(spark, [
        ("a", at(0, 10), 5.0), ("a", at(0, 50), 7.0), ("a", at(1, 5), 10.0), ("a", at(2, 5), 4.0), ("a", at(9, 5), 6.0),
        ("b", at(3), 1.0)])
    out = A.align_delta(df, ["instance_id"], kind="cumulative")
    assert sorted(map(str, rows(out, "instance_id", "timestamp", "metric_value"))) == sorted(map(str, [
        ("a", at(1), None), ("a", at(2), 3.0), ("a", at(3), 4.0), ("a", at(10), 2.0), ("b", at(4), None)]))
    summed = A.align_delta(df.where("instance_id = 'a'"), ["instance_id"])
    assert rows(summed, "timestamp", "metric_value")[0] == (at(1), 12.0)
    with pytest.raises(ValueError):
        A.align_delta(df, ["instance_id"], kind="other")


def points(spark, rows):
    return spark.createDataFrame(rows, METRIC_POINT)


USAGE, RESERVED = P.metric_type_of("vCPU Core Usage"), P.metric_type_of("Unused vCPU Cores")
MEMORY, CPU = P.metric_type_of("Memory Bytes Used"), P.metric_type_of("CPU utilization")
GCE = P.RESOURCE_TYPE


@pytest.fixture(scope="module")
def machine(spark):
    data = points(spark, [
        (USAGE, GCE, "1", {}, at(0, 10), 30.0, None), (USAGE, GCE, "1", {}, at(0, 40), 60.0, None),
        (USAGE, GCE, "1", {}, at(1, 10), 240.0, None), (USAGE, GCE, "2", {}, at(0, 10), 30.0, None),
        (RESERVED, GCE, "1", {}, at(0, 0), 2.0, None), (RESERVED, GCE, "1", {}, at(1, 0), None, 2),
        (MEMORY, GCE, "1", {"state": "used"}, at(0, 0), None, 1024 * 1024 * 3),
        (MEMORY, GCE, "1", {"state": "free"}, at(0, 0), None, 1024 * 1024 * 5),
        (MEMORY, GCE, "1", {}, at(0, 0), None, 7), (MEMORY, "other", "1", {"state": "used"}, at(0, 0), None, 9),
        (CPU, GCE, "1", {"cpu": "0"}, at(0, 0), 0.5, None), (CPU, GCE, "1", {"cpu": "1"}, at(0, 0), 1.5, None),
        (CPU, GCE, "2", {"cpu": "0"}, at(0, 0), None, None), (CPU, GCE, "2", {}, at(59, 59, 1), 0.1, None),
    ])
    hosts = spark.createDataFrame([("1", "web"), ("3", "db")], "instance_id string, hostname string")
    return data, hosts, F.lit(at(0)), F.lit(at(30))


def test_series_by_label_value_kind_host_and_range(machine):
    assert rows(M.cpu_utilization(*machine), "timestamp", "instance_id", "hostname", "metric_value") == [
        (at(1), "1", "web", 0.5), (at(1), "1", "web", 1.5)]
    assert rows(M.memory_used_mib(*machine), "timestamp", "hostname", "metric_value") == [(at(1), "web", 3.0)]
    local = M.cpu_utilization(*machine, zone="Asia/Ho_Chi_Minh")
    assert {r["timestamp"] for r in local.collect()} == {at(1, hour=7)}


def test_cores(machine):
    assert rows(M.cores_used(*machine), "timestamp", "hostname", "metric_value") == [
        (at(1), "Unknown-2", 0.5), (at(1), "web", 1.5), (at(2), "web", 4.0)]
    assert rows(M.cores_unused(*machine), "timestamp", "hostname", "metric_value_reserved", "metric_value_used", "metric_value") == [
        (at(1), "web", 2.0, 1.5, 0.5), (at(2), "web", 2.0, 4.0, 0.0)]


def test_empty_range_has_a_schema(machine):
    data, hosts, _, _ = machine
    out = M.system_load(data, hosts, F.lit(at(0)), F.lit(at(1)))
    assert out.columns == ["timestamp", "instance_id", "hostname", "metric_value"] and out.count() == 0


def test_cumulative_counter_drops_the_first_bucket(machine):
    out = M.metric_series(machine[0], machine[1], USAGE, *machine[2:], kind="cumulative")
    assert rows(out, "timestamp", "instance_id", "metric_value") == [(at(2), "1", 180.0)]


def test_catalogue_and_thresholds(spark, machine):
    catalog = P.metric_catalog(spark)
    assert catalog.count() == 9 and catalog.select("metric_type").distinct().count() == 9
    assert set(M.THRESHOLDS) <= {r["metric"] for r in catalog.collect()}
    tagged = M.cores_used(*machine).withColumn("metric", F.lit("vCPU Core Usage"))
    assert rows(M.threshold_breach(tagged), "timestamp", "metric_value", "limit") == [(at(2), 4.0, 2.0)]
    assert M.threshold_breach(tagged, {"other": 0}).count() == 0


@pytest.mark.parametrize("hours", P.RANGE_HOURS)
def test_trailing_range_is_closed(spark, hours):
    end = dt.datetime(2026, 1, 2)
    marks = [end - dt.timedelta(hours=hours), end - dt.timedelta(hours=hours, seconds=1), end, end + dt.timedelta(seconds=1)]
    df = spark.createDataFrame([(m,) for m in marks], "ts timestamp")
    kept = {r["ts"] for r in df.where(P.trailing_hours(F.col("ts"), end, hours)).collect()}
    assert kept == {marks[0], marks[2]}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(A.at_least(F.col("v"), 0.0)).collect()] == [0.0, 2.0, None]


def test_aligner_choice(spark):
    assert A.wants_delta(USAGE) and A.wants_delta(P.metric_type_of("Processes by CPU Usage"))
    assert not A.wants_delta(CPU) and not A.wants_delta(RESERVED)


def test_filters_reach_the_scan(spark, tmp_path, machine):
    path = str(tmp_path / "points")
    machine[0].write.parquet(path)
    df = P.read_points(spark.read.parquet(path), MEMORY, at(0), at(30)).select("instance_id", "ts")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(metric_type" in pushed and "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
    assert "int64_value" not in plan
