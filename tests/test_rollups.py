"""A series from rollups is the series from raw points, for all periods, offsets and ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.align import align_delta, align_mean
from shelfwatch.plans import rollups as U

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "metric_type string, host string, disk string, ts timestamp, metric_value double"
CPU, NET = "agent/cpu/load_1m", "net/sent_bytes"


def points(seed=1):
    rng = random.Random(seed)
    return [(rng.choice((CPU, NET)), rng.choice("ab"), rng.choice(("x", None)), T0 + dt.timedelta(microseconds=rng.randrange(3 * 86_400 * 10**6)),
             float(rng.randrange(50)) if rng.random() > 0.1 else None) for _ in range(1500)]


@pytest.fixture(scope="module")
def rolled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollups"))
    raw = spark.createDataFrame(points(), SCHEMA).coalesce(2).cache()
    for day in (2, 0, 1, 0):  # any order, and one again
        at = T0 + dt.timedelta(days=day)
        U.roll_up(raw.where((F.col("ts") >= F.lit(at)) & (F.col("ts") < F.lit(at + dt.timedelta(days=1)))), path, ["host", "disk"])
    return raw, path


RANGES = [(T0, T0 + dt.timedelta(days=3)), (T0 + dt.timedelta(hours=5, minutes=7, seconds=3, microseconds=9), T0 + dt.timedelta(days=2, hours=1, seconds=40)),
          (T0 + dt.timedelta(minutes=1, seconds=10), T0 + dt.timedelta(minutes=1, seconds=50)), (T0 + dt.timedelta(days=9), T0 + dt.timedelta(days=9))]


@pytest.mark.parametrize("period,offset", [(60, 0), (300, 60), (3600, 0), (7200, 1800), (86400, 0), (86400, 3600), (2 * 86400, 86400), (45, 0), (90, 30)])
def test_equal_to_raw_series(rolled, period, offset):
    raw, path = rolled
    for i, (start, end) in enumerate(RANGES):
        if i and period in (45, 300, 2 * 86400):
            continue
        own = raw.where((F.col("metric_type") == CPU) & (F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
        align = {"period": f"{period} seconds", "offset": f"{offset} seconds" if offset else None}
        for aligner, kind, want in (("mean", "delta", align_mean(own, ["host", "disk"], **align)), ("delta", "delta", align_delta(own, ["host", "disk"], **align)),
                                    ("delta", "cumulative", align_delta(own, ["host", "disk"], kind="cumulative", **align))):
            got = U.rolled_series(raw, path, CPU, ["host", "disk"], start, end, period, offset, aligner, kind)
            digits = lambda df: sorted((tuple(r) for r in df.withColumn("metric_value", F.round("metric_value", 6)).collect()), key=str)
            assert digits(got) == digits(want), (period, offset, aligner, kind, i)


def test_levels_and_edges():
    assert [U.level_for(*x) for x in ((60, 0), (90, 30), (3600, 60), (7200, 3600), (86400, 3600), (86400, 0))] == ["minute", None, "minute", "hour", "hour", "day"]
    found = U.pieces(T0 + dt.timedelta(hours=5, minutes=7, seconds=3), T0 + dt.timedelta(days=2, hours=1, seconds=40), "day")
    assert [p[0] for p in found] == [None, "minute", "hour", "day", "hour", None]
    assert all(a[2] == b[1] for a, b in zip(found, found[1:]))
    assert U.pieces(T0, T0, "day") == []


def test_scans_are_pruned(rolled, spark):
    raw, path = rolled
    start, end = T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2) - dt.timedelta(microseconds=1)
    series = U.rolled_series(raw, path, CPU, ["host", "disk"], start, end, 86400)
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert plan.count("FileScan") == 1 and "InMemoryTableScan" not in plan and "level=day" in plan
    assert series.count() == 4
    files = U._read(spark, path, "day", ["host", "disk"], lambda day, share: day == "2026-01-02").select(F.input_file_name()).distinct().collect()
    assert files and all("part=2026-01-02." in f[0] for f in files)


def test_a_day_loaded_again_forgets_metrics_it_no_longer_has(spark, tmp_path):
    rows = [(CPU, "a", "x", T0, 1.0), (NET, "a", "x", T0, 2.0), (NET, "a", "x", T0 + dt.timedelta(days=1), 4.0)]
    raw = spark.createDataFrame(rows, SCHEMA)
    U.roll_up(raw, str(tmp_path), ["host", "disk"])
    left = spark.createDataFrame(rows[:1], SCHEMA)
    U.roll_up(left, str(tmp_path), ["host", "disk"])
    got = U.rolled_series(left, str(tmp_path), NET, ["host", "disk"], T0, T0 + dt.timedelta(days=3), 60)
    assert [r["metric_value"] for r in got.collect()] == [4.0]
