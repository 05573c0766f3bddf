"""Cumulative counters on a stream: resets, late rows and a restart give what the table gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfwatch.operators.align import align_delta
from shelfwatch.streaming.align_stream import STATE_STORE, align_stream, write_series_stream

ONCE = {"availableNow": True}
T0 = dt.datetime(2026, 1, 1)
SCHEMA = "host string, disk string, ts timestamp, metric_value double"


def counters(seed):
    """Points of five series, with resets, gaps, equal times and values that are missing."""
    rng = random.Random(seed)
    rows = []
    for host, disk in (("a", "x"), ("a", None), ("b", "x"), (None, None), ("c", "y")):
        total = 0.0
        for second in range(0, 3600, rng.choice((20, 45, 70))):
            if host == "b" and 1000 < second < 1900:
                continue
            total = 0.0 if rng.random() < 0.03 else total + rng.randrange(9)
            at = T0 + dt.timedelta(seconds=second)
            rows.append((host, disk, at, total if rng.random() > 0.05 else None))
            if rng.random() < 0.1:
                rows.append((host, disk, at, total + 1))
    return rows


def test_counter_stream_equals_table(spark, tmp_path):
    rng = random.Random(2)
    rows = counters(1)
    # Dealt to files by time with up to four minutes of delay, so rows come late but not too late.
    parts = [[] for _ in range(6)]
    for row in rows:
        seen = (row[2] - T0).total_seconds() + rng.randrange(240)
        parts[min(5, int(seen // 640))].append(row)
    source, path, state = (str(tmp_path / n) for n in ("source", "series", "state"))
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Every file is a start of its own: the stream goes on from its checkpoint.
        points = spark.readStream.schema(SCHEMA).parquet(source)
        held = spark.conf.get(STATE_STORE)
        stream = align_stream(points, ["host", "disk"], late="5 minutes", aligner="delta", kind="cumulative")
        write_series_stream(stream, path, state, ONCE).awaitTermination()
        assert spark.conf.get(STATE_STORE) == held
    got = spark.read.parquet(path)
    newest = max(r[2] for r in rows)
    want = align_delta(spark.createDataFrame(rows, SCHEMA), ["host", "disk"], kind="cumulative").where(
        F.col("timestamp") <= F.lit(newest - dt.timedelta(minutes=5)))
    key = lambda r: (r["timestamp"], str(r["host"]), str(r["disk"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == got.count() > 200
    falls = [r["metric_value"] for r in got.collect() if r["metric_value"] is not None and r["metric_value"] < 0]
    assert falls == []


def test_other_kinds_are_as_before(spark, tmp_path):
    rows = [("a", "x", T0 + dt.timedelta(seconds=30 * i), float(i)) for i in range(100)]
    source = str(tmp_path / "source")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = align_stream(spark.readStream.schema(SCHEMA).parquet(source), ["host"], aligner="delta")
    write_series_stream(stream, str(tmp_path / "sums"), str(tmp_path / "state"), ONCE).awaitTermination()
    want = align_delta(spark.createDataFrame(rows, SCHEMA), ["host"]).where(F.col("timestamp") <= F.lit(rows[-1][2] - dt.timedelta(minutes=10)))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "sums")).collect())) == sorted(map(tuple, want.collect()))


def test_many_series_share_an_entry_of_state(spark, tmp_path):
    """Long ids, with NULL among them, and lists as names; every series goes on from its own last value after a restart."""
    schema = "id long, tags array<string>, ts timestamp, metric_value double"
    # A series per id; each file has two buckets of each, in no order of time, and the second counts on from the first.
    big = 2**60
    rows = [[(None if i == 7 else big + i, [None, [], ["a, b"], ["a", "b"], [None]][i % 5], T0 + dt.timedelta(minutes=30 * part + m), float(i % 13 + (7 * i + 3 * part + m) % 5))
             for m in (1, 0) for i in range(4000)] for part in range(3)]
    source, path, state = (str(tmp_path / n) for n in ("source", "series", "state"))
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = align_stream(spark.readStream.schema(schema).parquet(source), ["id", "tags"], aligner="delta", kind="cumulative")
        query = write_series_stream(stream, path, state, ONCE)
        query.awaitTermination()
    kept = [op.numRowsTotal for op in query.recentProgress[-1].stateOperators if "transformWithState" in op.operatorName]
    assert len(kept) == 1 and 0 < kept[0] < 4000
    want = align_delta(spark.createDataFrame(sum(rows, []), schema), ["id", "tags"], kind="cumulative").where(
        F.col("timestamp") <= F.lit(T0 + dt.timedelta(minutes=60 + 1 - 10)))
    got = spark.read.parquet(path).select(*want.columns)
    assert got.count() == 16000 and want.exceptAll(got).isEmpty()
