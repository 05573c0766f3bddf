"""Validity intervals give what aggregating the history gives, whatever the order of loads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch import session
from shelfwatch.operators.dimensions import brand_dim, derive_keys, snapshot_fact
from shelfwatch.plans import reports as R
from shelfwatch.plans.validity import COLUMNS, OPEN, snapshots_valid, update_validity
from shelfwatch.registry import warehouse as registered
from shelfwatch.registry.tables import crawl_rows
from shelfwatch.sources import slots, warehouse as W

D0 = dt.date(2026, 1, 1)


def fact_rows(seed, days):
    rng = random.Random(seed)
    rows = []
    for day in days:
        for url in rng.sample(range(12), rng.randrange(2, 9)):
            at = dt.datetime.combine(D0 + dt.timedelta(days=day), dt.time(rng.randrange(24)))
            for _ in range(rng.choice((1, 1, 2))):  # ties
                rows.append((url, rng.randrange(100), at, at.date(), rng.randrange(3), rng.randrange(4)))
    return rows


def frame(spark, rows):
    return snapshot_fact(spark.createDataFrame(rows, "urlId long, sold int, timestamp timestamp, date date, brandId long, sellerId long"))


def plain(rows, as_of=None):
    rows = [r for r in rows if as_of is None or r[3] <= as_of]
    newest = {}
    for r in rows:
        newest[r[0]] = max(newest.get(r[0], r[2]), r[2])
    return sorted((r[0], r[2], r[4], r[5], r[1], r[3]) for r in rows if r[2] == newest[r[0]])


def got(spark, path, as_of=None):
    return sorted(tuple(r) for r in snapshots_valid(spark, path, as_of).select(*COLUMNS).collect())


def test_loads_in_any_order_and_again(spark, tmp_path):
    path = str(tmp_path)
    days = fact_rows(1, range(6))
    of = lambda d: [r for r in days if r[3] == D0 + dt.timedelta(days=d)]
    loaded = {}
    second = [r for r in fact_rows(9, [2])]  # another version of a day: other products, other values
    for day, rows in ((0, of(0)), (1, of(1)), (5, of(5)), (3, of(3)), (2, of(2)), (2, second), (4, of(4)), (0, of(0)), (5, of(5)[:1])):
        update_validity(frame(spark, rows), path, D0 + dt.timedelta(days=day))
        loaded[day] = rows
        held = [r for rows in loaded.values() for r in rows]
        assert got(spark, path) == plain(held)
    for day in (-1, *range(7)):
        as_of = D0 + dt.timedelta(days=day)
        assert got(spark, path, as_of) == plain(held, as_of)


def test_reports_read_open_intervals_only(spark, tmp_path):
    """No aggregate over the history: the newest rows are a pruned folder, reduced by key alone."""
    path = str(tmp_path)
    rows = fact_rows(3, range(4))
    for day in range(4):
        update_validity(frame(spark, rows), path, D0 + dt.timedelta(days=day))
    dim = spark.createDataFrame([(i, f"b{i}") for i in range(3)], "brandId long, brand string")
    for as_of in (None, D0 + dt.timedelta(days=2)):
        report = R.top_sold_brands(snapshots_valid(spark, path, as_of), dim, 5, history=True)
        want = R.top_sold_brands(frame(spark, rows), dim, 5, as_of=as_of)
        assert report.collect() == want.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "keys=[urlId" not in plan and "PartitionFilters: [" in plan
    files = [r[0] for r in snapshots_valid(spark, path).select(F.input_file_name()).distinct().collect()]
    assert files and all(f"validTo={OPEN}" in f for f in files)


def test_a_day_of_the_fact_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    root = f"{path}/productSnapshotFact"
    first, other = fact_rows(1, [0, 1]), fact_rows(2, [1])
    W.load_fact(frame(spark, first), root)
    before = sorted(W.read_fact(spark, path).collect())
    monkeypatch.setattr(spark, "range", lambda *a, **b: 1 / 0)  # dies when data are in place, before the commit line
    with pytest.raises(ZeroDivisionError):
        W.load_fact(frame(spark, other), root)
    monkeypatch.undo()
    assert sorted(W.read_fact(spark, path).collect()) == before
    # In the middle of the commit of files: only some of the new slot are there.
    part = frame(spark, other).limit(1).withColumn("slot", F.lit("b"))
    part.write.mode("append").partitionBy("date", "slot").parquet(f"{root}/rows")
    assert sorted(W.read_fact(spark, path).collect()) == before
    W.load_fact(frame(spark, other), root)
    kept = [r for r in first if r[3] == D0]
    assert sorted(W.read_fact(spark, path).collect()) == sorted(frame(spark, [*kept, *other]).collect())
    assert len(slots.current_parts(spark, root)) == 2


def test_day_filters_prune_folders(spark, tmp_path):
    path = str(tmp_path)
    W.load_fact(frame(spark, fact_rows(1, range(4))), f"{path}/productSnapshotFact")
    one = W.read_fact(spark, path).where(F.col("date") == F.lit(D0))
    assert {str(r["date"]) for r in one.collect()} == {str(D0)}
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    assert W.read_fact(spark, str(tmp_path / "none")).count() == 0


def test_loads_read_their_year_and_broadcast_no_products(spark, tmp_path, monkeypatch):
    """Millions of keys are few bytes in a file and hundreds of megabytes in the driver."""
    d = str(tmp_path)
    spark.range(20).selectExpr("id AS p_partkey", "concat('p', id) AS p_name", "concat('b', id % 3) AS p_brand", "'t' AS p_type", "1 AS p_size",
                               "1.0D AS p_retailprice").write.parquet(f"{d}/part.parquet")
    spark.range(4).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{d}/supplier.parquet")
    spark.range(400).selectExpr("id AS l_orderkey", "id % 23 AS l_partkey", "id % 5 AS l_suppkey", "1 AS l_linenumber", "CAST(id % 7 AS double) AS l_quantity",
                                "1.0D AS l_extendedprice", "0.1D AS l_discount", "0.1D AS l_tax", "'r' AS l_returnflag", "'o' AS l_linestatus",
                                "timestamp'1992-03-01 00:00:00' + make_interval(id % 6, id % 5) AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    want = R.top_sold_brands(*registered_rows(spark, d), 10).collect()
    assert len(want) == 3
    monkeypatch.setattr(registered, "MOST_KEYS", 0)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    days = []
    monkeypatch.setattr(registered, "update_validity", lambda rows, *a: days.append(rows._jdf.queryExecution().toString()) or update_validity(rows, *a))
    report = registered.top_sold_brands_valid(spark, d)
    assert report.collect() == want
    assert len(days) == 7 and not any("partkey" in plan for plan in days)
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_" not in plan


def registered_rows(spark, d):
    rows = derive_keys(crawl_rows(spark, d)).withColumn("date", F.to_date("timestamp"))
    return rows, brand_dim(rows)
