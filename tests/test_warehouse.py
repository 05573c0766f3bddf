"""Snapshots, dimensions and the daily load."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import dimensions as D
from shelfwatch.operators.snapshot import latest_snapshot, snapshot_change
from shelfwatch.plans.daily_load import run_daily
from shelfwatch.schemas import BRAND_DIM, CRAWL_ROW, LAKE_ROW, SNAPSHOT_FACT, conform
from shelfwatch.sources import warehouse as W
from shelfwatch.sources.lake import append_lake, read_day


def at(day, hour=0, minute=0):
    return dt.datetime(2026, 1, day, hour, minute)


def crawl(spark, rows):
    """Rows of (urlId, brand, origin, seller, rate, sold, timestamp) as lake rows."""
    df = spark.createDataFrame(
        rows, "urlId int, brand string, brandOrigin string, seller string, sellerRate double, sold int, timestamp timestamp")
    df = df.withColumn("title", F.concat(F.lit("product "), F.col("urlId").cast("string")))
    return conform(df.withColumn("date", F.to_date("timestamp")), LAKE_ROW)


SNAPSHOTS = [(1, 10, at(1)), (1, 11, at(2)), (1, 12, at(2)), (2, 5, at(1)), (2, 6, None), (3, 7, None), (None, 1, at(1))]


def test_latest_snapshot_keeps_ties(spark):
    df = spark.createDataFrame(SNAPSHOTS, "urlId int, sold int, timestamp timestamp")
    kept = {(r["urlId"], r["sold"]) for r in latest_snapshot(df).collect()}
    assert kept == {(1, 11), (1, 12), (2, 5), (3, 7), (None, 1)}


def test_latest_snapshot_one_row_per_key(spark):
    df = spark.createDataFrame(SNAPSHOTS, "urlId int, sold int, timestamp timestamp")
    one = latest_snapshot(df, ties="one", tie_break=["sold"])
    assert {(r["urlId"], r["sold"]) for r in one.collect()} == {(1, 11), (2, 5), (3, 7), (None, 1)}
    with pytest.raises(ValueError):
        latest_snapshot(df, ties="some")


def skewed(spark):
    """One product holds a third of the rows, many of them at one instant."""
    base = F.lit(at(1)).cast("timestamp")
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 700 + 2)).cast("int").alias("urlId"),
        F.timestamp_add("MINUTE", (F.col("id") * 7919 % 5000).cast("int"), base).alias("timestamp"),
        (F.col("id") % 97).cast("double").alias("price"), F.col("id").alias("n"))
    return rows


@pytest.mark.parametrize("hot", ["1", "null", "no"])
def test_snapshot_change_matches_brute_force(spark, hot):
    """With nine tenths of the rows on one product, on NULL, or as they are."""
    df = skewed(spark)
    if hot != "no":
        key = F.lit(1 if hot == "1" else None).cast("int")
        df = df.withColumn("urlId", F.when(F.col("n") % 10 > 0, key).otherwise(F.col("urlId")))
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["urlId"]].append((r["timestamp"], r["n"], r["price"]))
    want = {}
    for rows in groups.values():
        previous = None
        for _, n, price in sorted(rows):
            want[n] = (previous, None if previous is None else price - previous)
            previous = price
    out = snapshot_change(df, ["price"], tie_break=["n"], deltas=["price"])
    got = {r["n"]: (r["prev_price"], r["price_delta"]) for r in out.collect()}
    assert got == want


def test_snapshot_change_with_a_group_of_copies(spark):
    """A third of all rows are copies of one snapshot; each follows the one before it."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 50 + 1)).cast("int").alias("urlId"),
        F.when(F.col("id") % 3 == 0, F.lit(at(3))).otherwise(
            F.timestamp_add("HOUR", (F.col("id") % 100).cast("int"), F.lit(at(1)).cast("timestamp"))).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 11).cast("double")).alias("price"))
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r["urlId"]].append((r["timestamp"], r["price"]))
    want = sorted((key, t, price, values[i - 1][1] if i else -1.0)
                  for key, values in ((k, sorted(v)) for k, v in groups.items())
                  for i, (t, price) in enumerate(values))
    out = snapshot_change(rows, ["price"]).na.fill(-1.0, ["prev_price"])
    assert sorted(tuple(r) for r in out.collect()) == want


def test_snapshot_change_keeps_null_values(spark):
    rows = [(1, None, at(1, 0)), (1, 5.0, at(1, 1)), (1, None, at(1, 2)), (1, 7.0, at(1, 3)), (None, 1.0, at(1)), (None, 2.0, at(2))]
    df = spark.createDataFrame(rows, "urlId int, price double, timestamp timestamp")
    out = snapshot_change(df, ["price"]).collect()
    assert {(r["urlId"], r["timestamp"]): r["prev_price"] for r in out} == {
        (1, at(1, 0)): None, (1, at(1, 1)): None, (1, at(1, 2)): 5.0, (1, at(1, 3)): None,
        (None, at(1)): None, (None, at(2)): 1.0}


def test_snapshot_change_leaves_values_as_they_are(spark):
    df = spark.createDataFrame([(1, -0.0, at(1)), (1, 0.0, at(2)), (1, -0.0, at(3))], "urlId int, price double, timestamp timestamp")
    out = sorted(snapshot_change(df, ["price"]).collect(), key=lambda r: r["timestamp"])
    assert [str(r["price"]) for r in out] == ["-0.0", "0.0", "-0.0"] and [str(r["prev_price"]) for r in out] == ["None", "-0.0", "0.0"]


def test_dimensions_take_newest_then_lowest_id(spark):
    rows = crawl(spark, [
        (3, "A", "old", "s", 1.0, 1, at(1)), (2, "A", "two", "s", 2.0, 1, at(2)), (1, "A", "one", "s", 3.0, 1, at(2)),
        (4, "", "", "t", None, 1, at(1))])
    brands = {r["brand"]: r["brandOrigin"] for r in D.brand_dim(rows).collect()}
    assert brands == {"A": "one", "": ""}
    sellers = {r["seller"]: r["sellerRate"] for r in D.seller_dim(rows).collect()}
    assert sellers == {"s": 3.0, "t": None}


def test_merge_is_independent_of_order(spark):
    first = D.brand_dim(crawl(spark, [(1, "A", "x", "s", 1.0, 1, at(1)), (2, "B", "b", "s", 1.0, 1, at(1))]))
    second = D.brand_dim(crawl(spark, [(1, "A", "y", "s", 1.0, 1, at(2)), (3, "C", "c", "s", 1.0, 1, at(2))]))
    a = D.merge_dimension(first, second, "brand").select("brand", "brandOrigin").collect()
    b = D.merge_dimension(second, first, "brand").select("brand", "brandOrigin").collect()
    assert sorted(a) == sorted(b) == [("A", "y"), ("B", "b"), ("C", "c")]
    assert D.merge_dimension(None, first, "brand") is first


def test_derived_keys_equal_looked_up_keys(spark):
    rows = crawl(spark, [(i, f"b{i % 3}" if i % 4 else "", "o", f"s{i % 5}", 1.0, 1, at(1)) for i in range(40)])
    looked = D.lookup_key(rows, D.brand_dim(rows), "brand", "brandId")
    looked = D.lookup_key(looked, D.seller_dim(rows), "seller", "sellerId")
    columns = ["urlId", "brandId", "sellerId"]
    assert sorted(looked.select(columns).collect()) == sorted(D.derive_keys(rows).select(columns).collect())
    unknown = D.lookup_key(rows, D.brand_dim(rows).where("brand = 'b1'"), "brand", "brandId")
    assert unknown.where("brand <> 'b1' and brandId is not null").count() == 0


def test_conform_fills_and_requires(spark):
    df = spark.createDataFrame([(None, 5)], "brand string, extra int")
    with pytest.raises(ValueError):
        conform(df, BRAND_DIM)
    row = conform(df.withColumn("brandId", F.lit(1)), BRAND_DIM).first()
    assert row.asDict() == {"brand": "", "brandOrigin": "", "brandId": 1}
    assert conform(df.withColumn("brandId", F.lit(None).cast("long")), BRAND_DIM).count() == 0
    assert conform(df.withColumn("urlId", F.lit(1)).withColumn("timestamp", F.lit(at(1))), CRAWL_ROW).columns == CRAWL_ROW.fieldNames()


DAY1 = [(1, "A", "x", "s", 4.0, 10, at(1, 1)), (1, "A", "x", "s", 4.1, 11, at(1, 5)), (2, "B", "b", "t", 3.0, 5, at(1, 2))]
DAY2 = [(1, "A", "y", "s", 4.5, 12, at(2, 1)), (1, "A", "y", "s", 4.5, 13, at(2, 1)), (3, "C", "c", "u", None, 1, at(2, 3))]


def tables(spark, path):
    fact = W.read_fact(spark, path)
    return {
        "fact": sorted(fact.select("date", "urlId", "sold", "brandId", "sellerId").collect()),
        "brands": sorted(W.read_dimension(spark, path, "brandDim").collect()),
        "sellers": sorted(W.read_dimension(spark, path, "sellerDim").select("seller", "sellerRateCount", "sellerId").collect()),
        "products": sorted(W.read_dimension(spark, path, "productDim").select("urlId", "title").collect()),
    }


def test_daily_load_history_idempotence_and_order(spark, tmp_path):
    lake = str(tmp_path / "lake")
    append_lake(crawl(spark, DAY1 + DAY2), lake)
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    assert W.read_dimension(spark, one, "brandDim").count() == 0

    run_daily(spark, lake, one, "2026-01-01")
    first = tables(spark, one)
    assert [(str(r["date"]), r["urlId"], r["sold"]) for r in first["fact"]] == [("2026-01-01", 1, 11), ("2026-01-01", 2, 5)]
    run_daily(spark, lake, one, "2026-01-01")
    assert tables(spark, one) == first

    run_daily(spark, lake, one, "2026-01-02")
    both = tables(spark, one)
    assert [(r["date"].day, r["urlId"], r["sold"]) for r in both["fact"]] == [(1, 1, 11), (1, 2, 5), (2, 1, 12), (2, 1, 13), (2, 3, 1)]
    assert [(r["brand"], r["brandOrigin"]) for r in both["brands"]] == [("A", "y"), ("B", "b"), ("C", "c")]
    run_daily(spark, lake, one, "2026-01-01")
    assert tables(spark, one) == both

    for day in ("2026-01-02", "2026-01-01"):
        run_daily(spark, lake, other, dt.date.fromisoformat(day))
    assert tables(spark, other) == both

    fact = W.read_fact(spark, one)
    assert [f.name for f in fact.schema] == SNAPSHOT_FACT.fieldNames()
    for name, key in (("brandDim", "brandId"), ("sellerDim", "sellerId"), ("productDim", "urlId")):
        dim = W.read_dimension(spark, one, name)
        assert dim.count() == dim.select(key).distinct().count()
        assert fact.join(dim, key, "left_anti").count() == 0
    assert not spark.sparkContext._jsc.getPersistentRDDs()

    names = ["brandDim", "sellerDim", "productDim", "productSnapshotFact"]
    W.export_tables(spark, one, {name: str(tmp_path / "export" / name) for name in names})
    counts = {name: spark.read.parquet(str(tmp_path / "export" / name)).count() for name in names}
    assert counts == {"brandDim": 3, "sellerDim": 3, "productDim": 3, "productSnapshotFact": 5}


def test_daily_load_one_row_per_tie(spark, tmp_path):
    lake, warehouse = str(tmp_path / "lake"), str(tmp_path / "w")
    append_lake(crawl(spark, DAY2), lake)
    run_daily(spark, lake, warehouse, "2026-01-02", ties="one")
    assert [(r["urlId"], r["sold"]) for r in sorted(W.read_fact(spark, warehouse).select("urlId", "sold").collect())] == [(1, 12), (3, 1)]


def test_a_failed_load_leaves_the_current_dimension(spark, tmp_path):
    path = str(tmp_path)
    rows = D.brand_dim(crawl(spark, DAY1))
    W.merge_into_dimension(spark, path, "brandDim", rows)
    before = W.read_dimension(spark, path, "brandDim").collect()
    broken = rows.withColumn("brandOrigin", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        W.merge_into_dimension(spark, path, "brandDim", broken)
    assert W.read_dimension(spark, path, "brandDim").collect() == before
    W.merge_into_dimension(spark, path, "brandDim", rows)
    assert sorted(W.read_dimension(spark, path, "brandDim").collect()) == sorted(before)


def test_a_load_that_dies_between_data_and_commit_is_not_read(spark, tmp_path, monkeypatch):
    """Files of the other slot are in place, in part or in full, but no commit line names them."""
    path = str(tmp_path)
    W.merge_into_dimension(spark, path, "brandDim", D.brand_dim(crawl(spark, DAY1)))
    before = sorted(W.read_dimension(spark, path, "brandDim").collect())
    later = D.brand_dim(crawl(spark, DAY2))
    monkeypatch.setattr(spark, "range", lambda *a, **b: 1 / 0)  # the commit line cannot be written
    with pytest.raises(ZeroDivisionError):
        W.merge_into_dimension(spark, path, "brandDim", later)
    monkeypatch.undo()
    assert sorted(W.read_dimension(spark, path, "brandDim").collect()) == before
    W.merge_into_dimension(spark, path, "brandDim", D.brand_dim(crawl(spark, DAY2)))
    assert {r["brand"] for r in W.read_dimension(spark, path, "brandDim").collect()} == {"A", "B", "C"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path)
    many = [(i, f"brand {i}", "x", "s", 1.0, 1, at(1)) for i in range(40)]
    W.merge_into_dimension(spark, path, "brandDim", D.brand_dim(crawl(spark, many)))
    W.merge_into_dimension(spark, path, "brandDim", D.brand_dim(crawl(spark, [(7, "brand 7", "y", "s", 1.0, 1, at(2))])))
    commits = spark.read.parquet(f"{path}/brandDim/commits").collect()
    assert sorted(r["loadNo"] for r in commits) == [1] * W.BUCKETS["brandDim"] + [2]
    rows = {r["brand"]: r["brandOrigin"] for r in W.read_dimension(spark, path, "brandDim").collect()}
    assert len(rows) == 40 and rows["brand 7"] == "y" and rows["brand 8"] == "x"


def test_dimensions_come_before_the_fact(spark, tmp_path, monkeypatch):
    from shelfwatch.plans import daily_load

    lake, warehouse = str(tmp_path / "lake"), str(tmp_path / "w")
    append_lake(crawl(spark, DAY1 + DAY2), lake)
    run_daily(spark, lake, warehouse, "2026-01-01")
    monkeypatch.setattr(daily_load, "load_fact", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_daily(spark, lake, warehouse, "2026-01-02")
    fact = W.read_fact(spark, warehouse)
    for name, key in (("brandDim", "brandId"), ("sellerDim", "sellerId"), ("productDim", "urlId")):
        assert fact.join(W.read_dimension(spark, warehouse, name), key, "left_anti").count() == 0


def test_wide_texts_are_left_in_the_lake():
    from shelfwatch.plans.daily_load import NEEDED

    assert not {"description", "additionalInfo", "categoryTree"} & set(NEEDED)


def test_conform_does_not_fail_on_text_for_a_number(spark):
    df = spark.createDataFrame([("x", "1", at(1)), ("7", "y", at(1))], "urlId string, sold string, timestamp timestamp")
    assert [(r["urlId"], r["sold"]) for r in conform(df, CRAWL_ROW).collect()] == [(7, None)]


def test_missing_day_is_an_error_and_other_days_are_not_listed(spark, tmp_path):
    lake = str(tmp_path)
    append_lake(crawl(spark, DAY1 + DAY2), lake)
    assert all("date=2026-01-02" in f for f in read_day(spark, lake, "2026-01-02").inputFiles())
    assert {str(r["date"]) for r in read_day(spark, lake, "2026-01-02").collect()} == {"2026-01-02"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_day(spark, lake, "2026-02-01")


def test_overwrite_table_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    W.overwrite_table(spark.range(5), path)
    W.overwrite_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
