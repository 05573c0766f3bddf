"""Reports on a small star schema, and the SQL surface against the functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans import reports as R


@pytest.fixture(scope="module")
def star(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [
        (1, 10, 1, 100, day), (1, 12, 1, 101, day), (1, 12, 1, 101, day), (1, 30, 1, 100, day + dt.timedelta(days=1)),
        (2, 7, 2, 100, day), (2, None, 2, None, day), (3, 99, 3, 102, day), (4, None, 9, 103, day), (5, 50, None, 104, day),
        (9, 1000, 1, 100, day),  # not in the product dimension
    ]
    fact = spark.createDataFrame(rows, "urlId int, sold int, brandId long, sellerId long, timestamp timestamp")
    return {
        "productSnapshotFact": fact.withColumn("date", F.to_date("timestamp")),
        "productDim": spark.createDataFrame(
            [(1, "one", "a"), (2, "two", "a"), (3, "three", "b"), (4, "four", None), (5, "five", None), (6, "six", None)],
            "urlId int, title string, category string"),
        "brandDim": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (9, "w")], "brandId long, brand string"),
        "sellerDim": spark.createDataFrame([(100, "s"), (101, "t"), (102, "u"), (103, "v")], "sellerId long, seller string"),
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals(star):
    assert rows(R.total_products(star["productDim"])) == [(6,)]
    assert rows(R.total_brands(star["brandDim"])) == [(4,)]
    assert rows(R.total_sellers(star["sellerDim"])) == [(4,)]


def test_categories_keep_the_null_group(star):
    assert rows(R.top_categories(star["productDim"], 2)) == [(None, 3), ("a", 2)]
    share = rows(R.category_share(star["productDim"], 2))
    assert share == [(None, 3, 0.6), ("a", 2, 0.4)]


def test_potential_products(star):
    fact, dim = star["productSnapshotFact"], star["productDim"]
    want = [("three", 99, 1), ("five", 50, 1), ("two", 7, 1), ("four", None, 1), ("two", None, 1),
            ("one", 30, 4), ("one", 12, 4), ("one", 12, 4), ("one", 10, 4)]
    for n in (1, 3, 5, 7, 8, 50):
        assert rows(R.potential_products(fact, dim, n)) == want[:n]
    distinct = rows(R.potential_products(fact, dim, 50, mode="distinct"))
    assert distinct == [(t, s, 2 if t == "one" else 1) for t, s, _ in want]
    with pytest.raises(ValueError):
        R.seller_counts(fact, "other")


def test_sold_sums_count_each_product_once_unless_history(star):
    fact = star["productSnapshotFact"]
    assert rows(R.top_sold_sellers(fact, star["sellerDim"], 9)) == [("s", 1037), ("u", 99), ("v", None)]
    assert rows(R.top_sold_sellers(fact, star["sellerDim"], 9, history=True)) == [("s", 1047), ("u", 99), ("t", 24), ("v", None)]
    assert rows(R.top_sold_sellers(fact, star["sellerDim"], 9, as_of="2026-01-01")) == [
        ("s", 1017), ("u", 99), ("t", 24), ("v", None)]
    assert rows(R.top_sold_brands(fact, star["brandDim"], 2, history=True)) == [("x", 1064), ("z", 99)]


def test_two_keys_with_one_name_are_added_up(spark, star):
    dim = spark.createDataFrame([(100, "s"), (101, "s")], "sellerId long, seller string")
    assert rows(R.top_sold_sellers(star["productSnapshotFact"], dim, 9, history=True)) == [("s", 1071)]


@pytest.mark.parametrize("n", [1, 4, 20])
def test_sql_surface_equals_functions(spark, star, n):
    fact = star["productSnapshotFact"]
    same = {
        "total_products": R.total_products(star["productDim"]),
        "total_brands": R.total_brands(star["brandDim"]),
        "total_sellers": R.total_sellers(star["sellerDim"]),
        "top_categories": R.top_categories(star["productDim"], n),
        "potential_products": R.potential_products(fact, star["productDim"], n),
        "top_sold_brands": R.top_sold_brands(fact, star["brandDim"], n),
        "top_sold_sellers": R.top_sold_sellers(fact, star["sellerDim"], n),
    }
    assert set(same) == set(R.REPORT_SQL)
    for name, df in same.items():
        assert rows(R.run_report(spark, name, star, n)) == rows(df), name
    for options in ({"history": True}, {"as_of": "2026-01-01"}):
        df = R.top_sold_sellers(fact.withColumn("date", F.to_date("timestamp")), star["sellerDim"], n, **options)
        tables = {**star, "productSnapshotFact": fact.withColumn("date", F.to_date("timestamp"))}
        assert rows(R.run_report(spark, "top_sold_sellers", tables, n, **options)) == rows(df), options


def test_top_n_is_a_bounded_sort(star):
    plan = R.top_sold_sellers(star["productSnapshotFact"], star["sellerDim"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_titles(star):
    assert R.with_titles(R.top_categories(star["productDim"], 1)).columns == ["Category", "Count"]
    shown = R.with_titles(R.potential_products(star["productSnapshotFact"], star["productDim"], 1))
    assert shown.columns == ["Product", "Sold", "Seller Count"]
