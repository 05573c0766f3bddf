"""Reports and pages as SQL table functions."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from shelfwatch.operators.extract import PRODUCT_SELECTORS, extract_products
from shelfwatch.operators.page_function import page_function, product_rows, register_page_functions
from shelfwatch.operators.selectors import Selector
from shelfwatch.plans import reports as R
from shelfwatch.plans.report_functions import create_report_functions

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(u, T0 + dt.timedelta(days=t), (T0 + dt.timedelta(days=t)).date(), s % 3 if s else None, s, sold)
            for u in range(8) for t in range(4) for s, sold in ((u % 4, 10 * t + u), (None, u), (u % 4, None)) if (u + t) % 3]
    fact = spark.createDataFrame(rows, "urlId long, timestamp timestamp, date date, brandId long, sellerId long, sold int")
    names = lambda n, text: spark.createDataFrame([(i, f"{text}{i}") for i in range(n)], f"{text}Id long, {text} string")
    products = spark.createDataFrame([(i, f"t{i // 2}", None if i == 3 else f"c{i % 3}") for i in range(8)], "urlId long, title string, category string")
    return {"productSnapshotFact": fact, "productDim": products, "brandDim": names(3, "brand"), "sellerDim": names(4, "seller")}


def test_functions_equal_reports(spark, tables):
    create_report_functions(spark, tables)
    sql = lambda text: [tuple(r) for r in spark.sql(f"SELECT * FROM {text}").collect()]
    rows = lambda df: [tuple(r) for r in df.collect()]
    fact = tables["productSnapshotFact"]
    for n in (0, 1, 3, 50):
        assert sql(f"top_categories({n})") == rows(R.top_categories(tables["productDim"], n))
        assert sql(f"potential_products({n})") == rows(R.potential_products(fact, tables["productDim"], n)) if n else True
        for history, as_of in ((True, None), (False, None), (False, "2026-01-02"), (True, "2026-01-02"), (False, "2020-01-01")):
            options = f"{n}, {str(history).lower()}, {'NULL' if as_of is None else f'DATE{as_of!r}'}"
            assert sql(f"top_sold_brands({options})") == rows(R.top_sold_brands(fact, tables["brandDim"], n, history, as_of))
            assert sql(f"top_sold_sellers({options})") == rows(R.top_sold_sellers(fact, tables["sellerDim"], n, history, as_of))
    assert sql("total_products()") == [(8,)] and sql("total_brands()") == [(3,)] and sql("total_sellers()") == [(4,)]
    with pytest.raises(ValueError):
        create_report_functions(spark, {"productDim": tables["productDim"]})


def test_constants_are_folded(spark, tables):
    create_report_functions(spark, tables)
    plan = lambda text: spark.sql(f"SELECT * FROM {text}")._jdf.queryExecution().executedPlan().toString()
    assert "max(timestamp" not in plan("top_sold_brands(5, true)") and "Union" not in plan("top_sold_brands(5)")
    assert "TakeOrderedAndProject(limit=5" in plan("top_sold_brands(5)")


PAGE = ("<h1 class='sc-c0f8c612-0 dEurho'>tea</h1><del>1.000</del><a class='breadcrumb-item'>x</a><a class='breadcrumb-item'>y</a>"
        "<div><span>Made in</span><span>here</span></div><div><span>k</span><span>v</span></div>")
MESSAGES = [("1", PAGE), (" 2 ", None), ("3", ""), ("bad", PAGE), (None, PAGE), ("4", "<h1"), ("5", PAGE * 3)]


def test_page_function_equals_extraction(spark):
    messages = spark.createDataFrame([(i, h, T0, 1) for i, h in MESSAGES], "urlId string, html string, timestamp timestamp, other int")
    register_page_functions(spark)
    messages.createOrReplaceTempView("messages")
    want = extract_products(messages)
    got = product_rows(spark, "messages")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    whole = spark.sql("SELECT * FROM page_fields(TABLE(messages))")
    assert whole.columns == ["urlId", "timestamp", *PRODUCT_SELECTORS]
    parted = spark.sql("SELECT * FROM page_fields(TABLE(messages) PARTITION BY urlId)")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(parted) and whole.count() == 7


def test_schema_follows_the_selectors(spark):
    function = page_function({"t": Selector("h1"), "links": Selector("a", take="attribute", name="href"), "all": Selector("p", take="all")}, ["n"])
    spark.udtf.register("some_fields", function)
    spark.createDataFrame([(7, "<h1>x</h1><a href='/u'>y</a><p>1</p><p>2</p>")], "n long, html string").createOrReplaceTempView("some_pages")
    out = spark.sql("SELECT * FROM some_fields(TABLE(some_pages))")
    assert dict(out.dtypes) == {"n": "bigint", "t": "string", "links": "array<string>", "all": "array<string>"}
    assert tuple(out.first()) == (7, "x", ["/u"], ["1", "2"])
    with pytest.raises(AnalysisException, match="no column n"):
        spark.sql("SELECT * FROM some_fields(TABLE(SELECT html FROM some_pages))")
