"""Pages to crawl rows, on hand-written pages."""

import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import text as T
from shelfwatch.operators.extract import (
    DetailLabels,
    extract_links,
    extract_products,
    flat_links,
    flat_tag_text,
    flat_tag_texts,
    to_lake_rows,
)
from shelfwatch.operators.selectors import Selector, select_texts
from shelfwatch.schemas import CRAWL_ROW, MESSAGE
from shelfwatch.sources.messages import decode_messages, kafka_options, to_messages

NOW = dt.datetime(2026, 1, 1, 20, 0, 0)
LABELS = DetailLabels()

GOOD = f"""<html><head><title>t</title></head><body>
<h1 class="sc-c0f8c612-0 dEurho"> Bàn <b>gỗ</b></h1>
<a data-view-id="pdp_details_view_brand" href="/b">ACME</a>
<del>1.234.000</del><div class="product-price__discount-rate">-25%</div>
<div class="product-price__current-price">925,500</div>
<div class="sc-1a46a934-3 geGARt">Đã bán 12</div>
<div class="sc-1a46a934-1 dCjKzJ">4.9(123)</div>
<a class="breadcrumb-item">Home</a><a class="breadcrumb-item">Pets</a><a class="breadcrumb-item">Brushes</a>
<div><span>{LABELS.origin}</span><span>Việt Nam</span></div>
<div><span>{LABELS.made_in}</span><span>China</span></div>
<div><span>{LABELS.warranty}</span><span>Không</span></div>
<div><span>Size</span><span>XL</span></div>
<div class="sc-f5219d7f-0 haxTPb"><p>one</p><p> </p><p>two <i>2</i></p></div><p>three</p>
<span class="seller-name">Shop A</span><div class="item review">4.7(5.5k reviews)</div>
</body></html>"""


def extract(spark, *pages):
    rows = [(str(i), html, NOW) if not isinstance(html, tuple) else (*html, NOW) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "urlId string, html string, timestamp timestamp")
    return {r["urlId"]: r for r in extract_products(df).collect()}


def test_good_page(spark):
    row = extract(spark, GOOD)[0].asDict()
    assert row == {
        "urlId": 0, "title": "Bàngỗ", "brand": "ACME", "price": 1234000.0, "discount": 25.0,
        "sellPrice": 925500.0, "sold": 12, "productRate": 4.9, "productRateCount": 123,
        "categoryTree": ["Home", "Pets", "Brushes"], "category": "Brushes", "brandOrigin": "Việt Nam",
        "madeIn": "China", "warranty": "Không", "description": "one\ntwo2", "seller": "Shop A", "sellerRate": 4.7,
        "sellerRateCount": "5.5k reviews",
        "additionalInfo": [
            "key_Việt Nam: value_None", "key_China: value_None", "key_Không: value_None",
            "key_Size: value_XL", "key_XL: value_None", "key_Shop A: value_None"],
        "timestamp": NOW,
    }


def test_missing_parts_and_broken_pages_give_defaults(spark):
    rows = extract(spark, "<html><body></body></html>", None, "", "<div><![if bad", "plain text")
    assert len(rows) == 5
    for row in rows.values():
        values = row.asDict()
        del values["urlId"], values["timestamp"]
        assert values == {
            "title": "", "brand": "", "price": None, "discount": None, "sellPrice": 0.0, "sold": None,
            "productRate": None, "productRateCount": None, "categoryTree": None, "category": None,
            "brandOrigin": "", "madeIn": "", "warranty": "", "description": "", "seller": "", "sellerRate": None,
            "sellerRateCount": None, "additionalInfo": None}


def test_ids_that_are_not_integers_are_dropped(spark):
    rows = extract(spark, ("12", ""), (" 13 ", ""), ("x", ""), (None, ""), ("99999999999", ""), ("99999999999999999999", ""), ("1.5", ""))
    assert sorted(rows) == [12, 13, 99999999999]


def test_labels_by_priority_last_wins_and_empty_value(spark):
    both = f"{LABELS.origin} {LABELS.made_in}"
    page = (f"<div><span>{both}</span><span>A</span></div><div><span>{LABELS.made_in}</span><span>B</span></div>"
            f"<div><span>{LABELS.made_in} 2</span><span>C</span></div><div><span>x {LABELS.warranty}</span></div>")
    row = extract(spark, page)[0]
    assert (row["brandOrigin"], row["madeIn"], row["warranty"]) == ("A", "C", "")


def test_empty_batch_keeps_the_schema(spark):
    df = spark.createDataFrame([], "urlId string, html string, timestamp timestamp")
    out = extract_products(df)
    assert out.count() == 0
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in CRAWL_ROW]


def one(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_numbers_from_text(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert one(spark, T.safe_int, "12", " 12\xa0", "25.0", "x", "", None, "99999999999", "-3", "+4", "007") == [
            12, 12, None, None, None, None, None, -3, 4, 7]
        assert one(spark, T.safe_double, "1.5", " 2 ", "1e3", ".5", "5.", "1.0d", "x", "", None, ".", "-1") == [
            1.5, 2.0, 1000.0, 0.5, 5.0, None, None, None, None, None, -1.0]
        assert one(spark, T.money, "1.234.000", "1,234", "1.234 ₫", "12 345", "liên hệ", "", None, "-5") == [
            1234000.0, 1234.0, 1234.0, 12345.0, None, None, None, -5.0]
        assert one(spark, T.money, "100.000 - 200.000", "Hotline 0901234567", "2 for 300.000", "1.234.000đ", "VND 99,000", "12\xa0345 VNĐ") == [
            None, None, None, 1234000.0, 99000.0, 12345.0]
        assert one(spark, T.safe_long, "3000000000", "9223372036854775808", "x", None) == [3000000000, None, None, None]
        assert one(spark, T.discount, "-25%", "%", "", "-x%", None) == [25.0, None, None, None, None]
        assert one(spark, T.last_token_int, "sold 12", "12\xa0", "a\xa0b 7", "12 pcs", "", None) == [
            12, 12, 7, None, None, None]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_rating_edges(spark):
    texts = ("4.9(123)", "5(10)", "4.9", "4.9(", "4.9( 7 )", "4.7(5.5k reviews)", None)
    assert one(spark, T.rating_value, *texts) == [4.9, None, 4.9, 4.9, 4.9, 4.7, None]
    assert one(spark, T.rating_count, *texts) == [123, None, None, None, 7, None, None]
    assert one(spark, T.rating_count_text, *texts) == ["123", "", None, None, "7", "5.5k reviews", None]


def test_basic_references(spark):
    texts = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&quot;x&#39;", "cut &amp", "&am", "&#x27;", None]
    assert one(spark, T.unescape_basic, *texts) == [None if t is None else html.unescape(t) for t in texts]


def test_strip_and_urls(spark):
    assert one(spark, T.strip, "\xa0\n a b　\t", "", None) == ["a b", "", None]
    assert one(spark, T.normalize_url, "a?b?c", "a", "?x", "") == ["a", "a", "", ""]


def test_links(spark):
    html = ('<a class="product-item x" href="/p1?q=1">1</a><a href="/no">2</a><a class="product-item" href="">3</a>'
            '<a class="product-item">4</a><a class="my-product-item-2" href="https://other/p">5</a>')
    pages = spark.createDataFrame([("https://shop/a/b", html)], "url string, html string")
    found = {r["href"] for r in extract_links(pages).collect()}
    assert found == {"https://shop/p1?q=1", "https://other/p"}
    assert {r["href"] for r in extract_links(pages, class_token=None, resolve=False).collect()} == {
        "/p1?q=1", "/no", "https://other/p"}


def test_fast_paths_agree_with_the_selector_stage(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    slow = select_texts(pages, {"t": Selector("title"), "items": Selector("li", take="all")}, keep=("page_id",))
    fast = pages.select("page_id", flat_tag_text(F.col("html"), "title").alias("t"))
    assert sorted(slow.select("page_id", "t").collect()) == sorted(fast.collect())
    token = '<a class="z product-item" href="/1">a</a><a href="/2">b</a><i>  x </i><i>y</i>'
    df = spark.createDataFrame([(token,)], "html string")
    row = df.select(flat_links(F.col("html"), "product-item").alias("some"), flat_links(F.col("html")).alias("every"),
                    flat_tag_texts(F.col("html"), "i").alias("texts"), flat_tag_text(F.col("html"), "q").alias("none")).first()
    assert row.asDict() == {"some": ["/1"], "every": ["/1", "/2"], "texts": ["x", "y"], "none": None}


def test_partition_date_follows_the_zone(spark):
    rows = extract_products(spark.createDataFrame([("1", "", NOW)], "urlId string, html string, timestamp timestamp"))
    assert to_lake_rows(rows).first()["date"] == dt.date(2026, 1, 1)
    assert to_lake_rows(rows, "Asia/Ho_Chi_Minh").first()["date"] == dt.date(2026, 1, 2)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert to_lake_rows(rows, "Asia/Ho_Chi_Minh").first()["date"] == dt.date(2026, 1, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_messages_round_trip_and_options(spark):
    pages = spark.createDataFrame([(7, "<p>é</p>")], "urlId int, html string")
    messages = to_messages(pages)
    assert [f.dataType for f in messages.schema] == [f.dataType for f in MESSAGE.fields[:2]]
    back = decode_messages(messages.withColumn("timestamp", F.lit(NOW))).first()
    assert (back["urlId"], back["html"]) == ("7", "<p>é</p>")
    assert kafka_options("h:1", "pages", maxOffsetsPerTrigger="10") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "pages", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "10"}
