"""Extraction from pages: the given ones, and product pages that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwatch.functions import text as T
from shelfwatch.operators.extract import (
    PRODUCT_SELECTORS,
    DetailLabels,
    extract_links,
    extract_products,
    flat_links,
    flat_tag_text,
    flat_tag_texts,
    rejected_messages,
)
from shelfwatch.operators.selectors import Selector, select_texts
from shelfwatch.operators.page_function import product_rows, register_page_functions
from shelfwatch.registry import query
from shelfwatch.registry.tables import table
from shelfwatch.sources.messages import decode_messages, to_messages

def sql_text(text):
    """Basic character references resolved; HTML reads those of a cut-off text the same."""
    for pattern, char in T.BASIC_REFERENCES:
        quoted = char.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{quoted}', 'g')"
    return f"trim({text})"


SQL_TITLE = sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_SQL_TITLES = f"SELECT page_id, {SQL_TITLE} AS title FROM pages"


@query("page_titles", _SQL_TITLES)
def page_titles(spark, d):
    return select_texts(table(spark, d, "pages"), {"title": Selector("h1")}, keep=("page_id",))


@query("page_titles_flat", _SQL_TITLES)
def page_titles_flat(spark, d):
    return table(spark, d, "pages").select("page_id", flat_tag_text(F.col("html"), "h1").alias("title"))


@query("page_boxes", f"""
SELECT page_id, {sql_text("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS box,
       len(regexp_extract_all(html, '<li>')) AS items,
       array_to_string(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1),
           lambda x: {sql_text('x')}), '|') AS entries
FROM pages""")
def page_boxes(spark, d):
    """First match by class, all matches of a tag, all matches inside a container."""
    raw = select_texts(table(spark, d, "pages"), {
        "box": Selector("div", "class", "ad"),
        "items": Selector("li", take="all"),
        "entries": Selector("a", take="all", inside=Selector("nav")),
    }, keep=("page_id",))
    return raw.select("page_id", "box", F.size("items").cast("long").alias("items"),
                      F.array_join("entries", "|").alias("entries"))


_SQL_LINKS = """
SELECT page_id, href FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
WHERE href <> ''"""


@query("page_links", _SQL_LINKS)
def page_links(spark, d):
    links = extract_links(table(spark, d, "pages"), page="page_id", class_token=None, resolve=False)
    return links.withColumnRenamed("page", "page_id")


@query("page_links_flat", _SQL_LINKS)
def page_links_flat(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(flat_links(F.col("html"))).alias("href"))


@query("page_links_resolved", """
SELECT url, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS href FROM (
    SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
WHERE href <> ''""")
def page_links_resolved(spark, d):
    return extract_links(table(spark, d, "pages"), class_token=None).withColumnRenamed("page", "url")


@query("list_items_flat", f"""
SELECT page_id, array_to_string(list_transform(
    regexp_extract_all(html, '<a(?:\\s[^>]*)?>([^<]*)</a\\s*>', 1), lambda x: {sql_text('x')}), '|') AS items
FROM pages""")
def list_items_flat(spark, d):
    items = F.array_join(flat_tag_texts(F.col("html"), "a"), "|")
    return table(spark, d, "pages").select("page_id", items.alias("items"))


@query("normalized_urls", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def normalized_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("message_round_trip", """
SELECT CAST(page_id AS VARCHAR) AS url_id, length(html) AS chars, md5(html) AS digest FROM pages""")
def message_round_trip(spark, d):
    """Pages to keyed messages and back."""
    messages = to_messages(table(spark, d, "pages"), "page_id")
    decoded = decode_messages(messages.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")))
    return decoded.select(F.col("urlId").alias("url_id"), F.length("html").cast("long").alias("chars"),
                          F.md5("html").alias("digest"))


# -- product pages written from part and lineitem ---------------------------------------------

def product_pages(spark, d):
    """One product page per part, holding its attributes and the totals of its order lines."""
    totals = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("int").alias("units"), F.count(F.lit(1)).alias("lines"))
    parts = table(spark, d, "part").join(totals, F.col("p_partkey") == F.col("l_partkey"))
    # Parsing costs far more than these rows weigh, so do not let small partitions be merged.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = parts.repartition(tasks)

    def element(tag, attrs, text):
        return F.concat(F.lit(f"<{tag}{' ' + attrs if attrs else ''}>"), text, F.lit(f"</{tag}>"))

    def pair(key, value):
        return F.concat(F.lit("<div>"), element("span", "", key), element("span", "", value), F.lit("</div>"))

    labels = DetailLabels()
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    size = F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    lines = F.col("lines").cast("string")
    s = PRODUCT_SELECTORS

    def by_attr(name, text):
        selector = s[name]
        return element(selector.tag, f'{selector.attr}="{selector.value}"', text)

    box = s["paragraphs"].inside
    html = F.concat(
        F.lit("<html><head><title>shop</title><script>var t='</p>';</script></head><body><!-- page -->"),
        by_attr("title", F.concat(F.lit("\n  "), F.col("p_name"), F.lit(" "))),
        by_attr("brand", F.col("p_brand")),
        element("del", "", F.concat(F.translate(F.format_number(cents, 0), ",", "."), F.lit("₫"))),
        by_attr("discount", F.concat(F.lit("-"), size, F.lit("%"))),
        by_attr("sellPrice", F.format_number(cents * 2, 0)),
        by_attr("sold", F.concat(F.lit("Đã bán "), F.col("units").cast("string"))),
        by_attr("rating", F.concat(F.lit("4."), digit, F.lit("("), lines, F.lit(")"))),
        by_attr("breadcrumbs", F.lit("Trang chủ")),
        by_attr("breadcrumbs", F.concat(F.lit("<b>"), F.col("p_type"), F.lit("</b>"))),
        pair(F.lit(labels.origin), F.col("p_brand")),
        pair(F.lit(f"{labels.made_in}:"), F.col("p_type")),
        pair(F.lit("Size &amp; fit"), size),
        F.lit(f'<div class="{box.value}"><p>'), F.col("p_name"),
        F.lit("</p><p> </p><p>"), F.col("p_type"), F.lit("</p></div><p>outside</p>"),
        by_attr("seller", F.concat(F.lit("Shop "), F.col("p_brand"))),
        by_attr("sellerRating", F.concat(F.lit("4."), digit, F.lit("("), lines, F.lit("k reviews)"))),
        F.lit("</body></html>"),
    )
    return parts.select(
        F.col("p_partkey").cast("string").alias("urlId"), html.alias("html"),
        F.timestamp_add("MINUTE", F.col("p_partkey").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("timestamp"),
    )


SQL_EXTRACTED = """
WITH totals AS (
    SELECT l_partkey, CAST(sum(l_quantity) AS INTEGER) AS units, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS url_id, p_name AS title, p_brand AS brand,
       round(p_retailprice * 100) AS price, CAST(p_size AS DOUBLE) AS discount,
       round(p_retailprice * 100) * 2 AS sell_price, units AS sold,
       CAST('4.' || CAST(p_size % 10 AS VARCHAR) AS DOUBLE) AS product_rate,
       CAST(n AS INTEGER) AS product_rate_count, 'Trang chủ>' || p_type AS category_tree, p_type AS category,
       p_brand AS brand_origin, p_type AS made_in, '' AS warranty,
       p_name || chr(10) || p_type AS description, 'Shop ' || p_brand AS seller,
       CAST('4.' || CAST(p_size % 10 AS VARCHAR) AS DOUBLE) AS seller_rate,
       CAST(n AS VARCHAR) || 'k reviews' AS seller_rate_count,
       'key_' || p_brand || ': value_None|key_' || p_type || ': value_None|key_Size & fit: value_'
           || CAST(p_size AS VARCHAR) || '|key_' || CAST(p_size AS VARCHAR)
           || ': value_None|key_Shop ' || p_brand || ': value_None' AS additional,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey), '%Y-%m-%d %H:%M:%S') AS ts
FROM part JOIN totals ON p_partkey = l_partkey"""


def flat_rows(rows):
    """Crawl rows under the names of the SQL twin, lists joined to text."""
    return rows.select(
        F.col("urlId").alias("url_id"), "title", "brand", "price", "discount", F.col("sellPrice").alias("sell_price"),
        "sold", F.col("productRate").alias("product_rate"), F.col("productRateCount").alias("product_rate_count"),
        F.array_join("categoryTree", ">").alias("category_tree"), "category",
        F.col("brandOrigin").alias("brand_origin"), F.col("madeIn").alias("made_in"), "warranty", "description",
        "seller", F.col("sellerRate").alias("seller_rate"), F.col("sellerRateCount").alias("seller_rate_count"),
        F.array_join("additionalInfo", "|").alias("additional"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("extracted_products", SQL_EXTRACTED)
def extracted_products(spark, d):
    return flat_rows(extract_products(product_pages(spark, d)))


@query("invalid_ids", """
SELECT CAST(sum(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS kept, count(*) AS pages FROM pages""")
def invalid_ids(spark, d):
    """Pages whose id text is not an integer give no row; a page without markup gives defaults."""
    pages = table(spark, d, "pages")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string"))) \
        .otherwise(F.concat(F.lit(" "), F.col("page_id").cast("string")))
    messages = pages.select(text.alias("urlId"), F.lit(None).cast("string").alias("html"),
                            F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    rows = extract_products(messages).where((F.col("title") == "") & F.col("price").isNull() & (F.col("sellPrice") == 0))
    total = pages.agg(F.count(F.lit(1)).alias("pages"))
    return rows.agg(F.count(F.lit(1)).alias("kept")).select("kept", total.scalar().alias("pages"))


@query("cut_off_pages", _SQL_TITLES)
def cut_off_pages(spark, d):
    """The given pages, cut off before the tag that ends the heading: the heading is read all the same."""
    pages = table(spark, d, "pages")
    cut = pages.withColumn("html", F.substring_index("html", "</h1", 1))
    return select_texts(cut, {"title": Selector("h1")}, keep=("page_id",))


@query("wide_ids", """
SELECT page_id + 3000000000 AS url_id, length(html) AS chars, FALSE AS rejected FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, length(html), TRUE FROM pages WHERE page_id % 2 = 1""")
def wide_ids(spark, d):
    """Ids beyond 32 bits are kept; messages whose id has more digits than a number come back as rejected."""
    pages = table(spark, d, "pages")
    text = F.when(F.col("page_id") % 2 == 0, (F.col("page_id") + F.lit(3_000_000_000)).cast("string")).otherwise(
        F.concat(F.lit("99999999999999999999"), F.col("page_id").cast("string")))
    messages = pages.select(text.alias("urlId"), "html", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), "page_id")
    kept = extract_products(messages).select("urlId").join(
        messages.withColumn("urlId", T.safe_long(F.col("urlId"))), "urlId")
    size = F.length("html").cast("long").alias("chars")
    return kept.select(F.col("urlId").alias("url_id"), size, F.lit(False).alias("rejected")).unionByName(
        rejected_messages(messages).select(F.col("page_id").alias("url_id"), size, F.lit(True).alias("rejected")))


# -- scalar text functions, on text built from columns ------------------------------------------

@query("money_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100) AS dotted,
       round(l_extendedprice * 100) AS signed, floor(l_quantity) AS plain, TRUE AS no_number
FROM lineitem""")
def money_text(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    text = F.format_number(cents, 0)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        T.money(F.translate(text, ",", ".")).alias("dotted"),
        T.money(F.concat(text, F.lit(" ₫"))).alias("signed"),
        T.money(F.col("l_quantity").cast("int").cast("string")).alias("plain"),
        T.money(F.concat(F.col("l_linestatus"), F.lit(" liên hệ"))).isNull().alias("no_number"))


@query("discount_text", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100) AS discount, TRUE AS no_number
FROM lineitem""")
def discount_text(spark, d):
    percent = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        T.discount(F.concat(F.lit("-"), percent, F.lit("%"))).alias("discount"),
        T.discount(F.concat(F.lit("-"), F.col("l_linestatus"), F.lit("%"))).isNull().alias("no_number"))


@query("rating_text", """
SELECT p_partkey, CAST(p_size % 5 AS DOUBLE) + 0.5 AS rate, p_size AS n,
       CAST(p_size AS VARCHAR) || 'k' AS n_text, TRUE AS no_count
FROM part""")
def rating_text(spark, d):
    stars = F.concat((F.col("p_size") % 5).cast("string"), F.lit(".5"))
    size = F.col("p_size").cast("string")
    plain = F.concat(stars, F.lit("("), size, F.lit(")"))
    return table(spark, d, "part").select(
        "p_partkey", T.rating_value(plain).alias("rate"), T.rating_count(plain).alias("n"),
        T.rating_count_text(F.concat(stars, F.lit("("), size, F.lit("k)"))).alias("n_text"),
        T.rating_count_text(stars).isNull().alias("no_count"))


@query("sold_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS sold, TRUE AS no_number
FROM lineitem""")
def sold_text(spark, d):
    units = F.col("l_quantity").cast("int").cast("string")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        T.last_token_int(F.concat(F.lit("Đã bán "), units, F.lit("  "))).alias("sold"),
        T.last_token_int(F.concat(units, F.lit(" pcs"))).isNull().alias("no_number"))


@query("label_text", """
SELECT p_partkey, 'key_' || p_brand || ': value_' || p_type AS label, 'key_' || p_name || ': value_None' AS bare,
       contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'red') AS is_red,
       replace(p_brand, '#', '') AS clean, TRY_CAST(p_type AS INTEGER) IS NULL AS no_int,
       TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS an_int, p_retailprice AS a_double
FROM part""")
def label_text(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.label(F.col("p_brand"), F.col("p_type")).alias("label"),
        T.label(F.col("p_name"), F.lit(None).cast("string")).alias("bare"),
        T.contains(F.col("p_name"), "ring").alias("has_ring"), T.has_prefix(F.col("p_name"), "red").alias("is_red"),
        T.remove_chars(F.col("p_brand"), "#").alias("clean"), T.safe_int(F.col("p_type")).isNull().alias("no_int"),
        T.safe_int(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("an_int"),
        T.safe_double(F.col("p_retailprice").cast("string")).alias("a_double"))


@query("function_page_fields", SQL_EXTRACTED)
def function_page_fields(spark, d):
    """The product pages through the SQL table function."""
    own = spark.newSession()
    register_page_functions(own)
    product_pages(own, d).createOrReplaceTempView("pages")
    return flat_rows(product_rows(own, "pages"))
