"""Business questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwatch.functions.time import partition_date
from shelfwatch.operators import dimensions as D
from shelfwatch.operators.snapshot import latest_snapshot
from shelfwatch.plans import reports as R
from shelfwatch.plans.report_functions import create_report_functions
from shelfwatch.registry import query
from shelfwatch.registry.tables import SQL_CRAWL, SQL_FACT, SQL_NEWEST, crawl_rows, fact, product_rows, seller_rows


def _potential_sql(count):
    return f"""
WITH {SQL_FACT},
sellers AS (SELECT url_id, {count} AS seller_count FROM fact GROUP BY url_id)
SELECT p_name AS title, f.sold, s.seller_count
FROM fact f JOIN sellers s ON f.url_id = s.url_id JOIN part ON p_partkey = f.url_id
ORDER BY s.seller_count, f.sold DESC NULLS LAST, p_name, f.url_id LIMIT 20"""


@query("potential_products", _potential_sql("count(seller_id)"))
def potential_products(spark, d):
    return R.potential_products(fact(spark, d), product_rows(spark, d), 20)


@query("potential_products_distinct", _potential_sql("count(DISTINCT seller_id)"))
def potential_products_distinct(spark, d):
    return R.potential_products(fact(spark, d), product_rows(spark, d), 20, mode="distinct")


@query("seller_counts", f"""
WITH {SQL_FACT} SELECT url_id, count(seller_id) AS seller_count FROM fact GROUP BY url_id""")
def seller_counts(spark, d):
    return R.seller_counts(fact(spark, d)).withColumnRenamed("urlId", "url_id")


@query("seller_counts_distinct", f"""
WITH {SQL_FACT} SELECT url_id, count(DISTINCT seller_id) AS seller_count FROM fact GROUP BY url_id""")
def seller_counts_distinct(spark, d):
    return R.seller_counts(fact(spark, d), "distinct").withColumnRenamed("urlId", "url_id")


@query("total_products", "SELECT count(DISTINCT l_partkey) AS total_products FROM lineitem")
def total_products(spark, d):
    return R.total_products(D.product_dim(latest_snapshot(crawl_rows(spark, d))))


@query("total_brands", f"WITH {SQL_CRAWL} SELECT count(DISTINCT brand) AS total_brands FROM crawl")
def total_brands(spark, d):
    return R.total_brands(D.brand_dim(latest_snapshot(crawl_rows(spark, d))))


@query("total_sellers", f"""
WITH {SQL_CRAWL}, {SQL_NEWEST} SELECT count(DISTINCT seller) AS total_sellers FROM newest""")
def total_sellers(spark, d):
    return R.total_sellers(D.seller_dim(latest_snapshot(crawl_rows(spark, d))))


@query("category_counts", "SELECT p_type AS category, count(*) AS products FROM part GROUP BY p_type")
def category_counts(spark, d):
    return R.category_counts(product_rows(spark, d))


_TOP_CATEGORIES = """
SELECT p_type AS category, count(*) AS products FROM part GROUP BY p_type
ORDER BY products DESC, category NULLS LAST LIMIT 5"""


@query("top_categories", _TOP_CATEGORIES)
def top_categories(spark, d):
    return R.top_categories(product_rows(spark, d), 5)


@query("category_share", f"""
SELECT category, products, round(products / sum(products) OVER (), 6) AS share FROM ({_TOP_CATEGORIES})""")
def category_share(spark, d):
    return R.category_share(product_rows(spark, d), 5).withColumn("share", F.round("share", 6))


def _brand_fact(spark, d):
    """Snapshots with their brand key."""
    return D.derive_keys(crawl_rows(spark, d)).withColumn("date", partition_date(F.col("timestamp")))


def _top_sold_sql(name, source, n=10, where=""):
    return f"""
SELECT {name}, CAST(sum(sold) AS BIGINT) AS sold FROM {source} {where}
GROUP BY {name} ORDER BY sold DESC NULLS LAST, {name} LIMIT {n}"""


@query("top_sold_brands", f"WITH {SQL_CRAWL} {_top_sold_sql('brand', 'crawl')}")
def top_sold_brands(spark, d):
    rows = _brand_fact(spark, d)
    return R.top_sold_brands(rows, D.brand_dim(rows), 10, history=True)


@query("top_sold_brands_latest", f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_top_sold_sql('brand', 'newest')}")
def top_sold_brands_latest(spark, d):
    rows = _brand_fact(spark, d)
    return R.top_sold_brands(rows, D.brand_dim(rows), 10)


_SQL_SELLERS = f"""{SQL_FACT}, sellers AS (
    SELECT fact.*, s_name AS seller FROM fact JOIN supplier ON s_suppkey = seller_id)"""


@query("top_sold_sellers", f"WITH {_SQL_SELLERS} {_top_sold_sql('seller', 'sellers')}")
def top_sold_sellers(spark, d):
    return R.top_sold_sellers(fact(spark, d), seller_rows(spark, d), 10, history=True)


@query("top_sold_sellers_as_of", f"""
WITH {_SQL_SELLERS},
latest AS (
    SELECT * FROM (
        SELECT *, dense_rank() OVER (PARTITION BY url_id ORDER BY ts DESC) AS r
        FROM sellers WHERE ts < TIMESTAMP '1998-07-01 00:00:00') WHERE r = 1)
{_top_sold_sql('seller', 'latest')}""")
def top_sold_sellers_as_of(spark, d):
    return R.top_sold_sellers(fact(spark, d), seller_rows(spark, d), 10, as_of="1998-06-30")


@query("titled_report", f"""
WITH {_SQL_SELLERS} SELECT seller AS "Seller", sold AS "Sold" FROM ({_top_sold_sql('seller', 'sellers')})""")
def titled_report(spark, d):
    return R.with_titles(R.top_sold_sellers(fact(spark, d), seller_rows(spark, d), 10, history=True))


def _sql_surface(name, sql, n=10, label="", **options):
    @query(f"sql_{name}{label}", sql)
    def run(spark, d):
        rows = _brand_fact(spark, d)
        tables = {
            "productSnapshotFact": rows,
            "productDim": D.product_dim(rows),
            "brandDim": D.brand_dim(rows),
            "sellerDim": D.seller_dim(rows),
        }
        return R.run_report(spark, name, tables, n, **options)
    return run


_PRODUCTS = "(SELECT DISTINCT url_id, category FROM crawl)"

_sql_surface("total_products", f"WITH {SQL_CRAWL} SELECT count(DISTINCT url_id) AS total_products FROM crawl")
_sql_surface("total_brands", f"WITH {SQL_CRAWL} SELECT count(DISTINCT brand) AS total_brands FROM crawl")
_sql_surface("total_sellers", f"WITH {SQL_CRAWL} SELECT count(DISTINCT seller) AS total_sellers FROM crawl")
_sql_surface("top_categories", f"""
WITH {SQL_CRAWL} SELECT category, count(*) AS products FROM {_PRODUCTS} GROUP BY category
ORDER BY products DESC, category NULLS LAST LIMIT 5""", 5)
_sql_surface("potential_products", _potential_sql("count(seller_id)"), 20)
_SQL_AS_OF = """newest AS (
    SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY url_id ORDER BY ts DESC) AS r
                   FROM crawl WHERE ts < TIMESTAMP '1998-07-01 00:00:00') WHERE r = 1)"""
for _name, _column in (("top_sold_brands", "brand"), ("top_sold_sellers", "seller")):
    _sql_surface(_name, f"WITH {SQL_CRAWL} {_top_sold_sql(_column, 'crawl')}", history=True)
    _sql_surface(_name, f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_top_sold_sql(_column, 'newest')}", label="_latest")
    _sql_surface(_name, f"WITH {SQL_CRAWL}, {_SQL_AS_OF} {_top_sold_sql(_column, 'newest')}", label="_as_of", as_of="1998-06-30")


def _sql_function(name, call, sql):
    @query(f"function_{name}", sql)
    def run(spark, d):
        """Called in SQL; views and functions are those of a session of their own, so no other query sees them."""
        own = spark.newSession()
        rows = _brand_fact(own, d)
        create_report_functions(own, {"productSnapshotFact": rows, "productDim": D.product_dim(rows), "brandDim": D.brand_dim(rows),
                                      "sellerDim": D.seller_dim(rows)})
        return own.sql(f"SELECT * FROM {call}")
    return run


_sql_function("potential_products", "potential_products(n => 20)", _potential_sql("count(seller_id)"))
_sql_function("top_categories", "top_categories(5)", f"""
WITH {SQL_CRAWL} SELECT category, count(*) AS products FROM {_PRODUCTS} GROUP BY category
ORDER BY products DESC, category NULLS LAST LIMIT 5""")
for _name, _column in (("top_sold_brands", "brand"), ("top_sold_sellers", "seller")):
    _sql_function(_name, f"{_name}(10, history => true)", f"WITH {SQL_CRAWL} {_top_sold_sql(_column, 'crawl')}")
    _sql_function(f"{_name}_latest", f"{_name}()", f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_top_sold_sql(_column, 'newest')}")
    _sql_function(f"{_name}_as_of", f"{_name}(as_of => DATE'1998-06-30')", f"WITH {SQL_CRAWL}, {_SQL_AS_OF} {_top_sold_sql(_column, 'newest')}")
