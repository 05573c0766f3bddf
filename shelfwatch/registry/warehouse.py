"""Snapshots, dimensions, keys and the daily load."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwatch.operators import dimensions as D
from shelfwatch.operators.snapshot import latest_snapshot, snapshot_change
from shelfwatch.plans.daily_load import run_daily
from shelfwatch.plans.reports import top_sold_brands, top_sold_sellers
from shelfwatch.plans.validity import COLUMNS as VALID_COLUMNS, snapshots_valid, update_validity
from shelfwatch.registry import query
from shelfwatch.registry.tables import (
    FACT_ORDER,
    SQL_CRAWL,
    SQL_FACT,
    SQL_FACT_ORDER,
    SQL_NEWEST,
    crawl_rows,
    fact,
    sql_stamp,
    stamp,
)
from shelfwatch.schemas import LAKE_ROW, conform
from shelfwatch.session import scratch_path
from shelfwatch.sources.lake import append_lake, read_day
from shelfwatch.sources.warehouse import overwrite_table, read_dimension, read_fact

MOST_KEYS = 1_500_000  # products or sellers that may be broadcast

_SQL_SNAPSHOT = f"url_id, seller_id, sold, price, {sql_stamp('ts')} AS ts"


def _snapshot_columns(df):
    return df.select(F.col("urlId").alias("url_id"), F.col("sellerId").alias("seller_id"), "sold", "price",
                     stamp("timestamp").alias("ts"))


@query("latest_snapshot", f"""
WITH {SQL_FACT}
SELECT {_SQL_SNAPSHOT} FROM (
    SELECT *, dense_rank() OVER (PARTITION BY url_id ORDER BY ts DESC) AS r FROM fact) WHERE r = 1""")
def latest_snapshot_query(spark, d):
    return _snapshot_columns(latest_snapshot(fact(spark, d)))


@query("latest_snapshot_one", f"""
WITH {SQL_FACT}
SELECT {_SQL_SNAPSHOT} FROM (
    SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY ts DESC, {SQL_FACT_ORDER}) AS r FROM fact)
WHERE r = 1""")
def latest_snapshot_one(spark, d):
    return _snapshot_columns(latest_snapshot(fact(spark, d), ties="one", tie_break=FACT_ORDER))


_SQL_CHANGE = f"""
WITH {SQL_FACT}
SELECT url_id, order_no, line_no, {sql_stamp('ts')} AS ts, price, seller_id,
       lag(price) OVER w AS prev_price, coalesce(lag(seller_id) OVER w, -1) AS prev_seller,
       round(price - lag(price) OVER w, 4) AS price_delta
FROM fact WINDOW w AS (PARTITION BY url_id ORDER BY ts, {SQL_FACT_ORDER})"""


def _change(rows):
    rows = snapshot_change(rows, ["price", "sellerId"], tie_break=FACT_ORDER, deltas=["price"])
    return rows.select(
        F.coalesce("urlId", F.lit(-1)).alias("url_id"), F.col("orderNo").alias("order_no"), F.col("lineNo").alias("line_no"),
        stamp("timestamp").alias("ts"), "price", F.col("sellerId").alias("seller_id"), "prev_price",
        F.coalesce("prev_sellerId", F.lit(-1)).alias("prev_seller"), F.round("price_delta", 4).alias("price_delta"))


@query("snapshot_change", _SQL_CHANGE)
def snapshot_change_query(spark, d):
    return _change(fact(spark, d))


@query("snapshot_change_hot", f"""
WITH {SQL_FACT},
hot AS (SELECT * REPLACE (CASE url_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE url_id END AS url_id) FROM fact)
SELECT coalesce(url_id, -1) AS url_id, order_no, line_no, {sql_stamp('ts')} AS ts, price, seller_id,
       lag(price) OVER w AS prev_price, coalesce(lag(seller_id) OVER w, -1) AS prev_seller,
       round(price - lag(price) OVER w, 4) AS price_delta
FROM hot WINDOW w AS (PARTITION BY url_id ORDER BY ts, {SQL_FACT_ORDER})""")
def snapshot_change_hot(spark, d):
    """A third of all rows on one product, a third on NULL."""
    turn = F.col("urlId") % 3
    key = F.when(turn == 1, F.lit(1)).when(turn == 2, F.col("urlId"))
    return _change(fact(spark, d).withColumn("urlId", key.cast("long")))


def _sql_dim(key, columns, source="newest", lowest=True):
    """First row per key: newest, then lowest url_id, then greatest values."""
    order = "ts DESC, " + ("url_id, " if lowest else "") + ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return (f"SELECT {', '.join([key, *columns])} FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {source}) WHERE n = 1")


@query("brand_dim", f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_sql_dim('brand', ['brand_origin'])}")
def brand_dim(spark, d):
    dim = D.brand_dim(latest_snapshot(crawl_rows(spark, d)))
    return dim.select("brand", F.col("brandOrigin").alias("brand_origin"))


@query("seller_dim",
       f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_sql_dim('seller', ['seller_rate', 'seller_rate_count'])}")
def seller_dim(spark, d):
    dim = D.seller_dim(latest_snapshot(crawl_rows(spark, d)))
    return dim.select("seller", F.col("sellerRate").alias("seller_rate"),
                      F.col("sellerRateCount").alias("seller_rate_count"))


@query("product_dim",
       f"WITH {SQL_CRAWL}, {SQL_NEWEST} {_sql_dim('url_id', ['title', 'category', 'made_in'], lowest=False)}")
def product_dim(spark, d):
    dim = D.product_dim(latest_snapshot(crawl_rows(spark, d)))
    return dim.select(F.col("urlId").alias("url_id"), "title", "category", F.col("madeIn").alias("made_in"))


@query("dimension_merge", f"WITH {SQL_CRAWL} {_sql_dim('seller', ['seller_rate', 'seller_rate_count'], 'crawl')}")
def dimension_merge(spark, d):
    """Two loads, later half first, merged: the same as one load of everything."""
    rows = crawl_rows(spark, d)
    late = F.col("timestamp") >= F.lit("1998-07-01").cast("timestamp")
    merged = D.merge_dimension(D.seller_dim(rows.where(late)), D.seller_dim(rows.where(~late)), "seller")
    return merged.select("seller", F.col("sellerRate").alias("seller_rate"),
                         F.col("sellerRateCount").alias("seller_rate_count"))


@query("surrogate_keys", f"""
WITH {SQL_CRAWL}
SELECT seller, count(*) AS snapshots, count(DISTINCT brand) AS brands,
       CAST(1 AS BIGINT) AS seller_keys, count(DISTINCT brand) AS brand_keys
FROM crawl GROUP BY seller""")
def surrogate_keys(spark, d):
    """Keys are one to one with names; the ids themselves are not comparable across engines."""
    return D.derive_keys(crawl_rows(spark, d)).groupBy("seller").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_distinct("brand").alias("brands"),
        F.count_distinct("sellerId").alias("seller_keys"), F.count_distinct("brandId").alias("brand_keys"))


_SQL_ROUND_TRIP = f"""
WITH {SQL_CRAWL}, {SQL_NEWEST}
SELECT url_id, brand, seller, sold, price, {sql_stamp('ts')} AS ts FROM newest"""


def _named(keyed, brands, sellers):
    fact_rows = D.snapshot_fact(keyed)
    return (fact_rows.join(brands.select("brandId", "brand"), "brandId")
            .join(sellers.select("sellerId", "seller"), "sellerId")
            .select(F.col("urlId").alias("url_id"), "brand", "seller", "sold", "price",
                    stamp("timestamp").alias("ts")))


@query("fact_keys_lookup", _SQL_ROUND_TRIP)
def fact_keys_lookup(spark, d):
    snapshot = latest_snapshot(crawl_rows(spark, d))
    brands, sellers = D.brand_dim(snapshot), D.seller_dim(snapshot)
    keyed = D.lookup_key(D.lookup_key(snapshot, brands, "brand", "brandId"), sellers, "seller", "sellerId")
    return _named(keyed, brands, sellers)


@query("fact_keys_derived", _SQL_ROUND_TRIP)
def fact_keys_derived(spark, d):
    snapshot = latest_snapshot(crawl_rows(spark, d))
    return _named(D.derive_keys(snapshot), D.brand_dim(snapshot), D.seller_dim(snapshot))


@query("table_contract", f"""
WITH {SQL_CRAWL}
SELECT url_id, title, brand, price, sell_price, sold, '' AS warranty, '' AS description,
       'none' AS additional, strftime(ts, '%Y-%m-%d') AS day
FROM crawl""")
def table_contract(spark, d):
    """Crawl rows without their optional texts, brought to the lake contract."""
    rows = crawl_rows(spark, d).drop("warranty", "description").withColumn("date", F.to_date("timestamp"))
    lake = conform(rows, LAKE_ROW)
    return lake.select(
        F.col("urlId").alias("url_id"), "title", "brand", "price", F.col("sellPrice").alias("sell_price"),
        "sold", "warranty", "description", F.coalesce(F.array_join("additionalInfo", "|"), F.lit("none")).alias("additional"),
        F.date_format("date", "yyyy-MM-dd").alias("day"))


def _yearly_lake(spark, d):
    """The crawl rows as a lake with one partition per year, the load period of these queries."""
    root = scratch_path(spark, "lake")
    rows = crawl_rows(spark, d).withColumn("date", F.to_date(F.date_trunc("year", F.col("timestamp"))))
    append_lake(conform(rows, LAKE_ROW), root)
    days = [r["date"] for r in spark.read.parquet(root).select("date").distinct().collect()]
    return root, sorted(days)


@query("lake_partition_scan", f"""
WITH {SQL_CRAWL}
SELECT strftime(date_trunc('year', ts), '%Y-%m-%d') AS day, count(*) AS snapshots,
       CAST(sum(sold) AS BIGINT) AS sold
FROM crawl GROUP BY 1""")
def lake_partition_scan(spark, d):
    root, days = _yearly_lake(spark, d)
    frames = [read_day(spark, root, day) for day in days]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("sold").alias("sold"))


@query("daily_load", f"""
WITH {SQL_CRAWL},
ranked AS (
    SELECT *, dense_rank() OVER (PARTITION BY url_id, date_trunc('year', ts) ORDER BY ts DESC) AS r FROM crawl),
loaded AS (SELECT * FROM ranked WHERE r = 1),
brands AS ({_sql_dim('brand', ['brand_origin'], 'loaded')}),
sellers AS ({_sql_dim('seller', ['seller_rate', 'seller_rate_count'], 'loaded')}),
products AS ({_sql_dim('url_id', ['title', 'category', 'made_in'], 'loaded', lowest=False)})
SELECT strftime(date_trunc('year', l.ts), '%Y-%m-%d') AS day, l.url_id, p.title, p.made_in, l.brand,
       b.brand_origin, l.seller, s.seller_rate, l.sold, l.price, {sql_stamp('l.ts')} AS ts
FROM loaded l JOIN brands b ON l.brand = b.brand JOIN sellers s ON l.seller = s.seller
JOIN products p ON l.url_id = p.url_id""")
def daily_load(spark, d):
    """Every partition of the lake loaded in turn; the star schema read back and joined."""
    lake, days = _yearly_lake(spark, d)
    warehouse = scratch_path(spark, "warehouse")
    for day in days:
        run_daily(spark, lake, warehouse, day, validity=False)  # its twin does not read it
    brands = read_dimension(spark, warehouse, "brandDim").select("brandId", "brand", "brandOrigin")
    sellers = read_dimension(spark, warehouse, "sellerDim").select("sellerId", "seller", "sellerRate")
    products = read_dimension(spark, warehouse, "productDim").select(
        "urlId", "title", F.col("madeIn").alias("dimMadeIn"))
    rows = read_fact(spark, warehouse).join(brands, "brandId").join(sellers, "sellerId").join(products, "urlId")
    return rows.select(
        F.date_format("date", "yyyy-MM-dd").alias("day"), F.col("urlId").alias("url_id"), "title",
        F.col("dimMadeIn").alias("made_in"), "brand", F.col("brandOrigin").alias("brand_origin"), "seller",
        F.col("sellerRate").alias("seller_rate"), "sold", "price", stamp("timestamp").alias("ts"))


def _sql_valid(name, where=""):
    return f"""
WITH {SQL_CRAWL},
newest AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY url_id ORDER BY ts DESC) AS r FROM crawl {where}) WHERE r = 1)
SELECT {name}, CAST(sum(sold) AS BIGINT) AS sold FROM newest GROUP BY {name} ORDER BY sold DESC NULLS LAST, {name} LIMIT 10"""


def _kept_validity(spark, d):
    """The table after loading every year, the middle one last and one of them twice; and the names of brands and sellers."""
    rows = D.derive_keys(crawl_rows(spark, d, most=MOST_KEYS)).withColumn("date", F.to_date(F.date_trunc("year", F.col("timestamp"))))
    # Written down, so that a load reads its year and does not join all products and sellers again.
    fact_rows, path = D.snapshot_fact(rows).select(*VALID_COLUMNS), scratch_path(spark, "fact")
    fact_rows.write.partitionBy("date").parquet(path)
    fact_rows = spark.read.schema(fact_rows.schema).parquet(path)
    years = sorted(r["date"] for r in fact_rows.select("date").distinct().collect())
    warehouse = scratch_path(spark, "warehouse")
    for year in [*years[:2], *years[3:], *years[2:3], *years[:1]]:
        update_validity(fact_rows.where(F.col("date") == F.lit(year)), warehouse, year)
    return warehouse, rows


@query("top_sold_brands_valid", _sql_valid("brand"))
def top_sold_brands_valid(spark, d):
    """The newest snapshots are the open intervals."""
    warehouse, rows = _kept_validity(spark, d)
    return top_sold_brands(snapshots_valid(spark, warehouse), D.brand_dim(rows), 10, history=True)


@query("top_sold_sellers_valid_as_of", _sql_valid("seller", "WHERE ts < TIMESTAMP '1998-01-01 00:00:00'"))
def top_sold_sellers_valid_as_of(spark, d):
    """What counted in the middle of 1997; the load period is a year."""
    warehouse, rows = _kept_validity(spark, d)
    return top_sold_sellers(snapshots_valid(spark, warehouse, "1997-06-30"), D.seller_dim(rows), 10, history=True)


@query("overwrite_table", f"""
WITH {SQL_FACT} SELECT url_id, count(*) AS snapshots FROM fact GROUP BY url_id""")
def overwrite_twice(spark, d):
    """A second write replaces the first."""
    path = scratch_path(spark, "table")
    counts = fact(spark, d).groupBy(F.col("urlId").alias("url_id")).agg(F.count(F.lit(1)).alias("snapshots"))
    overwrite_table(counts, path)
    overwrite_table(counts, path)
    return spark.read.parquet(path)
