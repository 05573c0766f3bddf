"""The given tables in the shapes the library works on, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.functions.text import normalize_url
from shelfwatch.session import joinable, tune
from shelfwatch.sources.points import metric_type_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: Column | str) -> Column:
    """Timestamps are compared as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# -- products -------------------------------------------------------------------------------

def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as product snapshots: part = product, supplier = seller, quantity = sold."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("urlId"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").cast("int").alias("sold"),
        F.col("l_shipdate").alias("timestamp"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("sellerId"),
        F.col("l_orderkey").alias("orderNo"),
        F.col("l_linenumber").alias("lineNo"),
    )


SQL_FACT = """fact AS (
    SELECT l_partkey AS url_id, l_extendedprice AS price, l_discount AS discount,
           CAST(l_quantity AS INTEGER) AS sold, l_shipdate AS ts, l_suppkey AS seller_id,
           l_orderkey AS order_no, l_linenumber AS line_no
    FROM lineitem)"""

# A total order of snapshots that share product and time.
FACT_ORDER = ("orderNo", "lineNo", "sellerId", "sold", "price", "discount")
SQL_FACT_ORDER = "order_no, line_no, seller_id, sold, price, discount"


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("urlId"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
    )


def seller_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sellerId"), F.col("s_name").alias("seller"))


def crawl_rows(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Full crawl rows: snapshots with the texts of their product and seller. With ``most``, products and sellers are counted, and
    more of them than that are joined by sorting: of a read of keys alone the optimizer may take millions for few bytes."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    suppliers = table(spark, sf_dir, "supplier")
    if most is not None:
        parts, suppliers = joinable(parts, rows=most), joinable(suppliers, rows=most)
    joined = (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")))
    return joined.select(
        F.col("l_partkey").alias("urlId"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("p_retailprice").alias("sellPrice"),
        F.col("l_quantity").cast("int").alias("sold"),
        F.col("l_tax").alias("productRate"),
        F.col("p_size").alias("productRateCount"),
        F.col("p_type").alias("category"),
        F.col("l_returnflag").alias("brandOrigin"),
        F.col("l_linestatus").alias("madeIn"),
        F.lit("").alias("warranty"),
        F.lit("").alias("description"),
        F.col("s_name").alias("seller"),
        F.col("l_discount").alias("sellerRate"),
        F.col("l_linenumber").cast("string").alias("sellerRateCount"),
        F.col("l_shipdate").alias("timestamp"),
    )


SQL_CRAWL = """crawl AS (
    SELECT l_partkey AS url_id, p_name AS title, p_brand AS brand,
           l_extendedprice AS price, l_discount AS discount, p_retailprice AS sell_price,
           CAST(l_quantity AS INTEGER) AS sold, p_type AS category, l_returnflag AS brand_origin,
           l_linestatus AS made_in, s_name AS seller, l_discount AS seller_rate,
           CAST(l_linenumber AS VARCHAR) AS seller_rate_count, l_shipdate AS ts
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

# The newest snapshot of each product in the whole table, ties kept.
SQL_NEWEST = """newest AS (
    SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY url_id ORDER BY ts DESC) AS r FROM crawl)
    WHERE r = 1)"""


# -- frontier -------------------------------------------------------------------------------

def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crawl state. Only every third product number is known to it."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("https://shop.example/p"), (F.col("o_orderkey") * 3).cast("string")).alias("url"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("PAUSED").alias("status"),
        F.col("o_orderdate").alias("next_crawled_at"),
        F.lit(None).cast("timestamp").alias("last_crawled_at"),
        F.pmod(F.col("o_orderkey"), F.lit(120)).cast("int").alias("crawl_interval"),
    )


SQL_STATE = """state AS (
    SELECT o_orderkey AS id, 'https://shop.example/p' || CAST(o_orderkey * 3 AS VARCHAR) AS url,
           CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'PAUSED' END AS status,
           o_orderdate AS next_at, CAST(NULL AS TIMESTAMP) AS last_at,
           CAST(o_orderkey % 120 AS INTEGER) AS every
    FROM orders)"""


def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product URLs seen on order lines, with a tracking part to strip."""
    lines = table(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit("https://shop.example/p"), F.col("l_partkey").cast("string"),
                   F.lit("?seller="), F.col("l_suppkey").cast("string"))
    return lines.select(normalize_url(raw).alias("url"))


SQL_DISCOVERED = """discovered AS (
    SELECT DISTINCT 'https://shop.example/p' || CAST(l_partkey AS VARCHAR) AS url FROM lineitem)"""


# -- metrics --------------------------------------------------------------------------------

# The series that each event type stands for, by name in the catalogue.
EVENT_METRICS = {event: metric_type_of(metric) for event, metric in (
    ("click", "vCPU Core Usage"), ("error", "CPU utilization"), ("purchase", "Memory Bytes Used"),
    ("signup", "Memory percent used"), ("view", "Unused vCPU Cores"))}


def points_of(events: DataFrame) -> DataFrame:
    """Events as metric points: users are instances; the property k sets state and value kind."""
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int")
    kind = F.lit(None).cast("string")
    for event_type, metric_type in EVENT_METRICS.items():
        kind = F.when(F.col("event_type") == event_type, metric_type).otherwise(kind)
    return events.select(
        kind.alias("metric_type"),
        F.lit("gce_instance").alias("resource_type"),
        F.col("user_id").cast("string").alias("instance_id"),
        F.create_map(F.lit("state"), F.when(k >= 50, "used").otherwise("free")).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(k % 2 == 0, F.col("value")).alias("double_value"),
        F.when((k % 2 == 1) & (k != 7), F.floor("value")).alias("int64_value"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "events"))


_SQL_KINDS = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in EVENT_METRICS.items())
SQL_POINTS = f"""keyed AS (
    SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events),
points AS (
    SELECT CASE event_type {_SQL_KINDS} END AS metric_type, CAST(user_id AS VARCHAR) AS instance_id,
           CASE WHEN k >= 50 THEN 'used' ELSE 'free' END AS state, ts,
           CASE WHEN k % 2 = 0 THEN value WHEN k <> 7 THEN floor(value) END AS v
    FROM keyed)"""


def time_range(rows: DataFrame):
    """The first and the last instant of the points, the last one excluded by a second's margin."""
    low, high = rows.agg(F.min("ts"), F.timestamp_add("SECOND", F.lit(1), F.max("ts"))).first()
    return F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named instances: customers in credit. The others have no name on record."""
    customers = table(spark, sf_dir, "customer")
    return customers.where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("instance_id"), F.col("c_name").alias("hostname"))


SQL_HOSTS = """hosts AS (
    SELECT CAST(c_custkey AS VARCHAR) AS instance_id, c_name AS hostname
    FROM customer WHERE c_acctbal > 0)"""


def sql_bucket_end(period: str) -> str:
    return f"time_bucket(INTERVAL '{period}', ts) + INTERVAL '{period}'"
