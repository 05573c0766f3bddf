"""Business questions on the star schema.

Every top-N ends in a total order, so results repeat. Facts are reduced by key before they
meet a dimension: the join sees one row per key, not one per snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfwatch.operators.snapshot import latest_snapshot


def total_rows(dim: DataFrame, name: str) -> DataFrame:
    return dim.agg(F.count(F.lit(1)).alias(name))


def total_products(product_dim: DataFrame) -> DataFrame:
    return total_rows(product_dim, "total_products")


def total_brands(brand_dim: DataFrame) -> DataFrame:
    return total_rows(brand_dim, "total_brands")


def total_sellers(seller_dim: DataFrame) -> DataFrame:
    return total_rows(seller_dim, "total_sellers")


def category_counts(product_dim: DataFrame) -> DataFrame:
    """Products per category; products without one form a group of their own."""
    return product_dim.groupBy("category").agg(F.count(F.lit(1)).alias("products"))


def top_categories(product_dim: DataFrame, n: int) -> DataFrame:
    return category_counts(product_dim).orderBy(F.desc("products"), F.asc_nulls_last("category")).limit(n)


def with_share(top: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Share of each row in the total of a top-N result (at most N rows, one task)."""
    total = F.sum(value).over(Window.partitionBy())
    return top.withColumn(name, F.col(value) / total)


def category_share(product_dim: DataFrame, n: int) -> DataFrame:
    return with_share(top_categories(product_dim, n), "products")


def seller_counts(fact: DataFrame, mode: str = "rows") -> DataFrame:
    """Seller entries per product: fact rows with a seller, or distinct sellers."""
    if mode not in ("rows", "distinct"):
        raise ValueError("mode must be 'rows' or 'distinct'")
    count = F.count("sellerId") if mode == "rows" else F.count_distinct("sellerId")
    return fact.groupBy("urlId").agg(count.alias("seller_count"))


def potential_products(fact: DataFrame, product_dim: DataFrame, n: int, mode: str = "rows") -> DataFrame:
    """Fact rows of products with few sellers and many units sold: ``(title, sold, seller_count)``.

    Fact rows of a product with equal ``sold`` are carried as one row and a multiplicity, which
    is all the answer needs, so a product with very many snapshots stays small; the rows are
    restored behind the first cut, where at most ``n`` of them are left.
    """
    groups = fact.groupBy("urlId", "sold").agg(
        F.count(F.lit(1)).alias("rows"), F.count("sellerId").alias("with_seller"))
    if mode == "rows":
        sellers = groups.groupBy("urlId").agg(F.sum("with_seller").alias("seller_count"))
    else:
        sellers = seller_counts(fact, mode)
    order = [F.asc("seller_count"), F.desc_nulls_last("sold"), F.asc("title"), F.asc("urlId")]
    best = (groups.join(sellers, "urlId")
            .join(product_dim.select("urlId", "title"), "urlId")
            .orderBy(*order).limit(n))
    copies = F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(n))))
    restored = best.select("title", "sold", "seller_count", "urlId", copies.alias("_copy"))
    return restored.orderBy(*order).limit(n).select("title", "sold", "seller_count")


def countable_fact(fact: DataFrame, history: bool = False, as_of: date | str | None = None) -> DataFrame:
    """Fact rows whose ``sold`` may be added up.

    The page states units sold so far, so adding several days would count them again: only the
    newest snapshot of each product counts, up to ``as_of`` if given. ``history=True`` keeps all.
    """
    if as_of is not None:
        fact = fact.where(F.col("date") <= F.lit(as_of).cast("date"))
    return fact if history else latest_snapshot(fact)


def _top_sold(fact, dim, key, name, n):
    per_key = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("sold").alias("_sold"))
    named = per_key.join(dim.select(key, name), key)
    sums = named.groupBy(name).agg(F.sum("_sold").alias("sold"))
    return sums.orderBy(F.desc_nulls_last("sold"), F.asc(name)).limit(n)


def top_sold_brands(fact: DataFrame, brand_dim: DataFrame, n: int, history: bool = False,
                    as_of: date | str | None = None) -> DataFrame:
    return _top_sold(countable_fact(fact, history, as_of), brand_dim, "brandId", "brand", n)


def top_sold_sellers(fact: DataFrame, seller_dim: DataFrame, n: int, history: bool = False,
                     as_of: date | str | None = None) -> DataFrame:
    return _top_sold(countable_fact(fact, history, as_of), seller_dim, "sellerId", "seller", n)


# The column titles of the reports.
TITLES = {
    "category": "Category",
    "products": "Count",
    "title": "Product",
    "seller_count": "Seller Count",
    "brand": "Brand",
    "seller": "Seller",
    "sold": "Sold",
}


def with_titles(report: DataFrame) -> DataFrame:
    """A report under the column titles it is shown with."""
    return report.withColumnsRenamed({c: TITLES[c] for c in report.columns if c in TITLES})


# The reports as SQL over named tables, with N as a parameter.
REPORT_SQL = {
    "total_products": "SELECT count(*) AS total_products FROM {productDim}",
    "total_brands": "SELECT count(*) AS total_brands FROM {brandDim}",
    "total_sellers": "SELECT count(*) AS total_sellers FROM {sellerDim}",
    "top_categories": """
        SELECT category, count(*) AS products
        FROM {productDim}
        GROUP BY category
        ORDER BY products DESC, category ASC NULLS LAST
        LIMIT :n""",
    "potential_products": """
        WITH groups AS (
            SELECT urlId, sold, count(*) AS copies, count(sellerId) AS with_seller
            FROM {productSnapshotFact} GROUP BY urlId, sold
        ),
        sellers AS (SELECT urlId, sum(with_seller) AS seller_count FROM groups GROUP BY urlId),
        best AS (
            SELECT p.title, g.sold, s.seller_count, g.urlId, least(g.copies, :n) AS copies
            FROM groups g JOIN sellers s ON g.urlId = s.urlId JOIN {productDim} p ON g.urlId = p.urlId
            ORDER BY s.seller_count ASC, g.sold DESC NULLS LAST, p.title ASC, g.urlId ASC
            LIMIT :n
        )
        SELECT title, sold, seller_count
        FROM best LATERAL VIEW explode(sequence(1, copies)) AS copy
        ORDER BY seller_count ASC, sold DESC NULLS LAST, title ASC, urlId ASC
        LIMIT :n""",
    "top_sold_brands": """
        WITH per_key AS (
            SELECT brandId, sum(sold) AS sold FROM {productSnapshotFact} GROUP BY brandId
        )
        SELECT b.brand, sum(k.sold) AS sold
        FROM per_key k JOIN {brandDim} b ON k.brandId = b.brandId
        GROUP BY b.brand
        ORDER BY sold DESC NULLS LAST, brand ASC
        LIMIT :n""",
    "top_sold_sellers": """
        WITH per_key AS (
            SELECT sellerId, sum(sold) AS sold FROM {productSnapshotFact} GROUP BY sellerId
        )
        SELECT s.seller, sum(k.sold) AS sold
        FROM per_key k JOIN {sellerDim} s ON k.sellerId = s.sellerId
        GROUP BY s.seller
        ORDER BY sold DESC NULLS LAST, seller ASC
        LIMIT :n""",
}


def run_report(spark: SparkSession, name: str, tables: Mapping[str, DataFrame], n: int = 10, history: bool = False,
               as_of: date | str | None = None) -> DataFrame:
    """One of the SQL reports. ``tables`` maps table names to frames; ``n`` is a bound parameter.

    Units sold mean what they mean in the functions above: without ``history`` only the newest
    snapshot of each product counts, up to ``as_of`` if given.
    """
    text = REPORT_SQL[name]
    used = {t: df for t, df in tables.items() if "{" + t + "}" in text}
    if name.startswith("top_sold") and "productSnapshotFact" in used:
        used["productSnapshotFact"] = countable_fact(used["productSnapshotFact"], history, as_of)
    return spark.sql(text, args={"n": n} if ":n" in text else {}, **used)
