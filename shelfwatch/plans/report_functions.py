"""The reports as SQL table functions: ``SELECT * FROM top_sold_brands(10, as_of => DATE'2026-01-31')``.

The functions are temporary, of one session, over the views ``productSnapshotFact``, ``productDim``, ``brandDim`` and ``sellerDim``. What counts
as the newest snapshot is part of their SQL. Constant arguments are folded into the plan: of the two branches of
``history`` one is left, a day reaches the scan as a filter, and the top rows are cut in every task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_FAR = "DATE'9999-12-31'"

# The fact rows whose ``sold`` may be added up: all up to the day, or the newest of each product, ties kept.
_COUNTABLE = f"""
    newest AS (
        SELECT urlId AS newestId, max(timestamp) AS newestAt FROM productSnapshotFact
        WHERE coalesce(date, {_FAR}) <= coalesce(as_of, {_FAR}) GROUP BY urlId
    ),
    countable AS (
        SELECT * FROM productSnapshotFact WHERE history AND coalesce(date, {_FAR}) <= coalesce(as_of, {_FAR})
        UNION ALL
        SELECT * FROM productSnapshotFact LEFT SEMI JOIN newest ON urlId <=> newestId AND timestamp <=> newestAt
        WHERE NOT history AND coalesce(date, {_FAR}) <= coalesce(as_of, {_FAR})
    )"""


def _total(dim: str, name: str) -> tuple[str, str, str]:
    return "", f"{name} BIGINT", f"SELECT count(*) AS {name} FROM {dim}"


def _top_sold(dim: str, key: str, name: str) -> tuple[str, str, str]:
    return "n INT DEFAULT 10, history BOOLEAN DEFAULT false, as_of DATE DEFAULT NULL", f"{name} STRING, sold BIGINT", f"""
    WITH {_COUNTABLE},
    per_key AS (SELECT {key}, sum(sold) AS sold FROM countable WHERE {key} IS NOT NULL GROUP BY {key}),
    sums AS (SELECT d.{name}, sum(k.sold) AS sold FROM per_key k JOIN {dim} d ON k.{key} = d.{key} GROUP BY d.{name})
    SELECT {name}, sold FROM (
        SELECT *, row_number() OVER (ORDER BY sold DESC NULLS LAST, {name} ASC) AS place FROM sums)
    WHERE place <= n"""


# Name: parameters, columns of the result, body.
FUNCTIONS = {
    "total_products": _total("productDim", "total_products"),
    "total_brands": _total("brandDim", "total_brands"),
    "total_sellers": _total("sellerDim", "total_sellers"),
    "top_categories": ("n INT DEFAULT 10", "category STRING, products BIGINT", """
    SELECT category, products FROM (
        SELECT *, row_number() OVER (ORDER BY products DESC, category ASC NULLS LAST) AS place
        FROM (SELECT category, count(*) AS products FROM productDim GROUP BY category))
    WHERE place <= n"""),
    "potential_products": ("n INT DEFAULT 20", "title STRING, sold INT, seller_count BIGINT", """
    WITH parts AS (
        SELECT urlId, sold, count(*) AS copies, count(sellerId) AS with_seller FROM productSnapshotFact GROUP BY urlId, sold
    ),
    sellers AS (SELECT urlId, sum(with_seller) AS seller_count FROM parts GROUP BY urlId),
    best AS (
        SELECT * FROM (
            SELECT p.title, g.sold, s.seller_count, g.urlId, g.copies,
                   row_number() OVER (ORDER BY s.seller_count ASC, g.sold DESC NULLS LAST, p.title ASC, g.urlId ASC) AS place
            FROM parts g JOIN sellers s ON g.urlId = s.urlId JOIN productDim p ON g.urlId = p.urlId)
        WHERE place <= n
    ),
    restored AS (
        SELECT title, sold, seller_count, row_number() OVER (ORDER BY place, copy) AS place
        FROM best LATERAL VIEW explode(sequence(1, least(copies, CAST(n AS BIGINT)))) AS copy
    )
    SELECT title, sold, seller_count FROM restored WHERE place <= n"""),
    "top_sold_brands": _top_sold("brandDim", "brandId", "brand"),
    "top_sold_sellers": _top_sold("sellerDim", "sellerId", "seller"),
}

TABLES = ("productSnapshotFact", "productDim", "brandDim", "sellerDim")


def create_report_functions(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Views of ``tables`` under their names, and the functions over them; both replace older ones of the session."""
    missing = [t for t in TABLES if t not in tables]
    if missing:
        raise ValueError(f"tables are missing: {missing}")
    for name in TABLES:
        tables[name].createOrReplaceTempView(name)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
