"""Dimensions, their keys and the fact projection of the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfwatch.functions.keys import surrogate_key
from shelfwatch.schemas import BRAND_DIM, PRODUCT_DIM, SELLER_DIM, SNAPSHOT_FACT, conform

SEEN = "lastSeen"

BRAND_COLUMNS = ("brand", "brandOrigin")
SELLER_COLUMNS = ("seller", "sellerRate", "sellerRateCount")
PRODUCT_COLUMNS = ("urlId", "title", "category", "madeIn", "warranty")


def newest_per_key(
    df: DataFrame, key: str, columns: Sequence[str], seen: str, lowest: str | None = None
) -> DataFrame:
    """One row per key: the newest, then the lowest ``lowest``, then the greatest values.

    Every map task reduces a key to one row before the shuffle. As the greatest is a struct, Spark sorts
    a task's rows by key to reduce them, which spills where it must.
    """
    attributes = [c for c in columns if c != key]
    order = [F.col(seen).alias("_seen")]
    if lowest is not None:
        order.append((-F.col(lowest).cast("long")).alias("_lowest"))
    best = F.max(F.struct(*order, *attributes)).alias("_best")
    rows = df.groupBy(key).agg(best)
    return rows.select(key, *[F.col("_best")[c].alias(c) for c in attributes],
                       F.col("_best")["_seen"].alias(SEEN))


def brand_dim(snapshot: DataFrame) -> DataFrame:
    rows = newest_per_key(snapshot, "brand", BRAND_COLUMNS, "timestamp", "urlId")
    return rows.withColumn("brandId", surrogate_key(F.col("brand")))


def seller_dim(snapshot: DataFrame) -> DataFrame:
    rows = newest_per_key(snapshot, "seller", SELLER_COLUMNS, "timestamp", "urlId")
    return rows.withColumn("sellerId", surrogate_key(F.col("seller")))


def product_dim(snapshot: DataFrame) -> DataFrame:
    return newest_per_key(snapshot, "urlId", PRODUCT_COLUMNS, "timestamp")


# Contract, natural key and builder of each dimension.
DIMENSIONS = {
    "brandDim": (BRAND_DIM, "brand", brand_dim),
    "sellerDim": (SELLER_DIM, "seller", seller_dim),
    "productDim": (PRODUCT_DIM, "urlId", product_dim),
}


def merge_dimension(current: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """Union of two dimension states; the row seen last wins. Order of loads does not matter."""
    if current is None:
        return incoming
    columns = [c for c in incoming.columns if c != SEEN]
    both = current.select(*incoming.columns).unionByName(incoming)
    return newest_per_key(both, key, columns, SEEN).select(*incoming.columns)


def merge_streamed(current: DataFrame, incoming: DataFrame, key: str, few: bool = False) -> DataFrame:
    """``merge_dimension`` for a large state and few incoming rows, both with one row per key, without an aggregate.

    The state is only ever the streamed side of joins with incoming rows. With ``few``, which the caller has counted, these are
    broadcast, and so are the ones of them that the state knows: the state is not shuffled. More are joined by sorting, as the
    optimizer would take the size of their files, packed, for that in memory and send them through the driver, too.
    """
    side = F.broadcast if few else (lambda df: df.hint("merge"))
    attributes = [c for c in incoming.columns if c != key]
    order = [SEEN, *[c for c in attributes if c != SEEN]]
    new = incoming.select(F.col(key).alias("_key"), F.struct(*order).alias("_new"))
    own = F.struct(*order)
    best = F.when(F.col("_new").isNull() | (own >= F.col("_new")), own).otherwise(F.col("_new")).alias("_best")
    joined = current.join(side(new), current[key] == F.col("_key"), "left").select(key, best)
    kept = joined.select(key, *[F.col("_best")[c].alias(c) for c in attributes]).select(*incoming.columns)
    known = current.select(F.col(key).alias("_known")).join(side(new.select("_key")), F.col("_known") == F.col("_key"), "left_semi")
    return kept.unionByName(incoming.join(side(known), F.col(key) == F.col("_known"), "left_anti"))


def lookup_key(df: DataFrame, dim: DataFrame, on: str, key: str) -> DataFrame:
    """Left join to a dimension for its surrogate key; unknown values get NULL.

    The build side is left to the optimizer: it broadcasts a dimension only when its measured
    size allows, and splits a hot value otherwise.
    """
    return df.join(dim.select(on, key), on, "left")


def derive_keys(df: DataFrame) -> DataFrame:
    """Brand and seller keys without a join.

    The key is a function of the natural key, and the dimension is built from the same rows,
    so looking it up could only return this value.
    """
    return df.withColumns({
        "brandId": surrogate_key(F.col("brand")),
        "sellerId": surrogate_key(F.col("seller")),
    })


def snapshot_fact(keyed: DataFrame) -> DataFrame:
    """Measures, keys and the load date; texts and dimension attributes are left behind."""
    return conform(keyed, SNAPSHOT_FACT)
