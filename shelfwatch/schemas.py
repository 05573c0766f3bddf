"""Table contracts and the operator that makes a frame follow one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _field(name, dtype, required=False):
    return StructField(name, dtype, not required)


MESSAGE = StructType([
    _field("key", BinaryType()),
    _field("value", BinaryType()),
    _field("timestamp", TimestampType()),
])

# One crawl row: the breadcrumb list and its last entry are both kept.
CRAWL_ROW = StructType([
    _field("urlId", LongType(), required=True),
    _field("title", StringType(), required=True),
    _field("brand", StringType(), required=True),
    _field("price", DoubleType()),
    _field("discount", DoubleType()),
    _field("sellPrice", DoubleType(), required=True),
    _field("sold", IntegerType()),
    _field("productRate", DoubleType()),
    _field("productRateCount", IntegerType()),
    _field("categoryTree", ArrayType(StringType())),
    _field("category", StringType()),
    _field("brandOrigin", StringType(), required=True),
    _field("madeIn", StringType(), required=True),
    _field("warranty", StringType(), required=True),
    _field("description", StringType(), required=True),
    _field("seller", StringType(), required=True),
    _field("sellerRate", DoubleType()),
    _field("sellerRateCount", StringType()),
    _field("additionalInfo", ArrayType(StringType())),
    _field("timestamp", TimestampType(), required=True),
])

LAKE_ROW = StructType(CRAWL_ROW.fields + [_field("date", DateType())])

BRAND_DIM = StructType([
    _field("brand", StringType(), required=True),
    _field("brandOrigin", StringType(), required=True),
    _field("brandId", LongType(), required=True),
])

SELLER_DIM = StructType([
    _field("seller", StringType(), required=True),
    _field("sellerRate", DoubleType()),
    _field("sellerRateCount", StringType()),
    _field("sellerId", LongType(), required=True),
])

PRODUCT_DIM = StructType([
    _field("urlId", LongType(), required=True),
    _field("title", StringType(), required=True),
    _field("category", StringType()),
    _field("madeIn", StringType(), required=True),
    _field("warranty", StringType(), required=True),
])

# The title lives in the product dimension only.
SNAPSHOT_FACT = StructType([
    _field("urlId", LongType(), required=True),
    _field("price", DoubleType()),
    _field("discount", DoubleType()),
    _field("sellPrice", DoubleType(), required=True),
    _field("sold", IntegerType()),
    _field("productRate", DoubleType()),
    _field("productRateCount", IntegerType()),
    _field("category", StringType()),
    _field("madeIn", StringType(), required=True),
    _field("warranty", StringType(), required=True),
    _field("timestamp", TimestampType(), required=True),
    _field("brandId", LongType()),
    _field("sellerId", LongType()),
    _field("date", DateType()),
])

CRAWL_STATE = StructType([
    _field("id", LongType()),
    _field("url", StringType()),
    _field("status", StringType()),
    _field("next_crawled_at", TimestampType()),
    _field("last_crawled_at", TimestampType()),
    _field("crawl_interval", IntegerType()),
])

METRIC_POINT = StructType([
    _field("metric_type", StringType()),
    _field("resource_type", StringType()),
    _field("instance_id", StringType()),
    _field("labels", MapType(StringType(), StringType())),
    _field("ts", TimestampType()),
    _field("double_value", DoubleType()),
    _field("int64_value", LongType()),
])

_REQUIRED_DEFAULTS = {StringType: "", DoubleType: 0.0}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select, order and cast to ``schema``; fill required text and numbers with "" and 0.0.

    Columns the frame lacks become NULL (or the default, when required). A required column
    of any other type has no neutral value: rows with NULL there are dropped, and so are rows whose
    value cannot be cast, as casts give NULL instead of failing the job.
    """
    present = set(df.columns)
    keys = [f.name for f in schema.fields
            if not f.nullable and type(f.dataType) not in _REQUIRED_DEFAULTS]
    missing = [k for k in keys if k not in present]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    columns = []
    for field in schema.fields:
        column = F.lit(None).cast(field.dataType)
        if field.name in present:
            column = F.col(field.name)
            if df.schema[field.name].dataType != field.dataType:
                column = column.try_cast(field.dataType)
        default = _REQUIRED_DEFAULTS.get(type(field.dataType))
        if not field.nullable and default is not None:
            column = F.coalesce(column, F.lit(default))
        columns.append(column.alias(field.name))
    rows = df.select(*columns)
    return rows.dropna(subset=keys) if keys else rows
