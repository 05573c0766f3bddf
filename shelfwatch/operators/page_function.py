"""The selector stage as an SQL table function: ``SELECT * FROM page_fields(TABLE(pages))``.

The function reads each page of its table argument once and gives a row per page: the kept columns, then a column per
selector, in the types that the selectors have. ``product_rows`` of ``register_page_functions`` takes it on to typed products.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from shelfwatch.functions import text as T
from shelfwatch.operators.extract import PRODUCT_SELECTORS, DetailLabels, normalize
from shelfwatch.operators.selectors import Selector, read_page


def page_function(selectors: Mapping[str, Selector], keep: Sequence[str] = (), html: str = "html") -> UserDefinedTableFunction:
    """A table function over a table that has the ``keep`` columns and the page; other columns are left behind.

    A page that is NULL or cannot be read gives NULL for every selector. Partitioning the argument changes nothing in
    the rows; it only says which task reads them.
    """
    selectors, keep = dict(selectors), tuple(keep)

    class PageFields:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("the argument must be a table: TABLE(name) or TABLE(SELECT ...)")
            names = pages.dataType.fieldNames()
            missing = [c for c in (*keep, html) if c not in names]
            if missing:
                raise ValueError(f"the table has no column {', '.join(missing)}; it has {', '.join(names)}")
            kept = [StructField(c, pages.dataType[c].dataType) for c in keep]
            return AnalyzeResult(StructType(kept + [StructField(name, s.spark_type()) for name, s in selectors.items()]))

        def eval(self, page):
            row = read_page(page[html], selectors)
            yield (*[page[c] for c in keep], *[_rows(row[name]) for name in selectors])

    return udtf(PageFields)


def _rows(value):
    """Label pairs as tuples, which structs are made of."""
    if isinstance(value, list) and value and isinstance(value[0], dict):
        return [(pair["k"], pair["v"]) for pair in value]
    return value


def register_page_functions(spark: SparkSession, selectors: Mapping[str, Selector] = PRODUCT_SELECTORS, name: str = "page_fields") -> None:
    """``page_fields(TABLE(...))`` over tables with urlId, html and timestamp, for this session."""
    spark.udtf.register(name, page_function(selectors, ("urlId", "timestamp")))


def product_rows(spark: SparkSession, table: str, labels: DetailLabels = DetailLabels(), name: str = "page_fields") -> DataFrame:
    """The typed products of an SQL table or view of messages, read by the registered function."""
    raw = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT urlId, html, timestamp FROM {table}))")
    return normalize(raw.withColumn("urlId", T.safe_long(raw["urlId"])).where("urlId IS NOT NULL"), labels)
