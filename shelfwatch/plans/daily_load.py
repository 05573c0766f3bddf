"""The daily warehouse load, repeatable per day."""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from shelfwatch.operators.dimensions import (
    BRAND_COLUMNS,
    DIMENSIONS,
    PRODUCT_COLUMNS,
    SELLER_COLUMNS,
    derive_keys,
    snapshot_fact,
)
from shelfwatch.operators.snapshot import latest_snapshot
from shelfwatch.plans.validity import update_validity
from shelfwatch.schemas import LAKE_ROW, SNAPSHOT_FACT
from shelfwatch.session import build_session
from shelfwatch.sources.lake import read_day
from shelfwatch.sources.warehouse import load_fact, merge_into_dimension

_USED = {*BRAND_COLUMNS, *SELLER_COLUMNS, *PRODUCT_COLUMNS, *SNAPSHOT_FACT.fieldNames()}
NEEDED = [name for name in LAKE_ROW.fieldNames() if name in _USED]


def run_daily(spark: SparkSession, lake: str, warehouse: str, day: date | str, ties: str = "keep", validity: bool = True) -> None:
    """Newest snapshot of one lake day into three dimensions and the fact, and with ``validity`` into the table of
    what counts when.

    The fact day is replaced, other days stay. Dimensions keep what earlier days brought; the
    row seen last wins, so days may be loaded again or out of order. One load at a time.
    """
    tie_break = ("price", "sellPrice", "sold", "seller", "brand", "title")
    # Description, breadcrumbs and label pairs, the widest columns of the lake, have no place in the
    # warehouse: they are left in the files.
    rows = read_day(spark, lake, day).select(*NEEDED)
    snapshot = latest_snapshot(rows, ties=ties, tie_break=tie_break if ties == "one" else ())
    # Four writes read it; lost blocks are recomputed from the lake.
    snapshot = snapshot.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if snapshot.isEmpty():
            raise ValueError(f"the lake has no rows for {day}")
        # Dimensions first: at no time does the fact hold a key that its dimension lacks. They are
        # tables of their own, and their jobs are short, so they run side by side.
        def merge(item):
            name, (_, _, build) = item
            merge_into_dimension(spark, warehouse, name, build(snapshot))

        with ThreadPoolExecutor(len(DIMENSIONS)) as pool:
            list(pool.map(merge, DIMENSIONS.items()))
        fact = snapshot_fact(derive_keys(snapshot))
        load_fact(fact, f"{warehouse}/productSnapshotFact")
        if validity:
            update_validity(fact, warehouse, day)
    finally:
        snapshot.unpersist()


def main() -> None:
    """Command line: a failing job raises, and the exit code says so."""
    parser = argparse.ArgumentParser(description="Load one day of crawled products")
    parser.add_argument("--lake", required=True)
    parser.add_argument("--warehouse", required=True)
    parser.add_argument("--partition", required=True, type=date.fromisoformat, help="day as yyyy-MM-dd")
    parser.add_argument("--ties", choices=("keep", "one"), default="keep")
    args = parser.parse_args()
    spark = build_session("daily-load")
    try:
        run_daily(spark, args.lake, args.warehouse, args.partition, args.ties)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
