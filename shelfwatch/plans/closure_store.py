"""A crawl closure that is kept, and brought up to date from added links only.

Under one folder lie ``edges`` (src, dst) in buckets of src and ``hops`` (url, hop) in buckets of url, as folders
``load=<name>/[round=<n>/]bucket=<n>``. A load is a full run or an update. Its name stands in ``commits`` once everything of it
is written, and files of other names are not read: a load that dies has changed nothing, and is simply run again.
Hops are only ever added: an update writes a URL again where it is new or now nearer, and the hop of a URL is its
smallest. Links can be added, not taken away; after removals make a new store. One load at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.functions.text import normalize_url
from shelfwatch.plans.crawl import closure_of

BUCKETS = 256
_EDGES, _HOPS = "src string, dst string, load string, bucket int", "url string, hop int, load string, round int, bucket int"


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Names of finished loads, a line each, and the number of buckets."""
    try:
        lines = spark.read.schema("load string, buckets int").parquet(f"{path}/commits").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return [], BUCKETS
    return [r["load"] for r in lines], lines[0]["buckets"] if lines else BUCKETS


def _commit(spark: SparkSession, path: str, load: str, buckets: int) -> None:
    line = spark.range(1, numPartitions=1).select(F.lit(load).alias("load"), F.lit(buckets).alias("buckets"))
    line.write.mode("append").parquet(f"{path}/commits")


def _write(df: DataFrame, folder: str, key: str, buckets: int) -> None:
    """Into buckets of the key. A bucket goes to several tasks where it is large: a page that holds a third of all links too."""
    (df.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", key)
     .write.partitionBy("bucket").parquet(folder))


def _pruned(frame: DataFrame, loads: list[str], touched: list[int] | None) -> DataFrame:
    frame = frame.where(F.col("load").isin(loads))
    return frame if touched is None else frame.where(F.col("bucket").isin(touched))


def _edges(spark: SparkSession, path: str, loads: list[str], touched: list[int] | None = None) -> DataFrame:
    return _pruned(spark.read.schema(_EDGES).parquet(f"{path}/edges"), loads, touched).select("src", "dst")


def _hops(spark: SparkSession, path: str, loads: list[str], touched: list[int] | None = None) -> DataFrame:
    found = _pruned(spark.read.schema(_HOPS).parquet(f"{path}/hops"), loads, touched)
    return found.groupBy("url").agg(F.min("hop").alias("hop"))


def _touched(df: DataFrame, key: str, buckets: int) -> list[int]:
    return sorted(r[0] for r in df.select(_bucket(key, buckets)).distinct().collect())  # a number per bucket


def read_closure(spark: SparkSession, path: str) -> DataFrame:
    """(url, hop): what is reachable, and in how many steps at least."""
    loads, _ = _commits(spark, path)
    return _hops(spark, path, loads)


def start_closure(edges: DataFrame, seeds: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The closure of ``seeds (url)`` over ``edges (src, dst)`` in one full run, kept at ``path``, which must be new."""
    spark, load = edges.sparkSession, uuid.uuid4().hex
    _write(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), f"{path}/edges/load={load}", "src", buckets)
    kept = _edges(spark, path, [load])
    _write(closure_of(kept, seeds).select("url", "hop"), f"{path}/hops/load={load}/round=0", "url", buckets)
    _commit(spark, path, load, buckets)
    return read_closure(spark, path)


def add_to_closure(added: DataFrame, path: str, seeds: DataFrame | None = None) -> DataFrame:
    """The closure after ``added (src, dst)`` links, and perhaps further seeds: delta breadth-first search.

    It starts from the added links alone. A round takes the URLs that became reachable or nearer, and only their
    buckets of old links and hops are read; a URL that keeps its hop is not followed again. So the work goes by
    what changes, and an update that changes nothing reads the buckets of its own ends.
    """
    spark, load = added.sparkSession, uuid.uuid4().hex
    loads, buckets = _commits(spark, path)
    if not loads:
        raise ValueError(f"no closure at {path}")
    named = added.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> ''").distinct()
    _write(named, f"{path}/edges/load={load}", "src", buckets)
    fresh = spark.read.schema("src string, dst string, bucket int").parquet(f"{path}/edges/load={load}").select("src", "dst")
    known = _hops(spark, path, loads, _touched(fresh, "src", buckets))
    reached = fresh.join(known, F.col("src") == F.col("url")).select(F.col("dst").alias("url"), (F.col("hop") + 1).alias("hop"))
    if seeds is not None:
        reached = reached.unionByName(seeds.select(normalize_url(F.col("url")).alias("url"), F.lit(0).alias("hop")).where("url <> ''"))
    turn = 0
    while True:
        folder = f"{path}/reached/load={load}/round={turn}"
        reached.groupBy("url").agg(F.min("hop").alias("hop")).write.parquet(folder)
        nearest = spark.read.schema("url string, hop int").parquet(folder)
        own = [*loads, load] if turn else loads
        old = _hops(spark, path, own, _touched(nearest, "url", buckets)).withColumnsRenamed({"url": "_url", "hop": "_hop"})
        better = nearest.join(old, F.col("url") == F.col("_url"), "left").where("_hop IS NULL OR hop < _hop").select("url", "hop")
        changed = f"{path}/hops/load={load}/round={turn}"
        _write(better, changed, "url", buckets)
        frontier = spark.read.schema("url string, hop int, bucket int").parquet(changed).select("url", "hop")
        sources = _touched(frontier, "url", buckets)
        if not sources:
            break
        links = _edges(spark, path, [*loads, load], sources)
        reached = links.join(frontier, F.col("src") == F.col("url")).select(F.col("dst").alias("url"), (F.col("hop") + 1).alias("hop"))
        turn += 1
    _commit(spark, path, load, buckets)
    return read_closure(spark, path)
