"""A dimension that grows: buckets by its size, old rows not shuffled by the merge."""

import datetime as dt
import subprocess
import sys

from pyspark.sql import functions as F

from shelfwatch.operators import dimensions as D
from shelfwatch.sources import warehouse as W

T0 = dt.datetime(2026, 1, 1)


def products(spark, ids, title, day):
    return ids.select(F.col("id").alias("urlId"), F.concat(F.lit(f"{title} "), F.sha2(F.col("id").cast("string"), 256)).alias("title"),
                      F.lit(None).cast("string").alias("category"), F.lit("here").alias("madeIn"), F.lit("").alias("warranty"),
                      F.lit(T0 + dt.timedelta(days=day)).alias(D.SEEN))


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_ROWS", 100)
    W.merge_into_dimension(spark, str(tmp_path), "productDim", products(spark, spark.range(3000), "t", 0))
    assert {r["buckets"] for r in spark.read.parquet(f"{tmp_path}/productDim/commits").collect()} == {30}
    W.merge_into_dimension(spark, str(tmp_path), "productDim", products(spark, spark.range(5), "u", 1))
    titles = {r["urlId"]: r["title"][0] for r in W.read_dimension(spark, str(tmp_path), "productDim").collect()}
    assert len(titles) == 3000 and {i for i, t in titles.items() if t == "u"} == set(range(5))


def test_old_rows_are_not_shuffled_by_the_merge(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setitem(W.BUCKETS, "productDim", 2)
    W.merge_into_dimension(spark, path, "productDim", products(spark, spark.range(0, 60_000, 1, 8), "t", 0))
    versions = W._versions(spark, path, "productDim")
    incoming = products(spark, spark.range(59_990, 60_010), "new", 1)
    for rows, shuffles in ((20, 0), (W.BROADCAST_ROWS + 1, 1)):
        held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = W.merged_rows(spark, path, "productDim", incoming, versions, rows)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        assert (plan.count("Exchange hashpartitioning") > 0) == bool(shuffles) and ("BroadcastHashJoin" in plan) == (not shuffles)
    W.merge_into_dimension(spark, path, "productDim", incoming)
    titles = {r["urlId"]: r["title"][0] for r in W.read_dimension(spark, path, "productDim").collect()}
    assert len(titles) == 60_010 and sum(t == "n" for t in titles.values()) == 20


def test_many_incoming_rows_do_not_pass_through_the_driver(spark, tmp_path):
    """Their files are small, packed as they are; the optimizer alone would broadcast them."""
    path = str(tmp_path)
    W.merge_into_dimension(spark, path, "productDim", products(spark, spark.range(0, 60_000, 1, 8), "t", 0))
    products(spark, spark.range(50_000, 160_000), "new", 1).write.parquet(f"{path}/incoming")
    incoming = spark.read.parquet(f"{path}/incoming")
    merged = W.merged_rows(spark, path, "productDim", incoming, W._versions(spark, path, "productDim"), 110_000)
    rows = merged.groupBy(F.substring("title", 1, 1).alias("t")).count()
    assert {r["t"]: r["count"] for r in rows.collect()} == {"t": 50_000, "n": 110_000}
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_streamed_merge_equals_merge(spark):
    rows = [("a", "x", 0), ("b", None, 1), ("c", "z", 1), ("d", "m", 2)], [("b", "y", 1), ("c", "w", 0), ("d", "n", 2), ("e", None, 5)]
    old, new = [spark.createDataFrame([(k, v, T0 + dt.timedelta(days=d)) for k, v, d in r], f"brand string, brandOrigin string, {D.SEEN} timestamp") for r in rows]
    for a, b in ((old, new), (new, old)):
        assert sorted(map(str, D.merge_streamed(a, b, "brand").collect())) == sorted(map(str, D.merge_dimension(a, b, "brand").collect()))


def test_entry_without_an_optional_package():
    """A package that only some training-data queries need takes none of the others down."""
    code = ("import sys; sys.modules['public_tokenizers'] = None; sys.modules['sentencepiece'] = None; sys.modules['tokenizers'] = None\n"
            "import __spark_entry__ as e; names = set(e.queries()); import shelfwatch.registry as r\n"
            "assert set(r.QUERIES) <= names; print(len(names) - len(r.QUERIES))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(W.__file__).parents[2]))
    assert out.returncode == 0, out.stderr
    blocked = code.replace("sys.modules['public_tokenizers'] = None;", "sys.modules['shelfwatch.llm'] = None;")
    out = subprocess.run([sys.executable, "-c", blocked], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(W.__file__).parents[2]))
    assert out.returncode == 0 and out.stdout.strip() == "0", out.stderr
