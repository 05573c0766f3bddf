"""Streams give what the batch functions give, and restarts add nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch import registry
from shelfwatch.operators.align import align_mean
from shelfwatch.operators.selectors import Selector
from shelfwatch.plans.daily_load import run_daily
from shelfwatch.schemas import MESSAGE
from shelfwatch.sources.lake import read_day, read_lake
from shelfwatch.sources.messages import read_crawl_stream
from shelfwatch.streaming.align_stream import align_stream, write_series_stream
from shelfwatch.streaming.extract_stream import lake_rows, run_extract_stream

ONCE = {"availableNow": True}
T0 = dt.datetime(2026, 1, 1)


def write_messages(spark, path, start, n):
    rows = [(str(i if i % 5 else f"bad{i}").encode(), f"<h1 class='sc-c0f8c612-0 dEurho'>t{i}</h1><del>{i}.000</del>".encode(),
             T0 + dt.timedelta(hours=i)) for i in range(start, start + n)]
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def test_extract_stream_equals_batch_and_restarts(spark, tmp_path):
    source, lake, checkpoint = (str(tmp_path / n) for n in ("source", "lake", "checkpoint"))

    def run():
        stream = read_crawl_stream(spark, "parquet", path=source)
        run_extract_stream(stream, lake, checkpoint, ONCE).awaitTermination()
        return sorted(r["urlId"] for r in read_lake(spark, lake).collect())

    write_messages(spark, source, 0, 40)
    first = run()
    assert first == [i for i in range(40) if i % 5]
    assert run() == first
    write_messages(spark, source, 40, 20)
    assert run() == [i for i in range(60) if i % 5]

    # A file that no finished batch owns, as a failed task leaves behind, is not part of the lake.
    day = read_day(spark, lake, "2026-01-02").count()
    spark.read.parquet(lake + "/date=2026-01-02").write.mode("append").parquet(lake + "/date=2026-01-02")
    assert read_day(spark, lake, "2026-01-02").count() == day == 19
    with pytest.raises(ValueError, match="no rows"):
        run_daily(spark, lake, str(tmp_path / "warehouse"), "2025-01-01")

    columns = ["urlId", "title", "price", "sellPrice", "timestamp", "date"]
    batch = lake_rows(spark.read.parquet(source)).select(columns).collect()
    assert sorted(read_lake(spark, lake).select(columns).collect()) == sorted(batch)


def test_aligned_stream_emits_closed_buckets(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(seconds=17 * i), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "instance_id string, ts timestamp, metric_value double")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    write_series_stream(align_stream(stream, ["instance_id"]), out, checkpoint, ONCE).awaitTermination()
    closed = rows[-1][1] - dt.timedelta(minutes=10)
    want = align_mean(df, ["instance_id"]).where(F.col("timestamp") <= closed)
    assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect())
    late = align_stream(stream, ["instance_id"], aligner="delta")
    assert late.isStreaming and late.columns == ["timestamp", "instance_id", "metric_value"]


def test_stream_queries_read_folders_of_files(spark, tmp_path):
    """Tables of many files are folders; the stream queries give what they give on single files."""
    for name in ("pages", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    registry.load_all()
    for name in ("stream_extract", "stream_mean_1m"):
        one, many = (sorted(map(str, registry.QUERIES[name](spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one == many and one


def test_processing_time_trigger(spark, tmp_path):
    """The trigger of the running job: batches start on the clock until the query is stopped."""
    topic, lake = str(tmp_path / "topic"), str(tmp_path / "lake")
    html = F.concat(F.lit("<h1>page "), F.col("id").cast("string"), F.lit("</h1>"))
    spark.range(5).select(F.col("id").cast("string").cast("binary").alias("key"), html.cast("binary").alias("value"),
                          F.lit("2024-01-01").cast("timestamp").alias("timestamp")).write.parquet(topic)
    query = run_extract_stream(read_crawl_stream(spark, "parquet", path=topic), lake, str(tmp_path / "state"),
                               {"processingTime": "1 second"}, selectors={"title": Selector("h1")})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["title"] for r in read_lake(spark, lake).collect()) == [f"page {i}" for i in range(5)]
