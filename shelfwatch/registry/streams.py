"""Streams over the given tables, run until the available input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwatch.operators.selectors import Selector
from shelfwatch.registry import query
from shelfwatch.registry.pages import SQL_EXTRACTED, SQL_TITLE, flat_rows, product_pages
from shelfwatch.registry.tables import sql_bucket_end, sql_stamp, stamp, table
from shelfwatch.session import scratch_path
from shelfwatch.sources.lake import read_lake, read_rejects
from shelfwatch.sources.messages import read_crawl_stream
from shelfwatch.streaming.align_stream import align_stream, write_series_stream
from shelfwatch.streaming.extract_stream import run_extract_stream, run_split_stream


def stream_table(spark, d, name):
    """The same table as a file stream, be it one file or a folder of files.

    A stream reads folders only, so a single file is picked out of the folder it lies in.
    """
    rows = table(spark, d, name)
    reader = spark.readStream.schema(rows.schema)
    if all(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(f"{d}/{name}.parquet")


def _finish(query_handle):
    query_handle.awaitTermination()


@query("stream_extract", f"""
SELECT page_id AS url_id, {SQL_TITLE} AS title,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%d') AS day
FROM pages""")
def stream_extract(spark, d):
    """Page messages through the extraction stream into the lake."""
    hours = F.timestamp_add("HOUR", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    messages = stream_table(spark, d, "pages").select(
        F.col("page_id").cast("string").cast("binary").alias("key"),
        F.col("html").cast("binary").alias("value"), hours.alias("timestamp"))
    path = scratch_path(spark, "stream-lake")
    _finish(run_extract_stream(messages, path, scratch_path(spark, "stream-state"), {"availableNow": True},
                               selectors={"title": Selector("h1")}))
    return read_lake(spark, path).select(
        F.col("urlId").alias("url_id"), "title", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("stream_mean_1m", f"""
WITH aligned AS (
    SELECT {sql_bucket_end('1 minute')} AS t, event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)
SELECT {sql_stamp('t')} AS ts, event_type, user_id, round(v, 6) AS metric_value FROM aligned
WHERE t <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)""")
def stream_mean_1m(spark, d):
    """Buckets the watermark has closed; later ones stay open."""
    points = stream_table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.col("value").alias("metric_value"))
    path = scratch_path(spark, "stream-series")
    aligned = align_stream(points, ["event_type", "user_id"])
    _finish(write_series_stream(aligned, path, scratch_path(spark, "stream-state"), {"availableNow": True}))
    rows = spark.read.parquet(path)
    return rows.select(stamp("timestamp").alias("ts"), "event_type", "user_id",
                       F.round("metric_value", 6).alias("metric_value"))


@query("stream_counter_1m", f"""
WITH last AS (
    SELECT {sql_bucket_end('1 minute')} AS t, event_type, user_id, value AS v FROM events
    QUALIFY row_number() OVER (
        PARTITION BY {sql_bucket_end('1 minute')}, event_type, user_id ORDER BY ts DESC, value DESC) = 1),
moved AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type, user_id ORDER BY t) AS change FROM last)
SELECT {sql_stamp('t')} AS ts, event_type, user_id, round(CASE WHEN change < 0 THEN v ELSE change END, 6) AS metric_value FROM moved
WHERE t <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)""")
def stream_counter_1m(spark, d):
    """The values as counters that fall now and then. The stream is stopped halfway and started on its checkpoint; rows
    come up to nine minutes late."""
    points = table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.col("value").alias("metric_value"))
    topic, path, state = (scratch_path(spark, n) for n in ("topic", "stream-series", "stream-state"))
    middle = points.agg(((F.min("ts").cast("double") + F.max("ts").cast("double")) / 2).alias("at")).scalar()
    delay = F.pmod(F.xxhash64("ts", "event_type", "user_id"), F.lit(540))
    early = F.coalesce(F.col("ts").cast("double") + delay < middle, F.lit(True))
    for part in (points.where(early), points.where(~early)):
        part.write.mode("append").parquet(topic)
        stream = spark.readStream.schema(points.schema).parquet(topic)
        aligned = align_stream(stream, ["event_type", "user_id"], aligner="delta", kind="cumulative")
        _finish(write_series_stream(aligned, path, state, {"availableNow": True}))
    return spark.read.parquet(path).select(stamp("timestamp").alias("ts"), "event_type", "user_id",
                                           F.round("metric_value", 6).alias("metric_value"))


@query("stream_trigger", f"""
SELECT page_id AS url_id, {SQL_TITLE} AS title FROM pages""")
def stream_trigger(spark, d):
    """The extraction on a timed trigger, stopped when everything there is has been taken in."""
    messages = stream_table(spark, d, "pages").select(
        F.col("page_id").cast("string").cast("binary").alias("key"), F.col("html").cast("binary").alias("value"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    path = scratch_path(spark, "stream-lake")
    running = run_extract_stream(messages, path, scratch_path(spark, "stream-state"), {"processingTime": "1 second"},
                                 selectors={"title": Selector("h1")})
    running.processAllAvailable()
    running.stop()
    return read_lake(spark, path).select(F.col("urlId").alias("url_id"), "title")


def _write_messages(pages, path):
    keyed = pages.select(F.col("urlId").cast("binary").alias("key"), F.col("html").cast("binary").alias("value"), "timestamp")
    keyed.write.mode("append").parquet(path)


@query("stream_products", SQL_EXTRACTED)
def stream_products(spark, d):
    """All fields of the product pages, from a message stream to the lake."""
    topic, lake = scratch_path(spark, "topic"), scratch_path(spark, "stream-lake")
    _write_messages(product_pages(spark, d), topic)
    messages = read_crawl_stream(spark, "parquet", path=topic)
    _finish(run_extract_stream(messages, lake, scratch_path(spark, "stream-state"), {"availableNow": True}))
    return flat_rows(read_lake(spark, lake))


@query("stream_restart", SQL_EXTRACTED)
def stream_restart(spark, d):
    """The stream stopped and started on one checkpoint: new messages are added once, old ones not again."""
    topic, lake, state = (scratch_path(spark, n) for n in ("topic", "stream-lake", "stream-state"))
    pages = product_pages(spark, d)
    odd = F.pmod(F.col("urlId").cast("long"), F.lit(2)) == 1
    for part in (pages.where(odd), pages.where(~odd), pages.limit(0)):
        _write_messages(part, topic)
        messages = read_crawl_stream(spark, "parquet", path=topic)
        _finish(run_extract_stream(messages, lake, state, {"availableNow": True}))
    return flat_rows(read_lake(spark, lake))


# Every third page comes without an id, or with one that is no whole number.
_BAD_ID = {0: None, 3: "page-{}", 6: "{}.5", 9: " "}
_SQL_BAD = "CASE page_id % 12 " + " ".join(
    f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("{}", "' || CAST(page_id AS VARCHAR) || '") + "'") for k, v in _BAD_ID.items()) + " END"


@query("stream_rejected", f"""
SELECT page_id, {_SQL_BAD} AS key, CASE WHEN page_id % 12 IN (0, 9) THEN 'no id' ELSE 'id is no whole number' END AS outcome,
       CAST(length(html) AS BIGINT) AS html_chars, CAST(NULL AS VARCHAR) AS title FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, CAST(page_id AS VARCHAR), 'kept', NULL, {SQL_TITLE} FROM pages WHERE page_id % 3 <> 0""")
def stream_rejected(spark, d):
    """Kept and rejected messages of the running stream, which is stopped halfway and started on its checkpoint."""
    number = F.col("page_id").cast("string")
    key = F.when(F.col("page_id") % 3 != 0, number)
    for k, v in _BAD_ID.items():
        if v is not None:
            key = F.when(F.col("page_id") % 12 == k, F.concat(*[F.lit(x) for x in v.split("{}")[:1]], *([number, F.lit(v.split("{}")[1])] if "{}" in v else []))).otherwise(key)
    at = F.timestamp_add("SECOND", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    pages = table(spark, d, "pages").select("page_id", key.cast("binary").alias("key"), F.col("html").cast("binary").alias("value"), at.alias("timestamp"))
    topic, lake, rejects, state = (scratch_path(spark, n) for n in ("topic", "stream-lake", "stream-rejects", "stream-state"))
    for part in (0, 1):
        pages.where(F.col("page_id") % 2 == part).drop("page_id").write.mode("append").parquet(topic)
        messages = read_crawl_stream(spark, "parquet", path=topic)
        _finish(run_split_stream(messages, lake, rejects, state, {"availableNow": True}, selectors={"title": Selector("h1")}))
    of_page = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp"), F.col("timestamp")).alias("page_id")
    lost = read_rejects(spark, rejects).select(of_page, F.col("urlId").alias("key"), F.col("reason").alias("outcome"),
                                               F.length("html").cast("long").alias("html_chars"), F.lit(None).cast("string").alias("title"))
    kept = read_lake(spark, lake).select(of_page, F.col("urlId").cast("string").alias("key"), F.lit("kept").alias("outcome"),
                                         F.lit(None).cast("long").alias("html_chars"), "title")
    return lost.unionByName(kept)
