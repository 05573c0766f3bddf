"""Crawl messages: keyed pages on a topic, or the same columns in files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwatch.schemas import MESSAGE


def kafka_options(servers: str, topic: str, starting: str = "earliest", **more: str) -> dict[str, str]:
    """Options of the topic source.

    ``maxOffsetsPerTrigger`` bounds a micro-batch; ``minPartitions`` cuts a topic partition that
    holds much of the topic, so that its pages are parsed by several tasks.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **more,
    }


def read_crawl_stream(spark: SparkSession, fmt: str = "kafka", options: Mapping[str, str] | None = None,
                      path: str | None = None) -> DataFrame:
    """Stream of ``key``, ``value``, ``timestamp``. File formats need a path and carry those columns."""
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        return reader.load()
    return reader.schema(MESSAGE).load(path)


def decode_messages(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("key").cast("string").alias("urlId"),
        F.col("value").cast("string").alias("html"),
        F.col("timestamp"),
    )


def to_messages(pages: DataFrame, id_column: str = "urlId", html: str = "html") -> DataFrame:
    """Crawled pages as messages: the id text is the key, the page bytes are the value."""
    return pages.select(
        F.col(id_column).cast("string").cast("binary").alias("key"),
        F.col(html).cast("binary").alias("value"),
    )


# The delivery settings of the page producer.
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.linger.ms": "10",
    "kafka.compression.type": "snappy",
}


def publish_messages(messages: DataFrame, servers: str, topic: str, **more: str) -> None:
    writer = messages.write.format("kafka").options(**PRODUCER_OPTIONS)
    writer.options(**{"kafka.bootstrap.servers": servers, "topic": topic, **more}).save()
