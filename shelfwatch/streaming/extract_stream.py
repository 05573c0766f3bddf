"""Messages to lake, as a stream. Every step but source and sink is the batch function."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwatch.functions.time import partition_date
from shelfwatch.operators.extract import PRODUCT_SELECTORS, DetailLabels, extract_products, reject_reason, to_lake_rows
from shelfwatch.operators.selectors import Selector
from shelfwatch.sources.lake import write_batch, write_lake_stream
from shelfwatch.sources.messages import decode_messages


def lake_rows(messages: DataFrame, selectors: Mapping[str, Selector] = PRODUCT_SELECTORS,
              labels: DetailLabels = DetailLabels(), zone: str | None = None) -> DataFrame:
    """Messages to dated crawl rows, for a table or a stream."""
    return to_lake_rows(extract_products(decode_messages(messages), selectors, labels), zone)


def run_extract_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    selectors: Mapping[str, Selector] = PRODUCT_SELECTORS,
    labels: DetailLabels = DetailLabels(),
    zone: str | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """Start the extraction. Restarting with the same checkpoint resumes without duplicates."""
    return write_lake_stream(lake_rows(messages, selectors, labels, zone), path, checkpoint, trigger, files)


def run_split_stream(
    messages: DataFrame,
    path: str,
    rejects: str,
    checkpoint: str,
    trigger: dict | None = None,
    selectors: Mapping[str, Selector] = PRODUCT_SELECTORS,
    labels: DetailLabels = DetailLabels(),
    zone: str | None = None,
) -> StreamingQuery:
    """The extraction with two sinks: product rows to the lake at ``path``, messages that no id can be read from to ``rejects``.

    A micro-batch is decoded and its ids are read once; both writes go on from that, and a lost block of it is read
    again from the source. Each sink keeps the rows of a batch in folders of the batch's number and replaces
    these as a whole. If a batch fails between the two writes, or before its end is noted, the restarted stream
    gives it the same number and the same messages, and writes both again: kept and rejected rows together are what was
    read, each once. ``read_rejects`` reads the second sink.
    """
    def split(batch: DataFrame, number: int) -> None:
        decoded = decode_messages(batch).withColumn("reason", reject_reason(F.col("urlId"))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            kept = decoded.where(F.col("reason").isNull()).drop("reason")
            write_batch(to_lake_rows(extract_products(kept, selectors, labels), zone), path, number)
            lost = decoded.where(F.col("reason").isNotNull())
            write_batch(lost.withColumn("date", partition_date(F.col("timestamp"), zone)), rejects, number)
        finally:
            decoded.unpersist()

    return (messages.writeStream.foreachBatch(split)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"}))
            .start())
