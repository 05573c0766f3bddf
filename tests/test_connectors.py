"""Connectors whose servers are not here: which options reach them."""

from unittest.mock import MagicMock

from shelfwatch.sources import messages as S
from shelfwatch.sources.warehouse import overwrite_table


def test_jdbc_table_is_truncated_with_the_callers_options():
    df = MagicMock()
    overwrite_table(df, {"url": "jdbc:x", "dbtable": "brandDim"})
    df.write.mode.assert_called_with("overwrite")
    writer = df.write.mode.return_value
    writer.format.assert_called_with("jdbc")
    writer.format.return_value.options.assert_called_with(truncate="true", url="jdbc:x", dbtable="brandDim")
    writer.format.return_value.options.return_value.save.assert_called_once_with()


def test_topic_source_and_sink_options():
    spark = MagicMock()
    S.read_crawl_stream(spark, "kafka", S.kafka_options("host:1", "pages"))
    spark.readStream.format.assert_called_with("kafka")
    spark.readStream.format.return_value.options.assert_called_with(
        **{"kafka.bootstrap.servers": "host:1", "subscribe": "pages", "startingOffsets": "earliest"})

    df = MagicMock()
    S.publish_messages(df, "host:1", "pages")
    df.write.format.assert_called_with("kafka")
    first = df.write.format.return_value.options
    first.assert_called_with(**S.PRODUCER_OPTIONS)
    first.return_value.options.assert_called_with(**{"kafka.bootstrap.servers": "host:1", "topic": "pages"})
