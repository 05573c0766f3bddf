"""Spark-native analytics for crawled product pages and machine metrics."""
