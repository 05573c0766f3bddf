"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def surrogate_key(natural: Column) -> Column:
    """64-bit hash of a natural key; NULL stays NULL, as it would in a lookup join."""
    return F.when(natural.isNotNull(), F.xxhash64(natural))
