"""Dates, zones and intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_local(ts: Column, zone: str) -> Column:
    """Wall clock of an instant in ``zone`` (TIMESTAMP_NTZ), whatever the session zone is."""
    return F.convert_timezone(None, F.lit(zone), ts.cast("timestamp_ntz"))


def partition_date(ts: Column, zone: str | None = None) -> Column:
    """Calendar day of an instant: in ``zone``, or in the session zone when none is given."""
    return F.to_date(ts if zone is None else to_local(ts, zone))


def add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)
