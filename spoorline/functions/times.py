"""Timestamps of the record formats as Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_epoch(number: Column) -> Column:
    """Unix seconds of a number given in s, ms (> 1e12) or ns (> 1e15)."""
    return (
        F.when(number > 1e15, number / 1e9).when(number > 1e12, number / 1e3).otherwise(number)
    )


def to_epoch(text: Column, compat: bool = False) -> Column:
    """Unix seconds of a numeric or ISO-8601 string; NULL (``compat``: 0.0) when it is neither."""
    number = text.try_cast("double")
    instant = F.unix_micros(text.try_cast("timestamp")) / 1e6
    # a finite number first: a bare number would otherwise be read as a year
    seconds = F.when(number.isNotNull() & ~F.isnan(number), scale_epoch(number)).otherwise(instant)
    return F.coalesce(seconds, F.lit(0.0)) if compat else seconds


def ntz_micros(column: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
