"""Epoch-millisecond arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bar intervals and their milliseconds.
STEPS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "12h": 43_200_000, "1d": 86_400_000, "1w": 604_800_000}


def interval_to_ms(interval: str) -> int:
    if interval not in STEPS:
        raise ValueError(f"unsupported interval: {interval}")
    return STEPS[interval]


def bucket(ts: Column, step: int) -> Column:
    """Start of the step that holds ts."""
    return ts - F.pmod(ts, F.lit(step))


def next_slot(ts: Column, step: int) -> Column:
    """The first boundary strictly after ts."""
    return bucket(ts, step) + step


def day_of(ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")


def month_of(ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM")


def month_start(ts: Column) -> Column:
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(ts)))


def next_month(ts: Column) -> Column:
    return F.unix_millis(F.add_months(F.date_trunc("month", F.timestamp_millis(ts)), 1).cast("timestamp"))


def from_archive(value: Column, micros_from: int = 10**15) -> Column:
    """Archive times in milliseconds or, from a threshold on, microseconds, as milliseconds."""
    number = value.cast("long")
    return F.when(number >= micros_from, F.floor(number / 1000).cast("long")).otherwise(number)


def snapped_hours(delta_ms: Column, within: float = 0.0167) -> Column:
    """Hours, snapped to a whole number when close to it."""
    hours = delta_ms / 3_600_000.0
    return F.when(F.abs(hours - F.round(hours)) <= within, F.round(hours)).otherwise(hours)
