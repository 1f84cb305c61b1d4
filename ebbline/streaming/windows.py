"""The batch operators on streams: bars, sessions and deduplication by event time.

Rows: symbol, ts (timestamp), id, price. What comes later than the watermark is dropped, as missing data is never
filled afterwards in batch runs. For complete windows batch and stream agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def bars(ticks: DataFrame, step: str = "1 hour", late: str = LATE) -> DataFrame:
    """Bars of closed windows: symbol, open_time, OHLC, volume, trades."""
    order = F.struct("ts", "id")
    made = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", step)).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.round(F.sum("price"), 6).alias("volume"),
        F.count("*").alias("trades"),
    )
    return made.select("symbol", F.unix_millis("window.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")


def episodes(events: DataFrame, gap: str = "1 hour", late: str = LATE) -> DataFrame:
    """Sessions of events no further apart than the gap."""
    made = events.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return made.select("symbol", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "events")


def unique(events: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def of_members(events: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a month's members. members: month (yyyy-MM), symbol; a table, not a stream."""
    return events.withColumn("month", F.date_format("ts", "yyyy-MM")).join(members, ["month", "symbol"], "left_semi")
