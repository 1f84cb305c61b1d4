"""Bars from ticks and bars from bars. A bucket is complete only if every child slot is there: no partial bar is emitted as complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.time import bucket


def bars_from_ticks(ticks: DataFrame, step: int) -> DataFrame:
    """symbol, open_time, OHLC, volume and trades; partial aggregation runs before the shuffle."""
    order = F.struct("ts_ms", "id")
    return ticks.groupBy("symbol", bucket(F.col("ts_ms"), step).alias("open_time")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.round(F.sum("price"), 6).alias("volume"),
        F.count("*").alias("trades"),
    )


def aggregate_bars(bars: DataFrame, child: int, target: int) -> DataFrame:
    """Larger bars with the number of child slots and whether all of them are there."""
    slots = target // child
    return (
        bars.groupBy("symbol", bucket(F.col("open_time"), target).alias("open_time"))
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.round(F.sum("volume"), 4).alias("volume"),
            F.sum("trades").alias("trades"),
            F.count_distinct("open_time").alias("slots"),
        )
        .withColumn("complete", F.col("slots") == slots)
    )


def complete_only(bars: DataFrame, child: int, target: int) -> DataFrame:
    return aggregate_bars(bars, child, target).filter("complete").drop("complete")


def eligible_candles(bars: DataFrame, slots: DataFrame, child: int, target: int) -> DataFrame:
    """Complete larger bars all of whose slots are eligible. slots: symbol, open_time, eligible; a bar without authority makes its bucket ineligible."""
    tagged = bars.join(slots, ["symbol", "open_time"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    allowed = tagged.groupBy("symbol", bucket(F.col("open_time"), target).alias("open_time")).agg(F.bool_and("eligible").alias("eligible"))
    return complete_only(bars, child, target).join(allowed.filter("eligible").drop("eligible"), ["symbol", "open_time"])


def with_empty_buckets(bars: DataFrame, target: int) -> DataFrame:
    """Every bucket of each symbol's range: those without any child have 0 slots."""
    ranges = bars.groupBy("symbol").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    grid = ranges.select("symbol", F.explode(F.sequence("first", "last", F.lit(target))).alias("open_time"))
    return grid.join(bars, ["symbol", "open_time"], "left").withColumn("slots", F.coalesce("slots", F.lit(0))).withColumn("complete", F.coalesce("complete", F.lit(False)))


def daily_prices(ticks: DataFrame, day: int = 86_400_000) -> DataFrame:
    """First and last price of each day."""
    order = F.struct("ts_ms", "id")
    return ticks.groupBy("symbol", bucket(F.col("ts_ms"), day).alias("day_ms")).agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))
