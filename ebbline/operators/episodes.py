"""Clusters of events and occupied intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def connected(events: DataFrame, gap: int, ts: str = "ts_ms", key: str | None = "symbol", span: int = 86_400_000) -> DataFrame:
    """Episodes: a new one starts only more than gap after the previous event, so chains stay together. One row each: first, last, events, first_id.

    Events are chained inside bins of the span. What goes from bin to bin is one row a bin: whether its first event goes on with the episode that was open before, and which one that is."""
    parts = [key] if key else []
    rows = events.withColumn("__bin", F.floor(F.col(ts) / span))
    w = Window.partitionBy(*parts, "__bin").orderBy(ts, "id")
    breaks = F.coalesce(F.col(ts) - F.lag(ts).over(w) > gap, F.lit(False)).cast("int")
    numbered = rows.withColumn("__break", breaks).withColumn("__n", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*parts, "__bin", "__n").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events"), F.min(F.struct(ts, "id")).alias("start"))
    bins = pieces.groupBy(*parts, "__bin").agg(F.min("first").alias("__first"), F.max("last").alias("__last"), F.max("__n").alias("__k"))
    in_order = Window.partitionBy(*parts).orderBy("__bin")
    bins = bins.withColumn("__fresh", F.coalesce(F.col("__first") - F.lag("__last").over(in_order) > gap, F.lit(True)))
    bins = bins.withColumn("__open", F.when(F.col("__fresh") | (F.col("__k") > 0), F.struct(F.col("__bin").alias("bin"), F.col("__k").alias("n"))))
    bins = bins.withColumn("__before", F.last("__open", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.struct(F.col("__bin").alias("bin"), F.col("__n").alias("n"))
    named = pieces.join(bins.select(*parts, "__bin", "__fresh", "__before"), [*parts, "__bin"])
    named = named.withColumn("__episode", F.when((F.col("__n") > 0) | F.col("__fresh"), own).otherwise(F.col("__before")))
    out = named.groupBy(*parts, "__episode").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.min("start").alias("start"))
    return out.select(*parts, "first", "last", "events", F.col("start.id").alias("first_id"))


def sessions(events: DataFrame, gap: int, ts: str = "ts_ms") -> DataFrame:
    """The same by session windows; it also runs on streams. A session ends gap after its last event, which is still inside."""
    stamped = events.withColumn("t", F.timestamp_millis(F.col(ts)))
    found = stamped.groupBy("symbol", F.session_window("t", f"{gap + 1} milliseconds").alias("s")).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return found.select("symbol", "first", "last", "events")


def spaced(events: DataFrame, gap: int, ts: str = "ts_ms") -> DataFrame:
    """Greedy spacing: an event counts only more than gap after the last one that counted. A task goes through a symbol's sorted times batch by batch and holds only the last that counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, last = object(), None
        for batch in batches:
            kept = []
            for name, group in batch.groupby("symbol", sort=False, dropna=False):
                same = name == symbol or (name != name and symbol is None)
                times, symbol = group[ts].to_numpy(), None if name != name else name
                last = last if same else None
                at = 0 if last is None else int(np.searchsorted(times, last + gap, side="right"))
                while at < len(times):
                    last = int(times[at])
                    kept.append((symbol, last))
                    at = int(np.searchsorted(times, last + gap, side="right"))
            yield pd.DataFrame(kept, columns=["symbol", ts])

    ordered = events.select("symbol", ts).repartition("symbol").sortWithinPartitions("symbol", ts)
    return ordered.mapInPandas(run, ordered.schema)


def merged(intervals: DataFrame, start: str = "open_ms", end: str = "close_ms", key: str = "pair") -> DataFrame:
    """Unions of overlapping intervals, key by key."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) > reach, F.lit(True))
    numbered = intervals.withColumn("__new", new.cast("int")).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "block").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("intervals")).drop("block")


def occupancy(intervals: DataFrame, start: str = "open_ms", end: str = "close_ms", key: str = "pair") -> DataFrame:
    """Per key: occupied time, number of blocks and the longest gap between them."""
    blocks = merged(intervals, start, end, key)
    gap = F.lead("start").over(Window.partitionBy(key).orderBy("start")) - F.col("end")
    return blocks.withColumn("gap", gap).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("occupied"), F.count("*").alias("blocks"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def sleep_periods(intervals: DataFrame, start: str = "open_ms", end: str = "close_ms", key: str = "pair") -> DataFrame:
    """The gaps between occupied blocks."""
    blocks = merged(intervals, start, end, key)
    return blocks.withColumn("wakes", F.lead("start").over(Window.partitionBy(key).orderBy("start"))).filter(F.col("wakes") > F.col("end")).select(key, F.col("end").alias("sleeps"), "wakes", (F.col("wakes") - F.col("end")).alias("duration"))


def concurrency(intervals: DataFrame, start: str = "open_ms", end: str = "close_ms", key: str = "pair") -> DataFrame:
    """Most intervals open at once; one that ends makes room before another starts."""
    ticks = intervals.select(key, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(key, F.col(end).alias("t"), F.lit(-1).alias("d")))
    net = ticks.groupBy(key, "t").agg(F.sum(F.when(F.col("d") < 0, F.col("d"))).alias("closes"), F.sum(F.when(F.col("d") > 0, F.col("d"))).alias("opens"))
    net = net.select(key, "t", (F.coalesce("closes", F.lit(0)) + F.coalesce("opens", F.lit(0))).alias("net"))
    open_now = F.sum("net").over(Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return net.withColumn("open_now", open_now).groupBy(key).agg(F.max("open_now").alias("most"))
