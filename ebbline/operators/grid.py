"""Expected slots, gaps, islands and segments of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.time import day_of


def by_symbol(ts: str = "open_time"):
    return Window.partitionBy("symbol").orderBy(ts)


def expected(bars: DataFrame, step: int) -> DataFrame:
    """Every slot between each symbol's first and last bar."""
    ends = bars.groupBy("symbol").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    return ends.select("symbol", F.explode(F.sequence("first", "last", F.lit(step))).alias("open_time"))


def missing_slots(bars: DataFrame, step: int) -> DataFrame:
    return expected(bars, step).join(bars.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")


def gaps(bars: DataFrame, step: int, most: int = 3) -> DataFrame:
    """Runs of missing slots: the first and last missing one, their number, and whether they block."""
    ahead = bars.select("symbol", "open_time", F.lead("open_time").over(by_symbol()).alias("after"))
    found = ahead.filter(F.col("after") - F.col("open_time") > step)
    n = F.floor((F.col("after") - F.col("open_time")) / step).cast("long") - 1
    return found.select("symbol", (F.col("open_time") + step).alias("gap_start"), (F.col("after") - step).alias("gap_end"), n.alias("missing"), (n > most).alias("blocks"))


def grid_report(bars: DataFrame, step: int) -> DataFrame:
    """Per symbol: expected, observed, duplicate, off-grid and missing slots, and the longest gap."""
    seen = bars.groupBy("symbol", "open_time").agg(F.count("*").alias("n"))
    ahead = seen.withColumn("after", F.lead("open_time").over(by_symbol()))
    slots = lambda a, b: F.floor((F.col(a) - F.col(b)) / step).cast("long")
    ends = ahead.groupBy("symbol").agg(
        F.min("open_time").alias("lo"),
        F.max("open_time").alias("hi"),
        F.count_if(F.pmod("open_time", F.lit(step)) == 0).alias("observed"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(F.pmod("open_time", F.lit(step)) != 0).alias("off_grid"),
        F.coalesce(F.max(slots("after", "open_time") - 1), F.lit(0)).alias("longest_gap"),
    )
    wanted = slots("hi", "lo") + 1
    return ends.select("symbol", wanted.alias("expected"), "observed", "duplicates", "off_grid", (wanted - F.col("observed")).alias("missing"), "longest_gap", F.round(F.col("observed") / wanted, 6).alias("completeness"))


def segments(bars: DataFrame, step: int) -> DataFrame:
    """Bars with segment_id (rises at each gap) and bars_since_segment_start (from 1)."""
    jump = F.coalesce(F.col("open_time") - F.lag("open_time").over(by_symbol()) != step, F.lit(False))
    numbered = bars.withColumn("segment_id", F.sum(jump.cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("bars_since_segment_start", F.row_number().over(Window.partitionBy("symbol", "segment_id").orderBy("open_time")))


def tagged_islands(slots: DataFrame, step: int, tag: str) -> DataFrame:
    """Neighbouring slots of the same tag as records: symbol, tag, start, end, slots."""
    n = F.row_number().over(Window.partitionBy("symbol", tag).orderBy("open_time"))
    return slots.withColumn("island", F.col("open_time") - n * step).groupBy("symbol", tag, "island").agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"), F.count("*").alias("slots")).drop("island")


def rows_by_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(day_of(F.col(ts)).alias("day")).agg(F.count("*").alias("n"))


def missing_days(rows: DataFrame, ts: str, key: str = "symbol") -> DataFrame:
    """Calendar days within each key's range that have no row."""
    days = rows.select(key, F.to_date(F.timestamp_millis(F.col(ts))).alias("d")).distinct()
    ends = days.groupBy(key).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    every = ends.select(key, F.explode(F.sequence("a", "b")).alias("d"))
    return every.join(days, [key, "d"], "left_anti").select(key, F.date_format("d", "yyyy-MM-dd").alias("day"))


def day_mask(bars: DataFrame, step: int, day: int = 86_400_000) -> DataFrame:
    """Per symbol and day: slots and whether the day is complete, partial at the end of the series, or incomplete."""
    last = bars.groupBy("symbol").agg(F.max("open_time").alias("last"))
    counts = bars.groupBy("symbol", (F.col("open_time") - F.pmod("open_time", F.lit(day))).alias("day_ms")).agg(F.count_distinct("open_time").alias("slots"))
    state = F.when(F.col("slots") == day // step, "complete").when(F.col("last") < F.col("day_ms") + day, "lifecycle_partial").otherwise("incomplete")
    return counts.join(last, "symbol").select("symbol", "day_ms", "slots", state.alias("state"))


def research_start(months: DataFrame, least: int = 6) -> DataFrame:
    """The month after the first run of enough consecutive qualifying months. months: symbol, month_index, qualifies."""
    runs = months.filter("qualifies").withColumn("run", F.col("month_index") - F.row_number().over(Window.partitionBy("symbol").orderBy("month_index")))
    found = runs.groupBy("symbol", "run").agg(F.min("month_index").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return found.groupBy("symbol").agg((F.min("first") + least).alias("start_month_index"))


def merged_months(members: DataFrame) -> DataFrame:
    """Consecutive months of a member as half-open validity intervals. members: symbol, month_index."""
    runs = members.select("symbol", "month_index").distinct().withColumn("run", F.col("month_index") - F.row_number().over(Window.partitionBy("symbol").orderBy("month_index")))
    return runs.groupBy("symbol", "run").agg(F.min("month_index").alias("from_month"), (F.max("month_index") + 1).alias("to_month")).drop("run")
