"""As-of, next-slot and interval joins without range cross products.

Backward and forward as-of joins tag and union both sides and carry the last (or next) value along one window, so a
key's rows are sorted once. A hot key is spread: rows are dealt to (key, time bucket), and what each bucket needs from
its neighbours is one carried row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.time import bucket


def backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, span: int = 86_400_000) -> DataFrame:
    """left with, from the last right row of the key at or before left_ts: as_of_ts and as_of_<value>. right has one row for each key and time.

    Each (key, span) bucket is its own window partition; a bucket without an earlier row of its own takes the last one
    of the buckets before it, of which there is one candidate per bucket."""
    pair = F.struct(F.col(right_ts).alias("t"), F.col(value).alias("v"))
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("k"), F.col(left_ts).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.select(pair).schema[0].dataType).alias("hit"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_ts).alias("t"), F.lit(0).alias("side"), pair.alias("hit"))
    rows = a.unionByName(b).withColumn("bin", bucket(F.col("t"), span))
    inside = Window.partitionBy("k", "bin").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("near", F.last("hit", ignorenulls=True).over(inside))
    bins = rows.groupBy("k", "bin").agg(F.max("hit").alias("latest"))
    earlier = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("k", "bin", F.last("latest", ignorenulls=True).over(earlier).alias("before"))
    found = local.filter("side = 1").join(carried, ["k", "bin"])
    hit = F.coalesce("near", "before")
    return found.select("row.*", hit["t"].alias("as_of_ts"), hit["v"].alias(f"as_of_{value}"))


def forward_common(signals: DataFrame, first: DataFrame, second: DataFrame, ts: str = "ts_ms", open_time: str = "open_time", span: int = 86_400_000) -> DataFrame:
    """Each signal with the first open strictly after it that both series have. Buckets and what they carry are as in ``backward``, the other way."""
    common = first.select("symbol", open_time).join(second.select("symbol", open_time), ["symbol", open_time])
    a = signals.select("symbol", F.col(ts).alias("t"), F.col("id"), F.lit(None).cast("long").alias("open"), F.lit(1).alias("side"))
    b = common.select("symbol", F.col(open_time).alias("t"), F.lit(None).cast("long").alias("id"), F.col(open_time).alias("open"), F.lit(0).alias("side"))
    rows = a.unionByName(b).withColumn("bin", bucket(F.col("t"), span))
    # from the last row to the first: Spark goes through such a window once, but through one that ends at its last row once for each row
    inside = Window.partitionBy("symbol", "bin").orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("near", F.last("open", ignorenulls=True).over(inside)).filter("side = 1")
    bins = rows.groupBy("symbol", "bin").agg(F.min("open").alias("earliest"))
    later = Window.partitionBy("symbol").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("symbol", "bin", F.last("earliest", ignorenulls=True).over(later).alias("after"))
    return local.join(carried, ["symbol", "bin"]).select("symbol", "id", F.col("t").alias(ts), F.coalesce("near", "after").alias("next_open"))


def next_slot(events: DataFrame, bars: DataFrame, step: int, ts: str = "ts_ms") -> DataFrame:
    """Each event with the bar of exactly the next slot; a missing bar stays missing, nothing is searched further on."""
    wanted = events.withColumn("open_time", bucket(F.col(ts), step) + step)
    return wanted.join(bars.select("symbol", "open_time", F.col("open").alias("reference_open")), ["symbol", "open_time"], "left")


def epoch_state(rows: DataFrame, epochs: DataFrame, ts: str = "day_ms") -> DataFrame:
    """State of each row against its symbol's availability epochs [start_ms, end_ms): not_yet, active, between or terminated. Epochs of a symbol don't overlap."""
    spans = epochs.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("spans"))
    joined = rows.join(spans, "symbol", "left")
    t = F.col(ts)
    inside = F.exists("spans", lambda s: (t >= s["start_ms"]) & (s["end_ms"].isNull() | (t < s["end_ms"])))
    state = F.when(F.col("spans").isNull(), "unknown").when(inside, "active").when(t < F.get("spans", F.lit(0))["start_ms"], "not_yet").when(F.exists("spans", lambda s: s["start_ms"] > t), "between").otherwise("terminated")
    return joined.withColumn("state", state).drop("spans")


def exclusions(rows: DataFrame, registry: DataFrame, ts: str = "day_ms") -> DataFrame:
    """Rows with the category of the closed exclusion [from_ms, to_ms] that holds them; more than one for a row raises."""
    spans = registry.groupBy("symbol").agg(F.collect_list(F.struct("from_ms", "to_ms", "category")).alias("spans"))
    t = F.col(ts)
    hits = F.filter(F.coalesce("spans", F.array().cast("array<struct<from_ms:bigint,to_ms:bigint,category:string>>")), lambda s: (t >= s["from_ms"]) & (s["to_ms"].isNull() | (t <= s["to_ms"])))
    one = F.when(F.size(hits) > 1, F.raise_error(F.lit("overlapping exclusions"))).otherwise(F.get(hits, F.lit(0))["category"])
    return rows.join(spans, "symbol", "left").withColumn("excluded_as", one.cast("string")).drop("spans")
