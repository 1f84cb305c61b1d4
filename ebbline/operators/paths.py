"""What happens after events: forward paths on exact slots, horizons, excursions, recovery and gates. A missing slot censors, it is never searched further on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(events: DataFrame, bars: DataFrame, step: int, slots: int, ts: str = "decision_ms") -> DataFrame:
    """Each event's path: slot 1..slots with the bar of exactly that slot, the entry at the open of the first one."""
    wanted = events.select("symbol", F.col(ts).alias("event_ms"), F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot")).withColumn("open_time", F.col("event_ms") + F.col("slot") * step)
    rows = wanted.join(bars.select("symbol", "open_time", "open", "high", "low", "close"), ["symbol", "open_time"])
    entries = events.select("symbol", F.col(ts).alias("event_ms"), (F.col(ts) + step).alias("open_time")).join(bars.select("symbol", "open_time", F.col("open").alias("entry")), ["symbol", "open_time"]).drop("open_time")
    return rows.join(entries, ["symbol", "event_ms"])


def observed(path: DataFrame, slots: int) -> DataFrame:
    """Per event: whether the path is complete, its excursions, and the first slot that is back at the entry."""
    rise = lambda c: F.col(c) / F.col("entry") - 1
    made = path.groupBy("symbol", "event_ms").agg(
        F.count("*").alias("seen"),
        F.max(rise("high")).alias("mfe"),
        F.min(rise("low")).alias("mae"),
        F.min(F.when(F.col("close") >= F.col("entry"), F.col("slot"))).alias("first_recovery"),
    )
    return made.withColumn("complete", F.col("seen") == slots).drop("seen")


def horizons(path: DataFrame, at: list[int], cost: float) -> DataFrame:
    """Gross and net return of each event at each horizon that its path reaches."""
    gross = F.col("close") / F.col("entry") - 1
    net = F.col("close") * (1 - cost) / (F.col("entry") * (1 + cost)) - 1
    return path.filter(F.col("slot").isin(at)).select("symbol", "event_ms", F.col("slot").alias("horizon"), gross.alias("gross"), net.alias("net"))


def horizon_summary(returns: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("gross", F.lit(p))
    return returns.groupBy("horizon").agg(
        F.count("*").alias("n"),
        F.avg("gross").alias("mean"),
        q(0.5).alias("median"),
        F.coalesce(F.stddev_samp("gross"), F.lit(0.0)).alias("deviation"),
        F.avg((F.col("gross") > 0).cast("double")).alias("win_rate"),
        q(0.05).alias("p5"),
        q(0.95).alias("p95"),
        F.min("gross").alias("worst"),
        F.avg("net").alias("net_mean"),
    )


def relative(events: DataFrame, bars: DataFrame, step: int, slots: int, ts: str = "decision_ms") -> DataFrame:
    """Candidate against the median of its peers, slot by slot, from the close at the event; slots at which the candidate or every peer is missing are left out."""
    base = bars.select("symbol", F.col("open_time").alias("event_ms"), F.col("close").alias("base"))
    wanted = events.select(F.col("symbol").alias("candidate"), F.col(ts).alias("event_ms"), F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    wanted = wanted.withColumn("open_time", F.col("event_ms") + F.col("slot") * step)
    rows = wanted.join(bars.select("symbol", "open_time", "close"), "open_time").join(base, ["symbol", "event_ms"])
    moved = rows.withColumn("moved", F.ln(F.col("close") / F.col("base")))
    own = F.max(F.when(F.col("symbol") == F.col("candidate"), F.col("moved")))
    peers = F.percentile(F.when(F.col("symbol") != F.col("candidate"), F.col("moved")), F.lit(0.5))
    out = moved.groupBy("candidate", "event_ms", "slot").agg(own.alias("own"), peers.alias("peers"))
    return out.filter("own IS NOT NULL AND peers IS NOT NULL").withColumn("relative", F.col("own") - F.col("peers"))


def gates(events: DataFrame, least_events: int, most_share: float, ts: str = "decision_ms") -> DataFrame:
    """One row of counts and pass or fail: enough events, and no year or symbol with too large a share."""
    month = F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM")
    total = events.agg(F.count("*").alias("events"), F.count_distinct("symbol").alias("symbols"), F.count_distinct(month).alias("months"))
    share = lambda c: events.groupBy(c).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"))
    by_symbol = share("symbol").withColumnRenamed("top", "top_symbol")
    by_month = events.withColumn("m", month).groupBy("m").agg(F.count("*").alias("n")).agg(F.max("n").alias("top_month"))
    row = total.join(F.broadcast(by_symbol)).join(F.broadcast(by_month))  # one row each
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("events")), F.lit(0.0))
    return row.select(
        "events",
        "symbols",
        "months",
        F.round(part("top_symbol"), 6).alias("symbol_share"),
        F.round(part("top_month"), 6).alias("month_share"),
        (F.col("events") >= least_events).alias("enough"),
        (part("top_symbol") <= most_share).alias("spread_symbols"),
        (part("top_month") <= most_share).alias("spread_months"),
    )


def sample_projection(observed: int, days: float, full_days: int, later_days: int, need_full: int = 120, need_later: int = 30) -> dict:
    """Events to expect in the full and the later span at the observed rate, and whether they are enough."""
    rate = observed / days if days > 0 else 0.0
    full, later = int(rate * full_days), int(rate * later_days)
    return {"rate": rate, "full": full, "later": later, "enough": full >= need_full and later >= need_later}
