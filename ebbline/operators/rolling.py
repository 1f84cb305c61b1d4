"""Rolling indicators. References exclude the current row where the rule says so, and nothing is given before a frame is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.operators.grid import by_symbol


def _order(ts: str):
    return Window.partitionBy("symbol").orderBy(ts)


def full(value: Column, agg, first: int, last: int, ts: str = "open_time") -> Column:
    """agg over rows first..last of a symbol, null unless the frame has all its rows."""
    frame = _order(ts).rowsBetween(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, agg(value).over(frame))


def sma(value: Column, n: int, ts: str = "open_time") -> Column:
    return full(value, F.avg, -(n - 1), 0, ts)


def donchian_high(n: int, ts: str = "open_time", high: str = "high") -> Column:
    """Highest high of the n bars before this one."""
    return full(F.col(high), F.max, -n, -1, ts)


def donchian_low(n: int, ts: str = "open_time", low: str = "low") -> Column:
    return full(F.col(low), F.min, -n, -1, ts)


def true_range(ts: str = "open_time") -> Column:
    before = F.lag("close").over(_order(ts))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def log_return(ts: str = "open_time", value: str = "close") -> Column:
    return F.ln(F.col(value) / F.lag(value).over(_order(ts)))


def trend_features(bars: DataFrame, slow: int, fast: int, entry: int, exit_: int, atr: int, ts: str = "open_time") -> DataFrame:
    """Bars with true range, moving averages, average true range, prior channel, volatility and the entry and exit conditions."""
    made = bars.withColumn("tr", true_range(ts)).withColumn("ret", log_return(ts))
    made = made.select(
        "*",
        sma(F.col("close"), slow, ts).alias("sma_slow"),
        sma(F.col("close"), fast, ts).alias("sma_fast"),
        donchian_high(entry, ts).alias("channel_high"),
        donchian_low(exit_, ts).alias("channel_low"),
        sma(F.col("tr"), atr, ts).alias("atr"),
        (full(F.col("ret"), F.stddev_pop, -(atr - 1), 0, ts) * F.sqrt(F.lit(365.0))).alias("volatility"),
    )
    enters = F.coalesce((F.col("close") > F.col("channel_high")) & (F.col("close") > F.col("sma_slow")), F.lit(False))
    exits = F.coalesce(F.col("close") < F.col("channel_low"), F.lit(False))
    return made.withColumn("enters", enters).withColumn("exits", exits)


def _in_span(points: DataFrame, value: Column, span: int, closed: bool, ts: str) -> DataFrame:
    """row (a point), total and n: sum and number of the values over (t - span, t] in milliseconds, or [t - span, t] if closed.

    Points are dealt to bins as long as the span. A frame is what its own bin has up to t, and what is left of the bin before: each point of
    that bin stands at the time at which it drops out, with what the later ones hold. Every window only grows, so a row costs the same
    however many rows its frame has; nothing is subtracted, and no task holds a symbol's whole history. Values are summed in two parts, of
    which multiples of 2^-20 add up without error, so that long frames lose no digits."""
    made = points.select("symbol", F.floor(F.col(ts) / span).alias("bin"), F.col(ts).alias("t"), F.struct(*points.columns).alias("row"), value.cast("double").alias("x")).withColumn("v", F.rint(F.col("x") * 2.0**20) / 2.0**20)
    made = made.withColumn("w", F.nanvl(F.col("x") - F.col("v"), F.lit(0.0))).drop("x")
    timed = made.filter("t IS NOT NULL")
    sums = lambda over: (over(F.sum("v")).alias("v"), over(F.sum("w")).alias("w"), over(F.count("v")).alias("n"))
    none = F.lit(None)
    later = Window.partitionBy("symbol", "bin").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = timed.select("symbol", "bin", "t", F.struct(*sums(lambda c: c.over(later))).alias("rest"))
    whole = timed.groupBy("symbol", "bin").agg(F.struct(*sums(lambda c: c)).alias("rest"))
    blank = lambda at, kind: ("symbol", (F.col("bin") + 1).alias("bin"), at.alias("t"), F.lit(kind).alias("kind"), none.cast(made.schema["row"].dataType).alias("row"), none.cast("double").alias("v"), none.cast("double").alias("w"), "rest")
    own = made.select("symbol", "bin", "t", F.lit(2).alias("kind"), "row", "v", "w", none.cast(after.schema["rest"].dataType).alias("rest"))
    events = own.unionByName(after.select(*blank(F.col("t") + (span + 1 if closed else span), 1))).unionByName(whole.select(*blank((F.col("bin") + 1) * span, 0)))
    key = Window.partitionBy("symbol", "bin")
    so_far = key.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    left = F.last("rest", ignorenulls=True).over(key.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = events.select("row", "kind", F.struct(*sums(lambda c: c.over(so_far))).alias("own"), left.alias("left")).filter("kind = 2")
    part = lambda c: F.coalesce(f"own.{c}", F.lit(0)) + F.coalesce(f"left.{c}", F.lit(0))
    return held.select("row", (part("v") + part("w")).alias("total"), part("n").alias("n"))


def with_mean_before(points: DataFrame, value: str, span: int, name: str, ts: str = "ts_ms") -> DataFrame:
    """points with the mean over (t - span, t] in milliseconds."""
    return _in_span(points, F.col(value), span, False, ts).select("row.*", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias(name))


def most_in_window(points: DataFrame, span: int, closed: bool, ts: str = "ts_ms", bin: int | None = None) -> DataFrame:
    """Largest number of events in a rolling window: half-open (an event exactly span ago is out) or closed.

    Events of one time are counted before the shuffle. A window's number is a running sum less the running sum of what has dropped out: both
    only grow, so no frame is gone through. They run inside bins (of four spans, if not given), which also get the times that can still be in
    a window when they begin; there a sum misses what is older, and the bin before has the whole number.
    Events without a time are a window of their own."""
    bin = bin or 4 * span
    times = points.groupBy("symbol", F.col(ts).alias("t")).agg(F.count("*").alias("n"))
    bins = F.sequence(F.floor(F.col("t") / bin), F.floor((F.col("t") + span) / bin))
    dealt = times.select("symbol", "t", "n", F.explode_outer(bins).alias("bin"))
    key = Window.partitionBy("symbol", "bin").orderBy("t")
    out = F.sum("n").over(key.rangeBetween(Window.unboundedPreceding, -(span + 1 if closed else span)))
    held = F.sum("n").over(key.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("t").isNotNull(), F.coalesce(out, F.lit(0))).otherwise(0)
    return dealt.select("symbol", held.alias("held")).groupBy("symbol").agg(F.max("held").alias("most"))


def prior_days_percentile(points: DataFrame, value: str, days: int, p: float, ts: str = "ts_ms", least_days: int | None = None) -> DataFrame:
    """Points with the percentile of the values of the previous complete days (their own day excluded), if all of those days have one.

    Values go to the days that they feed and are counted there by value before the shuffle; only days are put in order."""
    rows = points.withColumn("day", F.floor(F.col(ts) / 86_400_000).cast("long"))
    frame = Window.partitionBy("symbol").orderBy("day").rangeBetween(-days, -1)
    known = rows.select("symbol", "day").distinct().withColumn("have", F.count("*").over(frame)).filter(F.col("have") == (least_days or days))
    fed = rows.select("symbol", F.explode(F.sequence(F.col("day") + 1, F.col("day") + days)).alias("day"), value)
    cut = fed.groupBy("symbol", "day").agg(F.percentile(value, F.lit(p)).alias("threshold"))
    return rows.join(known.select("symbol", "day").join(cut, ["symbol", "day"]), ["symbol", "day"], "left")


def corwin_schultz(bars: DataFrame, step: int) -> DataFrame:
    """Two-bar high-low spread estimate of bars whose predecessor is exactly one step before."""
    w = by_symbol()
    lag = lambda c: F.lag(c).over(w)
    rows = bars.select("symbol", "open_time", "high", "low", lag("high").alias("h1"), lag("low").alias("l1"), lag("open_time").alias("t1")).filter(F.col("open_time") - F.col("t1") == step)
    square = lambda x: x * x
    # a low of zero has no error: its range is without bound, or without a value where the high is zero too, and the spread is then the largest
    ratio = lambda a, b: F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(a, b))
    beta = square(F.ln(ratio(F.col("h1"), F.col("l1")))) + square(F.ln(ratio(F.col("high"), F.col("low"))))
    gamma = square(F.ln(ratio(F.greatest("h1", "high"), F.least("l1", "low"))))
    d = 3 - 2 * F.sqrt(F.lit(2.0))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / d - F.sqrt(gamma / d)
    bounded = F.least(F.greatest(alpha, F.lit(0.0)), F.lit(50.0))
    return rows.select("symbol", "open_time", (2 * (F.exp(bounded) - 1) / (1 + F.exp(bounded))).alias("spread"))


def _median_before(value: str, first: int, last: int) -> Column:
    frame = by_symbol().rowsBetween(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, F.percentile(value, F.lit(0.5)).over(frame))


def panic_events(bars: DataFrame, window: int, fall: float, return_multiple: float, range_multiple: float, location: float) -> DataFrame:
    """Bars that fall far, beyond multiples of their prior median return and true range, and close near the low."""
    made = bars.withColumn("tr", true_range()).withColumn("ret", F.col("close") / F.lag("close").over(by_symbol()) - 1).withColumn("size", F.abs("ret"))
    made = made.withColumn("median_size", _median_before("size", -window, -1)).withColumn("median_tr", _median_before("tr", -window, -1))
    made = made.withColumn("location", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")))
    hit = (F.col("ret") <= -fall) & (F.col("size") >= return_multiple * F.col("median_size")) & (F.col("tr") >= range_multiple * F.col("median_tr")) & (F.col("location") <= location)
    return made.filter(F.coalesce(hit, F.lit(False)))


def compression_events(bars: DataFrame, span: int, history: int, quantile: float, range_multiple: float) -> DataFrame:
    """Breakouts above the prior high after a range that was narrow against its own history."""
    w = by_symbol()
    recent = lambda agg, c: full(F.col(c), agg, -(span - 1), 0)
    made = bars.withColumn("tr", true_range()).withColumn("score", (recent(F.max, "high") - recent(F.min, "low")) / sma(F.col("close"), span))
    made = made.withColumn("score_before", F.lag("score", 2).over(w))
    frame = w.rowsBetween(-(history - 1), 0)
    narrow = F.when(F.count("score_before").over(frame) == history, F.percentile("score_before", F.lit(quantile)).over(frame))
    made = made.withColumn("narrow", narrow).withColumn("last_score", F.lag("score").over(w)).withColumn("prior_high", donchian_high(span)).withColumn("median_tr", _median_before("tr", -span, -1))
    hit = (F.col("last_score") <= F.col("narrow")) & (F.col("close") > F.col("prior_high")) & (F.col("tr") >= range_multiple * F.col("median_tr"))
    return made.filter(F.coalesce(hit, F.lit(False)))
