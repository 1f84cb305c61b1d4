"""Equity curves, drawdowns and trade statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.stats import probabilistic_sharpe

DAY = 86_400_000


def daily_equity(trades: DataFrame, initial: float) -> DataFrame:
    """Realised equity by day over the whole calendar of each pair: pnl counts on the day on which a trade closes."""
    day = F.floor(F.col("close_ms") / DAY).cast("long")
    closed = trades.groupBy("pair", day.alias("day")).agg(F.sum("pnl").alias("pnl"))
    ends = trades.groupBy("pair").agg(F.floor(F.min("open_ms") / DAY).cast("long").alias("a"), F.floor(F.max("close_ms") / DAY).cast("long").alias("b"))
    calendar = ends.select("pair", F.explode(F.sequence("a", "b")).alias("day"))
    full = calendar.join(closed, ["pair", "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    return full.select("pair", "day", "pnl", (initial + F.sum("pnl").over(Window.partitionBy("pair").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


def marked_equity(trades: DataFrame, marks: DataFrame, initial: float) -> DataFrame:
    """Daily equity with open trades at their marks. marks: pair, day, close.

    A trade is open from its day to the day before its close. What open trades are worth is mark * units - stakes, so
    units and stakes are summed over openings and closings: no trade is dealt to its days."""
    day = lambda c: F.floor(F.col(c) / DAY).cast("long")
    held = trades.filter(day("close_ms") > day("open_ms"))
    side = lambda c, sign: held.select("pair", day(c).alias("day"), (sign * F.col("stake") / F.col("open_rate")).alias("units"), (sign * F.col("stake")).alias("stakes"), F.lit(sign).alias("trades"))
    moves = side("open_ms", 1).unionByName(side("close_ms", -1)).groupBy("pair", "day").agg(*(F.sum(c).alias(c) for c in ("units", "stakes", "trades")))
    so_far = Window.partitionBy("pair").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    made = daily_equity(trades, initial).join(moves, ["pair", "day"], "left").join(marks, ["pair", "day"], "left")
    made = made.select("pair", "day", "equity", "close", total("units").alias("units"), total("stakes").alias("stakes"), total("trades").alias("n"))
    marked = F.col("close").isNotNull()
    worth = F.when(marked, F.col("close") * F.col("units") - F.col("stakes")).otherwise(0.0)
    return made.select("pair", "day", (F.col("equity") + worth).alias("equity"), F.when(marked, F.col("n")).otherwise(0).alias("open_trades"))


def drawdowns(equity: DataFrame, key: str = "pair", ts: str = "day") -> DataFrame:
    """equity with the running peak and the drop from it."""
    peak = F.max("equity").over(Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(0.0))


def curve_metrics(equity: DataFrame, key: str = "pair", ts: str = "day", periods: float = 365.0) -> DataFrame:
    """Return, growth, volatility, Sharpe, Sortino, drawdown, Calmar and moments of each curve; degenerate figures are 0."""
    w = Window.partitionBy(key).orderBy(ts)
    made = drawdowns(equity, key, ts).withColumn("r", F.when(F.lag("equity").over(w) > 0, F.col("equity") / F.lag("equity").over(w) - 1))
    agg = made.groupBy(key).agg(
        F.min_by("equity", ts).alias("first"),
        F.max_by("equity", ts).alias("last"),
        F.count("r").alias("n"),
        F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("deviation"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least(F.col("r"), F.lit(0.0)), F.lit(2.0))))).alias("downside"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("r").alias("m1"),
        F.avg(F.col("r") * F.col("r")).alias("m2"),
        F.avg(F.pow("r", F.lit(3.0))).alias("m3"),
        F.avg(F.pow("r", F.lit(4.0))).alias("m4"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    growth = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 0), F.pow(F.col("last") / F.col("first"), periods / F.col("n")) - 1)
    variance = F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.pow("m1", F.lit(3.0))
    fourth = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.col("m1") * F.col("m1") * F.col("m2") - 3 * F.pow("m1", F.lit(4.0))
    spread = lambda top, power: zero(F.when(variance > 1e-18, top / F.pow(variance, F.lit(power))))
    return agg.select(
        key,
        "n",
        zero(F.try_divide("last", "first") - 1).alias("total_return"),
        zero(growth).alias("cagr"),
        zero(F.when(F.col("deviation") > 0, F.col("mean") / F.col("deviation") * periods**0.5)).alias("sharpe"),
        zero(F.when(F.col("downside") > 0, F.col("mean") / F.col("downside") * periods**0.5)).alias("sortino"),
        (-F.col("max_drawdown")).alias("max_drawdown"),
        zero(F.when(F.col("max_drawdown") < 0, growth / -F.col("max_drawdown"))).alias("calmar"),
        spread(third, 1.5).alias("skew"),
        spread(fourth, 2.0).alias("kurtosis"),
    )


def with_psr(metrics: DataFrame, key: str = "pair", periods: float = 365.0) -> DataFrame:
    """metrics with the probabilistic Sharpe ratio; the normal distribution runs in one vectorised function over a row per curve."""
    @F.pandas_udf("double")
    def psr(sharpe: pd.Series, n: pd.Series, skew: pd.Series, kurtosis: pd.Series) -> pd.Series:
        return pd.Series([probabilistic_sharpe(s / periods**0.5, int(k), a, b) for s, k, a, b in zip(sharpe, n, skew, kurtosis, strict=True)])

    return metrics.withColumn("psr", psr("sharpe", "n", "skew", "kurtosis"))


def trade_metrics(trades: DataFrame, key: str = "pair") -> DataFrame:
    """Number, win rate, gains and losses, profit factor (infinite without losses), mean and holding time."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    hold = (F.col("close_ms") - F.col("open_ms")) / DAY
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        gain.alias("gains"),
        loss.alias("losses"),
        F.when(loss > 0, gain / F.greatest(loss, F.lit(1e-300))).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.avg("pnl").alias("mean_pnl"),
        F.percentile(hold, F.lit(0.5)).alias("median_days"),
        F.percentile(hold, F.lit(0.95)).alias("p95_days"),
    )


def concentration(trades: DataFrame, key: str = "pair") -> DataFrame:
    """How much of the gains the three best trades have, and the Herfindahl index of gains."""
    won = trades.filter("pnl > 0").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("pnl").desc(), "trade_id")))
    total = F.sum("pnl")
    return won.groupBy(key).agg(total.alias("gains"), (F.sum(F.when(F.col("n") <= 3, F.col("pnl"))) / total).alias("top3"), (F.sum(F.col("pnl") * F.col("pnl")) / (total * total)).alias("hhi"))


def without_best(trades: DataFrame, n: int = 3, key: str = "pair") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("pnl").desc(), "trade_id")
    return trades.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") > n).drop("__n")


def losing_streak(trades: DataFrame, key: str = "pair") -> DataFrame:
    """Longest run of trades without a gain, in order of closing."""
    every = Window.partitionBy(key).orderBy("close_ms", "trade_id")
    lost = F.col("pnl") < 0
    runs = trades.withColumn("lost", lost).withColumn("run", F.row_number().over(every) - F.row_number().over(Window.partitionBy(key, "lost").orderBy("close_ms", "trade_id")))
    longest = runs.filter("lost").groupBy(key, "run").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n"))
    return trades.select(key).distinct().join(longest, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("losing_streak"))


def segment_returns(trades: DataFrame, initial: float, parts: int = 4, key: str = "pair") -> DataFrame:
    """Gain over equity in equal parts of each pair's span, by opening."""
    ends = trades.groupBy(key).agg(F.min("open_ms").alias("a"), F.max("open_ms").alias("b"))
    part = F.least(F.floor((F.col("open_ms") - F.col("a")) * parts / F.greatest(F.col("b") - F.col("a"), F.lit(1))), F.lit(parts - 1)).cast("int")
    return trades.join(ends, key).groupBy(key, part.alias("part")).agg((F.sum("pnl") / initial).alias("part_return"), F.count("*").alias("trades"))


def costs(trades: DataFrame, fee: float, slippage: float, key: str = "pair") -> DataFrame:
    exit_ = F.col("stake") * F.col("close_rate") / F.col("open_rate")
    return trades.groupBy(key).agg(F.sum((F.col("stake") + exit_) * fee).alias("fees"), F.sum((F.col("stake") + exit_) * slippage).alias("slippage"))


def combined(curves: DataFrame, key: str = "pair") -> DataFrame:
    """Mean of normalised curves over the days that all of them have."""
    first = curves.groupBy(key).agg(F.min_by("equity", "day").alias("first"))
    n = curves.select(key).distinct().agg(F.count("*").alias("all_curves"))
    rows = curves.join(first, key).withColumn("x", F.col("equity") / F.col("first"))
    return rows.groupBy("day").agg(F.avg("x").alias("equity"), F.count("*").alias("curves")).join(F.broadcast(n)).filter("curves = all_curves").select("day", "equity")  # one row
