"""Path-dependent strategies: what is decided at one bar fills at the next one's open, and the last bar fills nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def fold(bars: pd.DataFrame, ts: str, capital: float, risk: float, stop_multiple: float, cost: float) -> pd.DataFrame:
    """One symbol in order: flat or long, with a stop from the range at entry."""
    bars = bars.sort_values(ts, kind="stable").reset_index(drop=True)
    cash, quantity, stop, order = capital, 0.0, -np.inf, None
    rows = []
    for i, b in enumerate(bars.itertuples(index=False)):
        if order == "buy" and quantity == 0:
            size = max(0.0, min(capital * risk / (stop_multiple * before.atr), cash / (b.open * (1 + cost))))
            cash -= size * b.open * (1 + cost)
            quantity, stop = size, before.close - stop_multiple * before.atr
        elif order == "sell" and quantity > 0:
            cash += quantity * b.open * (1 - cost)
            quantity, stop = 0.0, -np.inf
        rows.append((b.symbol, getattr(b, ts), cash + quantity * b.close, quantity, order or "hold"))
        before, order = b, None
        if i + 1 < len(bars):
            if quantity == 0 and b.enters and b.atr == b.atr and b.atr > 0:
                order = "buy"
            elif quantity > 0 and (b.exits or b.close < stop):
                order = "sell"
    return pd.DataFrame(rows, columns=["symbol", ts, "equity", "quantity", "filled"])


def backtest(features: DataFrame, ts: str = "open_time", capital: float = 10_000.0, risk: float = 0.01, stop_multiple: float = 2.0, cost: float = 0.0015) -> DataFrame:
    """Equity of each symbol by bar; features come from ``rolling.trend_features``."""
    rows = features.select("symbol", ts, "open", "close", "atr", "enters", "exits")
    return rows.groupBy("symbol").applyInPandas(lambda pdf: fold(pdf, ts, capital, risk, stop_multiple, cost), f"symbol string, {ts} long, equity double, quantity double, filled string")


def policy_benchmark(panel: DataFrame, weights: dict[str, float], capital: float, cost: float) -> DataFrame:
    """Daily equity of fixed weights, restored at each Monday's open at the cost of what is turned over; the rest is cash."""
    symbols = sorted(weights)
    wide = panel.filter(F.col("symbol").isin(symbols)).groupBy("day_ms").agg(*(F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c}_{i}") for i, s in enumerate(symbols) for c in ("open", "close")))
    full = wide.filter(" AND ".join(f"open_{i} IS NOT NULL" for i in range(len(symbols)))).withColumn("portfolio", F.lit("policy"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_ms")
        cash, held, rows = capital, np.zeros(len(symbols)), []
        target = np.array([weights[s] for s in symbols])
        for i, r in enumerate(pdf.to_dict("records")):
            opens, closes = (np.array([r[f"{c}_{k}"] for k in range(len(symbols))]) for c in ("open", "close"))
            if i == 0 or (r["day_ms"] // DAY + 3) % 7 == 0:
                equity = cash + held @ opens
                wanted = equity * target / opens
                traded = np.abs(wanted - held) @ opens
                cash, held = equity - wanted @ opens - traded * cost, wanted
            rows.append((r["day_ms"], cash + held @ closes))
        return pd.DataFrame(rows, columns=["day_ms", "equity"])

    # a portfolio is one sequence of days, whatever the number of rows behind each day
    return full.groupBy("portfolio").applyInPandas(run, "day_ms long, equity double")


def reprice(events: DataFrame, bars: DataFrame, step: int, slots: int, target: float, stop: float, ts: str = "decision_ms") -> DataFrame:
    """Entry at the next open, then the first of stop (at the worse of open and stop; it wins ties), target, or timeout."""
    from ebbline.operators.paths import forward

    path = forward(events, bars, step, slots, ts)
    at_stop, at_target = F.col("entry") * (1 - stop), F.col("entry") * (1 + target)
    reason = F.when(F.col("low") <= at_stop, "stop").when(F.col("high") >= at_target, "target").when(F.col("slot") == slots, "timeout")
    price = F.when(F.col("reason") == "stop", F.least(F.col("open"), at_stop)).when(F.col("reason") == "target", at_target).otherwise(F.col("close"))
    hit = path.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("exit_price", price)
    first = hit.groupBy("symbol", "event_ms").agg(F.min_by(F.struct("slot", "reason", "entry", "exit_price"), "slot").alias("x"))
    return first.select("symbol", "event_ms", F.col("x.slot").cast("long").alias("slot"), "x.reason", "x.entry", "x.exit_price")
