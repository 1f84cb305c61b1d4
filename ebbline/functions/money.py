"""Costs, funding and sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cost per side of each scenario.
COST_SCENARIOS = {"base": 0.0015, "cost_x2": 0.0030, "stress": 0.0040, "severe": 0.0055}


def annualised(rate: Column, hours: Column) -> Column:
    """Funding rate per year; null for an interval that isn't positive."""
    return F.when(hours > 0, rate * 8760.0 / hours)


def round_trip(spot_fee: float, futures_fee: float, slippage: float) -> float:
    return 2 * spot_fee + 2 * futures_fee + 4 * slippage


def payback_ratio(annual_rate: Column, hold_days: Column, cost: Column) -> Column:
    """Funding earned over a holding time against the round trip's cost; infinite without cost."""
    income = annual_rate * hold_days / 365.0
    return F.when(cost == 0, F.lit(float("inf"))).otherwise(F.try_divide(income, cost))


def net_return(entry: Column, exit_: Column, cost: Column) -> Column:
    return F.try_divide(exit_ * (1 - cost), entry * (1 + cost)) - 1


def position_size(equity: Column, cash: Column, price: Column, atr: Column, vol: Column, risk: float = 0.01, multiple: float = 2.0, target: float = 0.2, cost: float = 0.0015, factor: float = 1.0) -> Column:
    """The least of the risk, volatility and cash quantities, never below 0."""
    by_risk = F.try_divide(equity * risk, multiple * atr)
    by_vol = F.try_divide(equity * target, vol * price)
    by_cash = F.try_divide(cash, price * (1 + cost))
    return F.greatest(F.lit(0.0), F.coalesce(F.least(by_risk, by_vol, by_cash), F.lit(0.0)) * factor)


def trade_multiplier(open_fee: Column, close_fee: Column, open_slip: Column, close_slip: Column) -> Column:
    """What is left of a trade's value after fees and slippage on both sides."""
    return (1 - close_fee - close_slip) / (1 + open_fee + open_slip)
