"""Technical indicators. Frames where a window can express them; recursive ones fold a symbol's bars in order with numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.operators.rolling import full, sma


def _w(ts: str = "open_time"):
    return Window.partitionBy("symbol").orderBy(ts)


def bollinger(value: Column, n: int, width: float, ts: str = "open_time", deviation=F.stddev_pop) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band, with the population deviation unless another one is given."""
    middle = sma(value, n, ts)
    spread = full(value, deviation, -(n - 1), 0, ts) * width
    return middle - spread, middle, middle + spread


def crossed_above(a: Column, b: Column, ts: str = "open_time") -> Column:
    w = _w(ts)
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def crossed_below(a: Column, b: Column, ts: str = "open_time") -> Column:
    return crossed_above(b, a, ts)


def channel(n: int, ts: str = "open_time") -> tuple[Column, Column]:
    """Highest high and lowest low with the current bar."""
    return full(F.col("high"), F.max, -(n - 1), 0, ts), full(F.col("low"), F.min, -(n - 1), 0, ts)


def channel_place(n: int, ts: str = "open_time") -> Column:
    high, low = channel(n, ts)
    return F.try_divide(F.col("close") - low, high - low)


def keltner_width(n: int, ts: str = "open_time") -> Column:
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    mean = lambda x: sma(x, n, ts)
    return F.try_divide(mean((4 * h - 2 * low + c) / 3) - mean((-2 * h + 4 * low + c) / 3), mean((h + low + c) / 3)) * 100


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def with_stochastic(bars: DataFrame, n: int, smooth: int, fast: str, slow: str, ts: str = "open_time") -> DataFrame:
    """Place of the close in the channel of n bars, 0 where that is flat, as fast, and its mean over smooth bars as slow."""
    high, low = channel(n, ts)
    made = bars.withColumn(fast, F.when(high == low, 0.0).otherwise(100 * (F.col("close") - low) / (high - low)))
    return made.withColumn(slow, sma(F.col(fast), smooth, ts))


def hammer(ts: str = "open_time") -> Column:
    """A small body at the last bar's low, hardly a shadow above it and one longer than the body below; "small" and "near" are shares of means over earlier bars."""
    body, reach = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    low_before = F.lag("low").over(_w(ts)) + 0.2 * full(reach, F.avg, -6, -2, ts)
    return (body < full(body, F.avg, -10, -1, ts)) & (bottom - F.col("low") > body) & (F.col("high") - top < 0.1 * full(reach, F.avg, -10, -1, ts)) & (bottom <= low_before)


def money_flow(n: int, ts: str = "open_time") -> Column:
    """Money flow index of typical prices."""
    price = typical()
    before = F.lag(price).over(_w(ts))
    flow = price * F.col("volume")
    frame = _w(ts).rowsBetween(-(n - 1), 0)
    up, down = F.sum(F.when(price > before, flow).otherwise(0.0)).over(frame), F.sum(F.when(price < before, flow).otherwise(0.0)).over(frame)
    return F.when(F.row_number().over(_w(ts)) > n, F.when(up + down == 0, 50.0).otherwise(100 * up / F.greatest(up + down, F.lit(1e-300))))


def commodity_channel(n: int, ts: str = "open_time") -> Column:
    """(typical - mean) / (0.015 mean absolute deviation)."""
    frame = _w(ts).rowsBetween(-(n - 1), 0)
    values = F.collect_list(typical()).over(frame)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    off = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return F.when(F.size(values) == n, F.try_divide(typical() - mean, 0.015 * off))


def inverse_fisher(rsi: Column) -> Column:
    x = 0.1 * (rsi - 50)
    return (F.exp(2 * x) - 1) / (F.exp(2 * x) + 1)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the first value."""
    out = np.empty(len(x))
    a = 2 / (n + 1)
    last = np.nan
    for i, v in enumerate(x):
        last = v if i == 0 else a * v + (1 - a) * last
        out[i] = last
    return out


def seeded_ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the plain mean of the first n values; leading gaps in x are passed over."""
    out = np.full(len(x), np.nan)
    known = x[~np.isnan(x)]
    if len(known) >= n:
        tail = np.concatenate([[known[:n].mean()], known[n:]])
        out[len(x) - len(tail) :] = ema(tail, n)
    return out


def tema(x: np.ndarray, n: int) -> np.ndarray:
    """Triple exponential mean, each level seeded."""
    one = seeded_ema(x, n)
    two = seeded_ema(one, n)
    return 3 * (one - two) + seeded_ema(two, n)


def macd(close: np.ndarray, fast: int, slow: int) -> np.ndarray:
    """Difference of two seeded means that start at the same bar."""
    late = max(slow - fast, 0)
    head = np.full(min(late, len(close)), np.nan)
    return np.concatenate([head, seeded_ema(close[late:], fast)]) - seeded_ema(close, slow)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: the plain mean of the first n values, then a n-th of each new one."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        last = x[:n].mean()
        out[n - 1] = last
        for i in range(n, len(x)):
            last = (last * (n - 1) + x[i]) / n
            out[i] = last
    return out


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    move = np.diff(close)
    up, down = wilder(np.maximum(move, 0), n), wilder(np.maximum(-move, 0), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(up + down == 0, 50.0, 100 * up / (up + down))
    return np.concatenate([[np.nan], np.where(np.isnan(up), np.nan, value)]) if len(close) else close


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX."""
    if len(high) < 2:
        return (np.full(len(high), np.nan),) * 3
    up, down = np.diff(high), -np.diff(low)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    range_ = wilder(tr, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        p, m = 100 * wilder(plus, n) / range_, 100 * wilder(minus, n) / range_
        dx = np.where(p + m == 0, 0.0, 100 * abs(p - m) / (p + m))
    adx = np.full(len(dx), np.nan)
    if (~np.isnan(dx)).any():
        first = int(np.flatnonzero(~np.isnan(dx))[0])
        adx[first:] = wilder(dx[first:], n)
    pad = lambda x: np.concatenate([[np.nan], x])
    return pad(p), pad(m), pad(adx)


def parabolic(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse."""
    n = len(high)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    rising = high[1] - high[0] >= low[0] - low[1]
    extreme, stop, speed = (high[0], low[0], step) if rising else (low[0], high[0], step)
    for i in range(1, n):
        stop = stop + speed * (extreme - stop)
        if rising:
            stop = min(stop, low[i - 1], low[max(0, i - 2)])
            if low[i] < stop:
                rising, stop, extreme, speed = False, max(extreme, high[i]), low[i], step
            elif high[i] > extreme:
                extreme, speed = high[i], min(speed + step, most)
        else:
            stop = max(stop, high[i - 1], high[max(0, i - 2)])
            if high[i] > stop:
                rising, stop, extreme, speed = True, min(extreme, low[i]), high[i], step
            elif low[i] < extreme:
                extreme, speed = low[i], min(speed + step, most)
        out[i] = stop
    return out


@dataclass
class _Trail:
    """One side of a trend: a band that only tightens as long as closes stay on its side, and starts anew once one doesn't."""

    side: int  # 1: below the price, -1: above it
    level: float = 0.0

    def follow(self, band: float, last_close: float) -> float:
        broken = self.side * (last_close - self.level) < 0
        self.level = band if broken else max(self.side * band, self.side * self.level) * self.side
        return self.level


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int, multiple: float) -> tuple[np.ndarray, np.ndarray]:
    """Trailing band and direction (1 up, -1 down); both are 0 before the range has its n bars.

    Two trails follow the price at a multiple of the mean true range, one below and one above. A trend lasts until a
    close is beyond its own trail; the first one is up if it starts above the upper trail."""
    last = np.concatenate([close[:1], close[:-1]])
    reach = np.maximum.reduce([high - low, abs(high - last), abs(low - last)])
    width = multiple * pd.Series(reach).rolling(n).mean().to_numpy()
    middle = (high + low) / 2
    under, over = _Trail(1), _Trail(-1)
    band, way = np.zeros(len(close)), np.zeros(len(close), dtype=int)
    trend = -1
    for i in range(n, len(close)):
        trails = {1: under.follow(middle[i] - width[i], last[i]), -1: over.follow(middle[i] + width[i], last[i])}
        if trend * (trails[trend] - close[i]) > 0:
            trend = -trend
        band[i], way[i] = trails[trend], trend
    return band, way


def heikin_ashi(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed open and close."""
    c = (open_ + high + low + close) / 4
    o = np.empty(len(c))
    for i in range(len(c)):
        o[i] = (open_[0] + close[0]) / 2 if i == 0 else (o[i - 1] + c[i - 1]) / 2
    return o, c


def per_symbol(bars: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], ts: str = "open_time", carry: bool = False) -> DataFrame:
    """Columns that need a whole symbol in order, one Arrow batch for each symbol; carry keeps the bars' own columns beside them."""
    values = ["open", "high", "low", "close", "volume"]
    keep = ["symbol", ts] + (values if carry else [])
    schema = f"symbol string, {ts} long, " + ", ".join(f"{c} double" for c in keep[2:] + list(columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        return pd.concat([pdf[keep], pd.DataFrame({c: f(pdf) for c, f in columns.items()})], axis=1)

    return bars.select("symbol", ts, *values).groupBy("symbol").applyInPandas(run, schema)
