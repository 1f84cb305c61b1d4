"""Row rules of bars as boolean columns and arrays of named errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def legal(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Finite positive prices with high and low at the ends."""
    o, h, low_, c = (F.col(x).cast("double") for x in (open_, high, low, close))
    finite = [x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")) for x in (o, h, low_, c)]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (h >= F.greatest(o, c, low_)) & (low_ <= F.least(o, c, h)), F.lit(False))


def errors(step: int, open_time: str = "open_time", volume: str = "volume", close_time: str | None = None) -> Column:
    """Names of the rules that a bar breaks, in a fixed order."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ts = F.col(open_time)
    rules = [
        ("off_grid", F.pmod(ts, F.lit(step)) != 0),
        ("non_positive_price", F.least(o, h, low, c) <= 0),
        ("high_below", h < F.greatest(o, c, low)),
        ("low_above", low > F.least(o, c, h)),
        ("negative_volume", F.col(volume) < 0),
    ]
    if close_time:
        rules.append(("close_time", F.col(close_time) != ts + step - 1))
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules)))


def ends_early(step: int) -> Column:
    """Whether a bar was closed before its interval ended, whatever its prices are."""
    return (F.col("close_time") >= F.col("open_time")) & (F.col("close_time") < F.col("open_time") + step - 1)


def closes_early(step: int) -> Column:
    """A bar that is otherwise legal but was closed before its interval ended."""
    return legal() & ends_early(step)


def amplitude() -> Column:
    return (F.col("high") - F.col("low")) / F.greatest(F.abs(F.col("open")), F.lit(1e-18))


def anomaly_flags(most: float = 0.30) -> Column:
    return F.array_compact(F.array(F.when(amplitude() > most, F.lit("amplitude")), F.when(F.col("volume") == 0, F.lit("zero_volume"))))
