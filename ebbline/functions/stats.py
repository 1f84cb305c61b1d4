"""Statistics as columns: aggregates from raw sums, and scores."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
EULER = 0.5772156649015329


def relative_difference(left: Column, right: Column) -> Column:
    return F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1e-18))


def safe_root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from raw sums; null without variance."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    vx, vy = F.avg(x * x) - F.avg(x) * F.avg(x), F.avg(y * y) - F.avg(y) * F.avg(y)
    return F.when((n > 1) & (vx > 1e-15) & (vy > 1e-15), F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))


def coskewness(x: Column, y: Column) -> Column:
    """E[(x - mx)(y - my)^2] / (sx sy^2)."""
    mx, my = F.avg(x), F.avg(y)
    top = F.avg(x * y * y) - mx * F.avg(y * y) - 2 * my * F.avg(x * y) + 2 * mx * my * my
    vx, vy = F.avg(x * x) - mx * mx, F.avg(y * y) - my * my
    return F.when((vx > 1e-15) & (vy > 1e-15), F.try_divide(top, safe_root(vx) * vy))


def cokurtosis(x: Column, y: Column) -> Column:
    """E[(x - mx)^2 (y - my)^2] / (sx^2 sy^2)."""
    mx, my = F.avg(x), F.avg(y)
    top = (
        F.avg(x * x * y * y)
        - 2 * my * F.avg(x * x * y)
        - 2 * mx * F.avg(x * y * y)
        + my * my * F.avg(x * x)
        + mx * mx * F.avg(y * y)
        + 4 * mx * my * F.avg(x * y)
        - 3 * mx * mx * my * my
    )
    vx, vy = F.avg(x * x) - mx * mx, F.avg(y * y) - my * my
    return F.when((vx > 1e-15) & (vy > 1e-15), F.try_divide(top, vx * vy))


def capture(common: Column, asset: Column, up: bool, least: int = 1) -> Column:
    """Regression through the origin over the rises (or falls) of the common series."""
    side = (common > 0) if up else (common < 0)
    return F.when(F.count(F.when(side, 1)) >= least, F.try_divide(F.sum(F.when(side, common * asset)), F.sum(F.when(side, common * common))))


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe ratio (per period) is above a benchmark; kurtosis is the raw fourth moment."""
    if n < 2:
        return 0.0
    spread = max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2, 1e-12) ** 0.5
    return NormalDist().cdf((sharpe - benchmark) * (n - 1) ** 0.5 / spread)


def expected_maximum_sharpe(deviation: float, trials: int) -> float:
    """Expected maximum of so many independent Sharpe ratios of a given deviation."""
    if trials < 2:
        return 0.0
    inverse = NormalDist().inv_cdf
    return deviation * ((1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - 1 / (trials * 2.718281828459045)))
