"""Statistics of one array column, as Spark SQL expressions: a candidate's history is an array, and no shuffle is needed. Moments are centred first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbline.functions.stats import MAD_SCALE


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squares(values: Column) -> Column:
    """Sum of squares, in one pass."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def median(values: Column) -> Column:
    """The middle value, or the mean of the two; null for no values."""
    n = F.size(values)
    middle = lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, bind(F.sort_array(values), middle))


def scaled_mad(values: Column, center: Column) -> Column:
    return bind(center, lambda c: MAD_SCALE * median(F.transform(values, lambda x: F.abs(x - c))))


def centred(values: Column) -> Column:
    return bind(mean(values), lambda m: F.transform(values, lambda x: x - m))


def co_moment(x: Column, y: Column, p: int, q: int) -> Column:
    """mean(dx^p dy^q) over the deviations' own spread: sd(x)^p sd(y)^q. Null without spread."""

    def power(v: Column, k: int) -> Column:
        return v if k == 1 else v * v

    def of(dx: Column, dy: Column) -> Column:
        square = lambda d: F.try_divide(squares(d), F.size(d))
        joint = mean(F.zip_with(dx, dy, lambda a, b: power(a, p) * power(b, q)))
        spread = lambda v, k: F.sqrt(v) if k == 1 else v
        return bind(square(dx), lambda vx: bind(square(dy), lambda vy: F.when((vx > 0) & (vy > 0), joint / (spread(vx, p) * spread(vy, q)))))

    return bind(centred(x), lambda dx: bind(centred(y), lambda dy: of(dx, dy)))


def correlation(x: Column, y: Column) -> Column:
    return co_moment(x, y, 1, 1)


def coskewness(x: Column, y: Column) -> Column:
    return co_moment(x, y, 1, 2)


def cokurtosis(x: Column, y: Column) -> Column:
    return co_moment(x, y, 2, 2)


def tail(values: Column, least: int = 2) -> Column:
    """{n, share, dominance, lowest} of the values 2 scaled MADs below the median: their number, their share of the squared deviations, the largest one's share of theirs, and the lowest in MADs. Null with fewer or without spread."""

    def of(center: Column, scale: Column) -> Column:
        square = lambda v: (v - center) * (v - center)
        low = F.filter(values, lambda v: v <= center - 2 * scale)

        def made(t: Column) -> Column:
            energy = total(F.transform(t, square))
            every = F.aggregate(values, F.lit(0.0), lambda s, v: s + square(v))
            found = F.struct(
                F.size(t).alias("n"),
                (energy / every).alias("share"),
                (F.array_max(F.transform(t, square)) / energy).alias("dominance"),
                ((F.array_min(t) - center) / scale).alias("lowest"),
            )
            return F.when((F.size(t) >= least) & (scale > 0), found)

        return bind(low, made)

    return bind(median(values), lambda c: bind(scaled_mad(values, c), lambda s: of(c, s)))


def volatility_of_volatility(values: Column, block: int) -> Column:
    """Scaled MAD over median of the blocks' root mean squares; null without either."""
    root = lambda part: F.sqrt(squares(part) / block)
    count = F.floor(F.size(values) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: root(F.slice(values, i * block + 1, F.lit(block))))
    ratio = lambda b: bind(median(b), lambda m: bind(scaled_mad(b, m), lambda s: F.when((m > 0) & (s > 0), s / m)))
    return F.when(count > 0, bind(blocks, ratio))
