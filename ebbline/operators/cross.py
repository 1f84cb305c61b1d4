"""Cross-sections: what each member is against the others at one time. Rows: decision_ms, symbol, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.stats import MAD_SCALE, capture, cokurtosis, coskewness, pearson

AT = "decision_ms"


def section():
    return Window.partitionBy(AT)


def robust_z(rows: DataFrame, value: str = "value", least: int = 3) -> DataFrame:
    """rows with the section's median and scaled MAD, residual and z; null where there are too few members or no spread."""
    made = rows.withColumn("median", F.percentile(value, F.lit(0.5)).over(section())).withColumn("residual", F.col(value) - F.col("median"))
    made = made.withColumn("mad", F.percentile(F.abs("residual"), F.lit(0.5)).over(section())).withColumn("members", F.count("*").over(section()))
    return made.withColumn("z", F.when((F.col("members") >= least) & (F.col("mad") > 0), F.col("residual") / (MAD_SCALE * F.col("mad"))))


def leaders(rows: DataFrame, score: str, largest: bool = True) -> DataFrame:
    """The first member of each section; ties go to the smaller symbol."""
    order = F.col(score).desc() if largest else F.col(score).asc()
    return rows.withColumn("__n", F.row_number().over(section().orderBy(order, "symbol"))).filter("__n = 1").drop("__n")


def leave_one_out(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with the median of all other members: of the section's order only the three values around its middle can be one."""
    placed = rows.withColumn("__i", F.row_number().over(section().orderBy(value, "symbol")) - 1).withColumn("__n", F.count("*").over(section()) - 1)
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    at = lambda k: F.max(F.when(F.col("__i") == low + k, F.col(value))).over(section())
    held = placed.withColumn("__mid", F.struct(at(0).alias("a"), at(1).alias("b"), at(2).alias("c")))
    # a member at or before a place moves that place by one
    first = F.when(F.col("__i") <= low, F.col("__mid.b")).otherwise(F.col("__mid.a"))
    later = F.when(F.col("__i") <= high, F.col("__mid.c")).otherwise(F.col("__mid.b"))
    second = F.when(high == low, first).otherwise(later)
    return held.withColumn("others_median", F.when(F.col("__n") > 0, (first + second) / 2)).drop("__i", "__n", "__mid")


def breadth(rows: DataFrame, value: str = "value") -> DataFrame:
    """Per time: members, share that rose, share that fell, and median."""
    return rows.groupBy(AT).agg(F.count("*").alias("members"), F.avg((F.col(value) > 0).cast("double")).alias("rising"), F.avg((F.col(value) < 0).cast("double")).alias("falling"), F.percentile(value, F.lit(0.5)).alias("median"))


def shares(rows: DataFrame, value: str) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(section()))


def borda(rows: DataFrame, value: str) -> Column:
    """n for the largest value down to 1; ties by symbol."""
    return F.count("*").over(section()) - F.row_number().over(section().orderBy(F.col(value).desc(), "symbol")) + 1


def ascending_rank(value: str) -> Column:
    return F.row_number().over(section().orderBy(value, "symbol"))


def top_quartile(value: str) -> Column:
    """Whether a member is among the first ceil(n / 4)."""
    return F.row_number().over(section().orderBy(F.col(value).desc(), "symbol")) <= F.floor((F.count("*").over(section()) + 3) / 4)


def bottom_quartile(value: str) -> Column:
    return F.row_number().over(section().orderBy(F.col(value).asc(), "symbol")) <= F.floor((F.count("*").over(section()) + 3) / 4)


def with_common(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with the section's median as the common series."""
    return rows.withColumn("common", F.percentile(value, F.lit(0.5)).over(section()))


def co_moments(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Correlation, coskewness and cokurtosis of the residual against the common series."""
    x, y = F.col(value) - F.col("common"), F.col("common")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col(value), y).alias("correlation"), coskewness(x, y).alias("coskewness"), cokurtosis(x, y).alias("cokurtosis"))


def captures(rows: DataFrame, by: list[str], least: int, value: str = "value") -> DataFrame:
    up, down = capture(F.col("common"), F.col(value), True, least), capture(F.col("common"), F.col(value), False, least)
    return rows.groupBy(*by).agg(up.alias("up"), down.alias("down")).withColumn("score", F.col("up") - F.col("down"))


def tail_energy(rows: DataFrame, by: list[str], value: str = "residual", least: int = 2) -> DataFrame:
    """Share of the squared deviations that the lower tail (2 scaled MADs below the median) holds, and its largest part."""
    w = Window.partitionBy(*by)
    made = rows.withColumn("__m", F.percentile(value, F.lit(0.5)).over(w)).withColumn("__d", F.col(value) - F.col("__m"))
    made = made.withColumn("__s", MAD_SCALE * F.percentile(F.abs("__d"), F.lit(0.5)).over(w))
    low = F.col("__d") <= -2 * F.col("__s")
    square = F.col("__d") * F.col("__d")
    out = made.groupBy(*by).agg(F.count_if(low).alias("tail"), F.sum(F.when(low, square)).alias("__t"), F.sum(square).alias("__a"), F.max(F.when(low, square)).alias("__x"), F.max("__s").alias("__s"))
    ok = (F.col("tail") >= least) & (F.col("__s") > 0) & (F.col("__a") > 0)
    return out.select(*by, "tail", F.when(ok, F.col("__t") / F.col("__a")).alias("energy"), F.when(ok, F.col("__x") / F.col("__t")).alias("dominance"))


def volatility_of_volatility(rows: DataFrame, by: list[str], block: str, value: str) -> DataFrame:
    """Scaled MAD over median of the blocks' root mean squares."""
    blocks = rows.groupBy(*by, block).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    w = Window.partitionBy(*by)
    made = blocks.withColumn("__m", F.percentile("rms", F.lit(0.5)).over(w))
    out = made.groupBy(*by).agg(F.count("*").alias("blocks"), F.max("__m").alias("median"), F.percentile(F.abs(F.col("rms") - F.col("__m")), F.lit(0.5)).alias("mad"))
    return out.select(*by, "blocks", F.when(F.col("median") > 0, MAD_SCALE * F.col("mad") / F.col("median")).alias("ratio"))
