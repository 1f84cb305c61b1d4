"""Settlement series: intervals between settlements, annualised rates, crowding and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.money import annualised
from ebbline.functions.time import snapped_hours
from ebbline.operators.rolling import prior_days_percentile

DAY = 86_400_000


def intervals(points: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """points with the hours since the previous settlement; the first one takes the gap after it."""
    w = Window.partitionBy("symbol").orderBy(ts)
    gap = F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lead(ts).over(w) - F.col(ts))
    return points.withColumn("hours", snapped_hours(gap))


def modal_interval(points: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Per symbol the most frequent interval; ties go to the shorter one. variable: whether there is more than one."""
    counts = intervals(points, ts).filter("hours > 0").withColumn("hours", F.round("hours", 4)).groupBy("symbol", "hours").agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.max_by("hours", F.struct("n", (-F.col("hours")).alias("short"))).alias("hours"), (F.count("*") > 1).alias("variable"), F.sum("n").alias("settlements"))


def annual_rates(points: DataFrame, rate: str, ts: str = "ts_ms") -> DataFrame:
    return intervals(points, ts).withColumn("annual", F.coalesce(annualised(F.col(rate), F.col("hours")), F.lit(0.0)))


def crowded_days(points: DataFrame, rate: str, level: float, days: int, ts: str = "ts_ms") -> DataFrame:
    """Days from which on the daily maximum has been above a level for so many days in a row."""
    daily = points.groupBy("symbol", F.floor(F.col(ts) / DAY).cast("long").alias("day")).agg(F.max(rate).alias("peak"))
    over = daily.filter(F.col("peak") > level).withColumn("run", F.col("day") - F.row_number().over(Window.partitionBy("symbol").orderBy("day")))
    streak = F.row_number().over(Window.partitionBy("symbol", "run").orderBy("day"))
    return over.withColumn("streak", streak).filter(F.col("streak") >= days).select("symbol", "day", "streak")


def extremes(points: DataFrame, value: str, days: int, p: float, ts: str = "ts_ms") -> DataFrame:
    """Points below the percentile of the complete days before theirs."""
    made = prior_days_percentile(points, value, days, p, ts)
    return made.filter(F.col("threshold").isNotNull() & (F.col(value) <= F.col("threshold")))


def two_leg_pnl(cycles: DataFrame, fee: float, slippage: float) -> DataFrame:
    """Spot gain, hedge gain, funding and costs of cycles: entry_spot, exit_spot, entry_perp, exit_perp, notional, funding_rate (sum)."""
    q = F.col("notional") / F.col("entry_spot")
    spot = (F.col("exit_spot") - F.col("entry_spot")) * q
    perp = (F.col("entry_perp") - F.col("exit_perp")) * q
    income = F.col("funding_rate") * F.col("exit_perp") * q
    turnover = q * (F.col("entry_spot") + F.col("exit_spot") + F.col("entry_perp") + F.col("exit_perp"))
    costs = turnover * (fee + slippage)
    return cycles.select("*", spot.alias("spot_pnl"), perp.alias("perp_pnl"), income.alias("funding_pnl"), costs.alias("costs"), (spot + perp + income - costs).alias("net_pnl"))


def two_leg_cycles(points: DataFrame, opens: DataFrame, enter: float, leave: int, span: int, notional: float, bin: int = DAY) -> DataFrame:
    """Cycles of both legs: opened at the first open after a settlement with a positive rate whose mean over (t - span, t] is high, closed at the first open after so many negative ones in a row; those up to the open are not income. An unfinished one ends at the last settlement.

    points: symbol, ts_ms, id, rate. opens: symbol, open_time, spot, perp, one row each. Settlements without a time are left out; an income with a null or infinite rate is null.
    A settlement that opens is positive, so no row of negative ones reaches over it, and both kinds are known without the cycles: these
    begin at the first of one kind after one of the other. Sums run inside bins, each of which starts with those of the bins before, one row
    a bin; sums are in two parts, of which multiples of 2^-20 add up without error. Only what may open or close a cycle leaves its bin: it is
    put in order by symbol."""
    rate, at = F.col("rate"), lambda c: F.floor(c / bin)
    finite = F.coalesce(~F.isnan("rate") & (F.abs("rate") < float("inf")), F.lit(False))
    high = F.when(finite, F.rint(rate * 2.0**20) / 2.0**20).otherwise(0.0)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    above = rate == float("inf")
    parts = {"n": F.lit(1).cast("long"), "known": yes(rate.isNotNull()), "v": high, "w": F.when(finite, rate - high).otherwise(0.0), "bad": yes(~finite), "above": yes(above), "odd": yes(rate.isNotNull() & ~finite & ~above)}
    means, sums = ["known", "v", "w", "above", "odd"], ["n", "v", "w", "bad"]
    own = points.filter("symbol IS NOT NULL AND ts_ms IS NOT NULL").select("symbol", F.col("ts_ms").alias("t"), "id", "rate", *(c.alias(k) for k, c in parts.items()))
    gone = own.groupBy("symbol", (F.col("t") + span).alias("t")).agg(*((-F.sum(c)).alias(c) for c in means))
    bars = opens.filter("symbol IS NOT NULL").select("symbol", F.col("open_time").alias("t"), "spot", "perp")
    lasting = own.groupBy("symbol", at(F.col("t")).alias("bin")).agg(*(F.sum(c).alias(f"m_{c}") for c in means), *(F.sum(c).alias(f"s_{c}") for c in sums))
    leaving = gone.groupBy("symbol", at(F.col("t")).alias("bin")).agg(*(F.sum(c).alias(f"m_{c}") for c in means))
    bins = lasting.unionByName(leaving, allowMissingColumns=True).unionByName(bars.select("symbol", at(F.col("t")).alias("bin")).distinct(), allowMissingColumns=True)
    names = [f"m_{c}" for c in means] + [f"s_{c}" for c in sums]
    bins = bins.groupBy("symbol", "bin").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    before = Window.partitionBy("symbol").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("symbol", (F.col("bin") * bin).alias("t"), F.lit(0).alias("turn"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names), F.col("s_n").alias("size"))
    rows = own.select("symbol", "t", F.lit(2).alias("turn"), "id", "rate", *(F.col(c).alias(f"m_{c}") for c in means), *(F.col(c).alias(f"s_{c}") for c in sums))
    for more in (starts, gone.select("symbol", "t", F.lit(1).alias("turn"), *(F.col(c).alias(f"m_{c}") for c in means)), bars.withColumn("turn", F.lit(3))):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumn("bin", at(F.col("t")))
    key = Window.partitionBy("symbol", "bin")
    ordered = key.orderBy("t", "turn", F.asc_nulls_last("id"))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    same = key.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    is_point = F.col("turn") == 2
    not_negative = is_point & ~F.coalesce((rate < 0) & ~F.isnan("rate"), F.lit(False))
    made = rows.select("symbol", "bin", "t", "turn", "id", "rate", "spot", "perp", *(F.sum(f"s_{c}").over(so_far).alias(c) for c in sums), F.max("size").over(so_far).alias("size"), F.row_number().over(ordered).alias("r"), *(f"m_{c}" for c in means))
    made = made.withColumn("first", F.min(F.when(is_point, F.col("n"))).over(so_far)).withColumn("held", F.max(F.when(not_negative, F.col("n"))).over(so_far))
    made = made.select("*", *(F.sum(f"m_{c}").over(same).alias(f"in_{c}") for c in means)).drop(*(f"m_{c}" for c in means))
    mean = F.when(F.col("in_known") > 0, (F.col("in_v") + F.col("in_w")) / F.col("in_known"))
    enters = is_point & (rate > 0) & ~F.isnan("rate") & (F.col("in_odd") == 0) & ((F.col("in_above") > 0) | (mean >= enter))
    run = F.col("n") - F.coalesce("held", F.col("first") - 1)
    made = made.withColumn("enters", F.coalesce(enters, F.lit(False))).withColumn("leaves", is_point & (run >= leave)).withColumn("unclear", is_point & F.col("held").isNull() & (run < leave)).withColumn("last", is_point & (F.col("n") - F.col("first") + 1 == F.col("size")))
    near = made.filter("enters OR leaves OR unclear OR last OR turn = 3")
    again = lambda c: F.col(c) & ~F.coalesce(F.lag(c).over(key.orderBy("r")), F.lit(False))
    near = near.withColumn("keep", again("enters") | again("leaves") | F.col("unclear") | F.col("last") | (F.col("turn") == 3)).filter("keep")
    symbol = Window.partitionBy("symbol")
    later = symbol.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    place = F.struct("t", "spot", "perp", *sums)
    near = near.withColumn("next", F.last(F.when(F.col("turn") == 3, place), ignorenulls=True).over(later)).filter("turn = 2")
    by_number = symbol.orderBy("n")
    near = near.withColumn("held_before", F.max(F.when(F.col("last"), F.col("held"))).over(by_number.rowsBetween(Window.unboundedPreceding, -1)))
    near = near.withColumn("leaves", F.col("leaves") | (F.col("unclear") & (F.col("n") - F.coalesce("held_before", F.lit(0)) >= leave)))
    near = near.withColumn("final", F.first(F.when(F.col("last"), F.struct("t", "next", *sums)), ignorenulls=True).over(symbol.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    known = near.filter("(enters OR leaves) AND next IS NOT NULL").withColumn("entered", F.lag("enters").over(by_number))
    turns = known.filter("(enters AND coalesce(NOT entered, true)) OR (leaves AND entered)").select("symbol", "n", "enters", "next", "final", F.struct("t", "next", *sums).alias("self"))
    paired = turns.withColumn("close", F.lead("self").over(by_number)).filter("enters").withColumn("end", F.coalesce("close", "final"))
    settled = F.greatest(F.col("end.n") - F.col("next.n"), F.lit(0))
    income = F.when(settled == 0, 0.0).when(F.col("end.bad") == F.col("next.bad"), (F.col("end.v") - F.col("next.v")) + (F.col("end.w") - F.col("next.w")))
    finished = F.col("close").isNotNull()
    return paired.select(
        "symbol",
        F.col("next.t").alias("opened"),
        F.when(finished, F.col("end.next.t")).otherwise(F.col("end.t")).alias("closed"),
        settled.alias("settlements"),
        F.col("next.spot").alias("entry_spot"),
        F.col("end.next.spot").alias("exit_spot"),
        F.col("next.perp").alias("entry_perp"),
        F.col("end.next.perp").alias("exit_perp"),
        F.lit(notional).alias("notional"),
        income.alias("funding_rate"),
        finished.alias("finished"),
    )
