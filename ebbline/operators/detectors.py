"""Event detectors over cross-sections, whole: each half, persistence, quartile and single-winner condition. Defaults are fixed values of the rules.

Rows are decision_ms, symbol and values. A decision's members are the rows of its time; of several candidates one wins,
by a total order that ends in the symbol. Histories are frames of one symbol's rows, as arrays of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import arrays
from ebbline.functions.stats import MAD_SCALE
from ebbline.operators.cross import AT, borda, leave_one_out, robust_z, section

MEMBERS = 10


def history(value: str, first: int, last: int) -> Column:
    """The values of a symbol's rows first..last as an array, null unless all are there."""
    frame = Window.partitionBy("symbol").orderBy(AT).rowsBetween(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, F.collect_list(value).over(frame))


def quarter(members: Column) -> Column:
    return F.floor((members + 3) / 4)


def winner(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each decision."""
    return rows.withColumn("__n", F.row_number().over(section().orderBy(*order, "symbol"))).filter("__n = 1").drop("__n")


def _halves(rows: DataFrame, half: int, of) -> DataFrame:
    """rows with full histories of both halves: first, second (as of() gives them) and the members of the decision."""
    held = rows.withColumn("__x", history("value", -2 * half + 1, 0)).withColumn("__y", history("common", -2 * half + 1, 0)).filter("__x IS NOT NULL AND __y IS NOT NULL")
    part = lambda c, k: F.slice(c, k * half + 1, half)
    made = held.select(AT, "symbol", *(of(part("__x", k), part("__y", k)).alias(n) for k, n in enumerate(("first", "second"))))
    return made.withColumn("members", F.count("*").over(section()))


def _residual(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def both_halves(rows: DataFrame, half: int, of, bound: float, largest: bool, members: int = MEMBERS) -> DataFrame:
    """The member that is beyond the bound and in the outer quarter of its decision in each half; the steadier one wins. Members without a statistic count for the quarter, not in the ranks."""
    made = _halves(rows, half, of).filter(F.col("members") >= members).filter("first IS NOT NULL AND second IS NOT NULL")
    sign = -1 if largest else 1
    place = lambda c: F.row_number().over(section().orderBy(sign * F.col(c), "symbol"))
    beyond = (sign * F.col("first") <= sign * bound) & (sign * F.col("second") <= sign * bound)
    found = made.withColumn("__a", place("first")).withColumn("__b", place("second")).filter(beyond & (F.col("__a") <= quarter(F.col("members"))) & (F.col("__b") <= quarter(F.col("members"))))
    least, most = F.least("first", "second"), F.greatest("first", "second")
    order = (-least, -most) if largest else (most, least)
    return winner(found, *order).select(AT, "symbol", "first", "second", "members")


def unstable_volatility(rows: DataFrame, half: int = 168, block: int = 24, bound: float = 0.25, members: int = MEMBERS) -> DataFrame:
    return both_halves(rows, half, lambda x, y: arrays.volatility_of_volatility(_residual(x, y), block), bound, True, members)


def negative_coskewness(rows: DataFrame, half: int = 168, bound: float = -0.2, members: int = MEMBERS) -> DataFrame:
    return both_halves(rows, half, lambda x, y: arrays.coskewness(_residual(x, y), y), bound, False, members)


def systematic_cokurtosis(rows: DataFrame, half: int = 168, bound: float = 1.5, members: int = MEMBERS) -> DataFrame:
    return both_halves(rows, half, lambda x, y: arrays.cokurtosis(_residual(x, y), y), bound, True, members)


def downside_tails(rows: DataFrame, half: int = 84, share: float = 0.25, dominance: float = 0.65) -> DataFrame:
    """Candidates whose residuals have a heavy lower tail of several values in each half."""
    made = _halves(rows, half, lambda x, y: arrays.tail(_residual(x, y))).filter("first IS NOT NULL AND second IS NOT NULL")
    low = lambda f: F.least(F.col(f"first.{f}"), F.col(f"second.{f}"))
    out = made.select(AT, "symbol", F.col("first.n").alias("first_tail"), F.col("second.n").alias("second_tail"), low("share").alias("share"), F.greatest("first.dominance", "second.dominance").alias("dominance"), low("lowest").alias("lowest"))
    return out.filter((F.col("share") >= share) & (F.col("dominance") <= dominance))


def correlation_breakdown(rows: DataFrame, baseline: int = 36, recent: int = 12, displacement: float = 0.024, positive: int = 7, largest: float = 0.06, single: float = 0.5, before: float = 0.5, after: float = 0.1, fall: float = 0.5) -> DataFrame:
    """Candidates that moved with their peers and then away from them, by a steady rise against them."""
    n = baseline + recent
    held = rows.withColumn("__x", history("value", -n + 1, 0)).withColumn("__y", history("common", -n + 1, 0)).filter("__x IS NOT NULL AND __y IS NOT NULL")
    late = lambda c: F.slice(c, baseline + 1, recent)
    held = held.withColumn("__r", _residual(late("__x"), late("__y"))).withColumn("displacement", arrays.total(F.col("__r")))
    steady = (
        (F.col("displacement") >= displacement)
        & (F.size(F.filter("__r", lambda v: v > 0)) >= positive)
        & (F.array_max(F.transform(late("__x"), lambda v: F.abs(v))) <= largest)
        & (F.greatest(F.element_at("__r", -1), F.lit(0.0)) <= single * F.col("displacement"))
    )
    early = lambda c: F.slice(c, 1, baseline)
    made = held.filter(steady).select(AT, "symbol", "displacement", arrays.correlation(early("__x"), early("__y")).alias("baseline"), arrays.correlation(late("__x"), late("__y")).alias("recent"))
    return made.filter((F.col("baseline") >= before) & (F.col("recent") <= after) & (F.col("baseline") - F.col("recent") >= fall))


def persistent_laggards(rows: DataFrame, days: int = 28, least: int = 21) -> DataFrame:
    """Members in the lowest quarter by volume on most of so many days, with their median place and volume."""
    placed = rows.withColumn("__p", F.row_number().over(section().orderBy("volume", "symbol"))).withColumn("__q", quarter(F.count("*").over(section())))
    placed = placed.withColumn("__low", (F.col("__p") <= F.col("__q")).cast("int"))
    held = placed.select(AT, "symbol", history("__low", -days + 1, 0).alias("lows"), history("__p", -days + 1, 0).alias("places"), history("volume", -days + 1, 0).alias("volumes"))
    low = F.aggregate("lows", F.lit(0), lambda a, x: a + x)
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    made = held.filter("lows IS NOT NULL").withColumn("low_days", low).filter(F.col("low_days") >= least)
    return made.select(AT, "symbol", "low_days", arrays.median(double("places")).alias("median_place"), arrays.median(double("volumes")).alias("median_volume"))


def downside_rejection(rows: DataFrame, members: int = MEMBERS, median: float = -0.006, negative: float = 0.7, span: float = 0.018, fall: float = -0.012, location: float = 0.8, residual: float = 0.2) -> DataFrame:
    """The member that was rejected from its low best while most fell. rows: open, high, low, close."""
    made = rows.select(
        AT,
        "symbol",
        F.ln(F.col("close") / F.col("open")).alias("ret"),
        (F.col("high") / F.col("low") - 1).alias("span"),
        (F.col("low") / F.col("open") - 1).alias("fall"),
        F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("location"),
    )
    w = section()
    made = made.withColumn("members", F.count("*").over(w)).withColumn("bad", F.count_if(F.col("location").isNull()).over(w)).filter((F.col("members") >= members) & (F.col("bad") == 0))
    made = made.withColumn("median", F.percentile("ret", F.lit(0.5)).over(w)).withColumn("down", F.count_if(F.col("ret") < 0).over(w))
    made = made.filter((F.col("median") <= median) & (F.col("down") >= negative * F.col("members") - 1e-9))
    made = leave_one_out(made, "location").withColumn("residual", F.col("location") - F.col("others_median"))
    made = made.withColumn("__p", F.row_number().over(w.orderBy(F.col("residual").desc(), "symbol")))
    hit = (F.col("ret") > 0) & (F.col("span") >= span) & (F.col("fall") <= fall) & (F.col("location") >= location) & (F.col("residual") >= residual) & (F.col("__p") <= quarter(F.col("members")))
    best = winner(made.filter(hit), F.col("residual").desc(), F.col("location").desc(), F.col("fall"), F.col("span").desc())
    return best.select(AT, "symbol", "residual", "location", "fall", "span")


def buy_absorption(rows: DataFrame, members: int = MEMBERS, share: float = 0.6, z: float = 2.0, fall: float = 0.004, move: float = 0.006) -> DataFrame:
    """The member whose takers bought most against the others while its price didn't follow. rows: open, close, quote_volume, buy_volume."""
    w = section()
    good = (F.least("open", "close", "quote_volume") > 0) & F.col("buy_volume").between(0, F.col("quote_volume"))
    made = rows.withColumn("members", F.count("*").over(w)).withColumn("__good", F.count_if(good).over(w)).filter((F.col("members") >= members) & (F.col("__good") == F.col("members")))
    made = made.select(AT, "symbol", F.ln(F.col("close") / F.col("open")).alias("ret"), (F.col("buy_volume") / F.col("quote_volume")).alias("share"))
    made = made.withColumn("__c", F.percentile("share", F.lit(0.5)).over(w)).withColumn("__r", F.percentile("ret", F.lit(0.5)).over(w))
    made = made.withColumn("__s", MAD_SCALE * F.percentile(F.abs(F.col("share") - F.col("__c")), F.lit(0.5)).over(w)).filter("__s > 0")
    made = made.withColumn("z", (F.col("share") - F.col("__c")) / F.col("__s")).withColumn("relative", F.col("ret") - F.col("__r"))
    hit = (F.col("share") >= share) & (F.col("z") >= z) & F.col("relative").between(-fall, 0) & (F.abs("ret") <= move)
    return winner(made.filter(hit), F.col("z").desc(), F.col("share").desc(), F.col("relative")).select(AT, "symbol", "z", "share", "relative")


def dispersion_leader(rows: DataFrame, span: int, recent: int, members: int = MEMBERS, least: float = 0.0, ratio: float = 1.5, total: float = 0.024, positive: int = 7, single: float = 0.5) -> DataFrame:
    """The leader of each span of time whose dispersion grew in its last part: ahead in total, most of the time, in both halves of that part, and not by one move. Members have to be there at every time of the span."""
    made = robust_z(rows).select(AT, "symbol", "residual", (F.col("mad") * MAD_SCALE).alias("dispersion"), F.floor(F.col(AT) / span).cast("long").alias("window"), (F.floor(F.col(AT) / span + 1) * span - recent <= F.col(AT)).alias("late"))
    half = (F.col("window") + 1) * span - recent / 2 <= F.col(AT)
    times = made.groupBy("window", AT, "late").agg(F.max("dispersion").alias("dispersion"))
    level = times.groupBy("window").agg(F.count("*").alias("times"), F.percentile(F.when(~F.col("late"), F.col("dispersion")), F.lit(0.5)).alias("baseline"), F.percentile(F.when(F.col("late"), F.col("dispersion")), F.lit(0.5)).alias("recent"))
    level = level.filter((F.col("baseline") > 0) & (F.col("recent") >= least) & (F.col("recent") >= ratio * F.col("baseline")))
    own = F.when(F.col("late"), F.col("residual"))
    up = F.when(own > 0, own)
    by = made.groupBy("window", "symbol").agg(
        F.count("*").alias("n"),
        F.sum(own).alias("total"),
        F.count(up).alias("positive"),
        F.coalesce(F.sum(F.when(~half, own)), F.lit(0.0)).alias("first_half"),
        F.coalesce(F.sum(F.when(half, own)), F.lit(0.0)).alias("second_half"),
        F.coalesce(F.max(up) / F.sum(up), F.lit(1.0)).alias("single"),
    )
    full = by.join(level, "window").filter("n = times AND total IS NOT NULL")
    w = Window.partitionBy("window")
    full = full.withColumn("members", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.col("total").desc(), "symbol"))).filter((F.col("__n") == 1) & (F.col("members") >= members))
    hit = (F.col("total") >= total) & (F.col("positive") >= positive) & (F.col("first_half") > 0) & (F.col("second_half") > 0) & (F.col("single") <= single)
    return full.filter(hit).select("window", "symbol", "baseline", "recent", "total", "positive", "single")


def range_strength(rows: DataFrame, bars: int = 42, members: int = MEMBERS, span: float = 0.03922071315328133, ratio: float = 2.0, z: float = 3.0, location: float = 0.9, body: float = 0.6, relative: float = 0.024692612590371522) -> DataFrame:
    """The strongest member of those whose range broke out of its own history upwards. rows: open, high, low, close."""
    made = rows.withColumn("range", F.ln(F.col("high") / F.col("low"))).withColumn("__h", history("range", -bars, -1)).filter("__h IS NOT NULL AND high > low")
    w = section()
    made = made.withColumn("ret", F.ln(F.col("close") / F.col("open"))).withColumn("members", F.count("*").over(w)).withColumn("relative", F.col("ret") - F.percentile("ret", F.lit(0.5)).over(w))
    level = arrays.bind(arrays.median(F.col("__h")), lambda m: F.struct(m.alias("baseline"), arrays.scaled_mad(F.col("__h"), m).alias("scale")))
    # one value or none through a generator: both parts are computed once
    made = made.withColumn("__l", F.explode(F.array(level))).filter("__l.baseline > 0 AND __l.scale > 0").withColumn("baseline", F.col("__l.baseline")).withColumn("__s", F.col("__l.scale"))
    height = F.col("high") - F.col("low")
    made = made.select(AT, "symbol", "members", "range", "relative", (F.col("range") / F.col("baseline")).alias("ratio"), ((F.col("range") - F.col("baseline")) / F.col("__s")).alias("z"), ((F.col("close") - F.col("low")) / height).alias("location"), ((F.col("close") - F.col("open")) / height).alias("body"))
    hit = (F.col("members") >= members) & (F.col("range") >= span) & (F.col("ratio") >= ratio) & (F.col("z") >= z) & (F.col("location") >= location) & (F.col("body") >= body) & (F.col("relative") >= relative)
    return winner(made.filter(hit), F.col("relative").desc(), F.col("z").desc()).drop("members")


def low_peaks(rows: DataFrame, half: int, members: int = MEMBERS, most: float = 0.07696104113612832) -> DataFrame:
    """The member without a high peak against the others: in the lowest quarter of peaks in both halves."""
    made = leave_one_out(rows).withColumn("residual", F.col("value") - F.col("others_median"))
    made = made.select(AT, "symbol", history("residual", -2 * half + 1, -half).alias("a"), history("residual", -half + 1, 0).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    made = made.select(AT, "symbol", F.array_max("a").alias("first"), F.array_max("b").alias("second")).withColumn("members", F.count("*").over(section()))
    place = lambda c: F.row_number().over(section().orderBy(c, "symbol"))
    made = made.withColumn("__a", place("first")).withColumn("__b", place("second"))
    hit = (F.col("members") >= members) & (F.greatest("first", "second") <= most) & (F.col("__a") <= quarter(F.col("members"))) & (F.col("__b") <= quarter(F.col("members")))
    return winner(made.filter(hit), F.greatest("first", "second"), F.col("first") + F.col("second")).select(AT, "symbol", "first", "second")


def attention_days(rows: DataFrame, days: int = 30, members: int = MEMBERS, share: float = 2.0, volume: float = 1.5, muted: float = 0.01) -> DataFrame:
    """The member whose share and amount of volume rose most while its price hardly moved against the others. rows: open, close, quote_volume."""
    made = rows.withColumn("value", F.col("close") / F.col("open") - 1).withColumn("share", F.try_divide(F.col("quote_volume"), F.sum("quote_volume").over(section()))).withColumn("members", F.count("*").over(section()))
    made = leave_one_out(made).withColumn("relative", F.col("value") - F.col("others_median"))
    made = made.withColumn("__s", history("share", -days, -1)).withColumn("__v", history("quote_volume", -days, -1)).filter("__s IS NOT NULL AND __v IS NOT NULL")
    made = made.withColumn("__a", arrays.median(F.col("__s"))).withColumn("__b", arrays.median(F.col("__v"))).filter("__a > 0 AND __b > 0")
    made = made.withColumn("share_ratio", F.col("share") / F.col("__a")).withColumn("volume_ratio", F.col("quote_volume") / F.col("__b"))
    hit = (F.col("members") >= members) & (F.col("share_ratio") >= share) & (F.col("volume_ratio") >= volume) & F.col("relative").between(-muted, muted)
    return winner(made.filter(hit), F.col("share_ratio").desc(), F.col("volume_ratio").desc()).select(AT, "symbol", "share_ratio", "volume_ratio", "relative")


def joint_trends(rows: DataFrame, days: int = 7, recent: int = 3, before: int = 21, members: int = MEMBERS, trend: float = 0.03, ratio: float = 1.25) -> DataFrame:
    """The member in the top quarter by trend against the others and by its share of volume against its own past, with every recent share above that past. rows: close, quote_volume."""
    w = section()
    made = rows.withColumn("share", F.try_divide(F.col("quote_volume"), F.sum("quote_volume").over(w)))
    made = made.withColumn("__then", F.lag("close", days).over(Window.partitionBy("symbol").orderBy(AT))).withColumn("__r", history("share", -recent + 1, 0)).withColumn("__b", history("share", -recent - before + 1, -recent))
    made = made.filter("__then IS NOT NULL AND __r IS NOT NULL AND __b IS NOT NULL").withColumn("__t", F.ln(F.col("close") / F.col("__then")))
    made = made.withColumn("trend", F.col("__t") - F.percentile("__t", F.lit(0.5)).over(w)).withColumn("members", F.count("*").over(w)).withColumn("__m", arrays.median(F.col("__b")))
    made = made.withColumn("ratio", F.coalesce(F.when(F.col("__m") > 0, arrays.median(F.col("__r")) / F.col("__m")), F.lit(0.0))).withColumn("steady", (F.col("__m") > 0) & (F.array_min("__r") > F.col("__m")))
    made = made.withColumn("__a", borda(made, "trend")).withColumn("__c", borda(made, "ratio"))
    inner = lambda c: F.col("members") - F.col(c) + 1 <= quarter(F.col("members"))
    hit = (F.col("members") >= members) & inner("__a") & inner("__c") & (F.col("trend") >= trend) & (F.col("ratio") >= ratio) & F.col("steady")
    return winner(made.filter(hit), (F.col("__a") + F.col("__c")).desc(), F.col("trend").desc(), F.col("ratio").desc()).select(AT, "symbol", "trend", "ratio", (F.col("__a") + F.col("__c")).alias("score"))
