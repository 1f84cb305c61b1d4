"""Entries and exits of published indicator strategies: bars with their indicators in, the same rows with enters and leaves out.

A condition on an indicator that isn't defined yet (too few bars) doesn't hold. What needs recursion comes as a column
of the bars (`indicators.per_symbol`); everything else is made here with frames."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.operators import indicators
from ebbline.operators.rolling import full, sma

# The rules' own parameters.
BAND_WINDOW, BAND_WIDTHS, BAND_FLOW = 20, (1, 2, 3, 4), 46.0
RATIO_PLACE, RATIO_WIDTH, RATIO_PLACE_SHIFT, RATIO_WIDTH_SHIFT, RATIO_LEAST, RATIO_MOST = 10, 20, 15, 9, 0.16, 0.75
LADDER_ENTRY, LADDER_EXIT = (4, 15), (12, 68)
SHARE_ENTRY, SHARE_EXIT = (-0.01416, -0.01176), (-0.00707, -0.02323)
OVERSOLD_RSI, OVERSOLD_SLOW, OVERBOUGHT_FISHER = 30.0, 20.0, 0.3
FLOW_RSI, FLOW_FISHER, FLOW_MONEY, FLOW_MEAN = 28.0, -0.94, 16.0, 40
DIP_ADX, DIP_SLOW_ADX, DIP_CCI, DIP_FAST, DIP_SLOW, DIP_VOLUME, DIP_EXIT_ADX, DIP_EXIT_FAST = 50.0, 26.0, -100.0, 20.0, 30.0, 0.75, 25.0, 70.0
BURST_FRAME, BURST_TIMES, BURST_RSI, BURST_SLOW, BURST_FISHER, BURST_EXIT_RSI, BURST_EXIT_MINUS = 150, 4.0, 26.0, 1.0, 5.0, 74.0, 4.0


def _lag(c: str, k: int = 1, ts: str = "open_time") -> Column:
    return F.lag(c, k).over(Window.partitionBy("symbol").orderBy(ts))


def _marked(bars: DataFrame, enters: Column, leaves: Column) -> DataFrame:
    return bars.withColumn("enters", F.coalesce(enters, F.lit(False))).withColumn("leaves", F.coalesce(leaves, F.lit(False)))


def with_bands(bars: DataFrame, widths: tuple[int, ...], n: int = BAND_WINDOW) -> DataFrame:
    """low<k> and high<k>: the typical price's mean less and plus k sample deviations of n bars."""
    for k in widths:
        low, _, high = indicators.bollinger(indicators.typical(), n, float(k), deviation=F.stddev_samp)
        bars = bars.withColumn(f"low{k}", low).withColumn(f"high{k}", high)
    return bars


def band_reach(bars: DataFrame, below: int = 1, above: int = 2, flow: float = BAND_FLOW) -> DataFrame:
    """Four bands: a close under one of the lower ones enters, one over an upper one leaves while the money flow is high; bars without volume do neither."""
    made = with_bands(bars, BAND_WIDTHS).withColumn("mfi", indicators.money_flow(14))
    traded = F.col("volume") > 0
    return _marked(made, traded & (F.col("close") < F.col(f"low{below}")), traded & (F.col("mfi") > flow) & (F.col("close") > F.col(f"high{above}")))


def place_to_width(bars: DataFrame, least: float = RATIO_LEAST, most: float = RATIO_MOST) -> DataFrame:
    """Enters while an earlier place in the channel, as a share of the width of the average range some bars ago, is within bounds; never leaves."""
    made = bars.withColumn("place", indicators.channel_place(RATIO_PLACE)).withColumn("width", indicators.keltner_width(RATIO_WIDTH))
    made = made.withColumn("ratio", F.try_divide(_lag("place", RATIO_PLACE_SHIFT), _lag("width", RATIO_WIDTH_SHIFT)))
    return _marked(made, F.col("ratio").between(least, most), F.lit(False))


def rungs(count: int, gap: int) -> list[tuple[int, int]]:
    """Neighbouring lengths of a ladder of count means, gap apart; lengths up to 1 are no means."""
    lengths = [gap * i for i in range(count)]
    return [(longer, shorter) for shorter, longer in zip(lengths, lengths[1:]) if shorter > 1]


def mean_ladder(bars: DataFrame, entry: tuple[int, int] = LADDER_ENTRY, exit_: tuple[int, int] = LADDER_EXIT) -> DataFrame:
    """Columns tema<n> as rungs: enters when each longer mean is under the next shorter one, leaves when any is over it."""
    none = F.lit(False)
    enters = [F.col(f"tema{a}") < F.col(f"tema{b}") for a, b in rungs(*entry)]
    # a rung that isn't defined yet must not hide another one that holds
    leaves = [F.coalesce(F.col(f"tema{a}") > F.col(f"tema{b}"), none) for a, b in rungs(*exit_)]
    return _marked(bars, reduce(and_, enters) if enters else none, reduce(or_, leaves) if leaves else none)


def mean_share(bars: DataFrame, entry: tuple[float, float] = SHARE_ENTRY, exit_: tuple[float, float] = SHARE_EXIT) -> DataFrame:
    """Column share (fast mean over slow mean, less one): within one pair of bounds it enters, within the other it leaves. Bounds the wrong way round hold nothing."""
    return _marked(bars, F.col("share").between(*entry), F.col("share").between(*exit_))


def _overbought() -> Column:
    return (F.col("sar") > F.col("close")) & (indicators.inverse_fisher(F.col("rsi")) > OVERBOUGHT_FISHER)


def oversold_hammer(bars: DataFrame, rsi: float = OVERSOLD_RSI, slow: float = OVERSOLD_SLOW) -> DataFrame:
    """Columns rsi and sar: a hammer under the lower band while both oscillators are low enters; a stop above the close with a high transformed RSI leaves."""
    made = indicators.with_stochastic(with_bands(bars, (2,)), 5, 3, "fast", "slowk").withColumn("hammer", F.coalesce(indicators.hammer(), F.lit(False)))
    return _marked(made, F.col("hammer") & (F.col("rsi") < rsi) & (F.col("slowk") < slow) & (F.col("low2") > F.col("close")), _overbought())


def flow_reversal(bars: DataFrame, rsi: float = FLOW_RSI, fisher: float = FLOW_FISHER, money: float = FLOW_MONEY) -> DataFrame:
    """Columns rsi, sar, ema5, ema10, ema50, ema100: low RSI and money flow under the mean, with a rising trend or a fresh cross, enter."""
    made = indicators.with_stochastic(bars, 5, 3, "fast", "slow").withColumn("mfi", indicators.money_flow(14)).withColumn("mean", sma(F.col("close"), FLOW_MEAN))
    turned = (F.col("ema50") > F.col("ema100")) | indicators.crossed_above(F.col("ema5"), F.col("ema10"))
    low = (F.col("rsi") > 0) & (F.col("rsi") < rsi) & (indicators.inverse_fisher(F.col("rsi")) < fisher) & (F.col("mfi") < money)
    return _marked(made, low & turned & (F.col("close") < F.col("mean")) & (F.col("slow") > F.col("fast")) & (F.col("slow") > 0), _overbought())


def strong_dip(bars: DataFrame, adx: float = DIP_ADX, slow_adx: float = DIP_SLOW_ADX, cci: float = DIP_CCI, fast: float = DIP_FAST, slow: float = DIP_SLOW) -> DataFrame:
    """Columns adx, slow_adx, ema5: in a strong trend, both oscillators low a bar ago and the quick one turning up enter; a weak trend with a high oscillator leaves."""
    made = indicators.with_stochastic(indicators.with_stochastic(bars, 5, 3, "k", "d"), 50, 3, "long_k", "long_d").withColumn("cci", indicators.commodity_channel(14))
    made = made.withColumn("traded", full(F.col("volume"), F.avg, -11, 0))
    was_under = _lag("k") < _lag("d")
    strong = (F.col("adx") > adx) | (F.col("slow_adx") > slow_adx)
    low = (_lag("k") < fast) & (_lag("d") < fast) & (_lag("long_k") < slow) & (_lag("long_d") < slow)
    enters = strong & low & was_under & (F.col("k") > F.col("d")) & (F.col("cci") < cci) & (F.col("traded") > DIP_VOLUME) & (F.col("close") > 1e-6)
    high = (F.col("k") > DIP_EXIT_FAST) | (F.col("d") > DIP_EXIT_FAST)
    return _marked(made, enters, (F.col("slow_adx") < DIP_EXIT_ADX) & high & was_under & (F.col("close") > F.col("ema5")))


def volume_burst(bars: DataFrame, times: float = BURST_TIMES, rsi: float = BURST_RSI, fisher: float = BURST_FISHER, exit_rsi: float = BURST_EXIT_RSI) -> DataFrame:
    """Columns rsi, macd, minus: much volume under the mean while the transformed RSI (0 to 100) is low enters; RSI crossing up under a negative macd leaves."""
    made = indicators.with_stochastic(bars, 5, 3, "fast", "slow").withColumn("mean", sma(F.col("close"), FLOW_MEAN)).withColumn("usual", sma(F.col("volume"), BURST_FRAME))
    made = made.withColumn("fisher", 50 * (indicators.inverse_fisher(F.col("rsi")) + 1))
    low = (F.col("close") < F.col("mean")) & (F.col("slow") > F.col("fast")) & (F.col("slow") > BURST_SLOW) & (F.col("rsi") > rsi) & (F.col("fisher") < fisher)
    enters = low & (F.col("volume") > times * F.col("usual")) & (F.col("close") > 2e-6)
    return _marked(made, enters, indicators.crossed_above(F.col("rsi"), F.lit(exit_rsi)) & (F.col("macd") < 0) & (F.col("minus") > BURST_EXIT_MINUS))
