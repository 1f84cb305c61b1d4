"""Queries of the whole rule sets over the hourly bars: indicators, entries and exits of every bar."""

from __future__ import annotations

from ebbline.operators import indicators, rules
from ebbline.plans.series import _r
from ebbline.sources.tables import bars, bars_sql

B = bars_sql()
W = "OVER (PARTITION BY symbol ORDER BY open_time"


def _v(p, c):
    return p[c].to_numpy()


FOLDS = {
    "rsi": lambda p: indicators.rsi(_v(p, "close"), 14),
    "sar": lambda p: indicators.parabolic(_v(p, "high"), _v(p, "low")),
    "share": lambda p: indicators.seeded_ema(_v(p, "close"), 12) / indicators.seeded_ema(_v(p, "close"), 26) - 1,
    "macd": lambda p: indicators.macd(_v(p, "close"), 12, 26),
    "minus": lambda p: indicators.directional(_v(p, "high"), _v(p, "low"), _v(p, "close"), 14)[1],
    "adx": lambda p: indicators.directional(_v(p, "high"), _v(p, "low"), _v(p, "close"), 14)[2],
    "slow_adx": lambda p: indicators.directional(_v(p, "high"), _v(p, "low"), _v(p, "close"), 35)[2],
    **{f"ema{n}": lambda p, n=n: indicators.seeded_ema(_v(p, "close"), n) for n in (5, 10, 50, 100)},
}


def folded(spark, d, *names):
    return indicators.per_symbol(bars(spark, d), {n: FOLDS[n] for n in names}, carry=True)


def _out(df, *names):
    return _r(df.select("symbol", "open_time", *names, "enters", "leaves"), *names)


def band_reach(spark, d):
    return _out(rules.band_reach(bars(spark, d)), "low1", "high2", "low4", "high4", "mfi")


def place_to_width(spark, d):
    return _out(rules.place_to_width(bars(spark, d)), "ratio")


def ladder_lengths():
    return sorted({n for ladder in (rules.LADDER_ENTRY, rules.LADDER_EXIT) for pair in rules.rungs(*ladder) for n in pair})


def mean_ladder(spark, d):
    means = {f"tema{n}": lambda p, n=n: indicators.tema(_v(p, "close"), n) for n in ladder_lengths()}
    return _out(rules.mean_ladder(indicators.per_symbol(bars(spark, d), means, carry=True)), "tema15", "tema68")


def mean_share(spark, d):
    return _out(rules.mean_share(folded(spark, d, "share")), "share")


def oversold_hammer(spark, d):
    made = rules.oversold_hammer(folded(spark, d, "rsi", "sar"))
    return _r(made.select("symbol", "open_time", "rsi", "slowk", "low2", "hammer", "enters", "leaves"), "rsi", "slowk", "low2")


def flow_reversal(spark, d):
    return _out(rules.flow_reversal(folded(spark, d, "rsi", "sar", "ema5", "ema10", "ema50", "ema100")), "rsi", "slow", "mfi", "ema100")


def strong_dip(spark, d):
    return _out(rules.strong_dip(folded(spark, d, "adx", "slow_adx", "ema5")), "adx", "slow_adx", "cci", "k", "d", "long_k", "long_d")


def volume_burst(spark, d):
    return _out(rules.volume_burst(folded(spark, d, "rsi", "macd", "minus")), "rsi", "macd", "minus", "usual", "fisher")


def _frame(agg, x, n):
    return f"CASE WHEN row_number() {W}) >= {n} THEN {agg}({x}) {W} ROWS {n - 1} PRECEDING) END"


TP = "((high + low + close) / 3)"
BANDS = ", ".join(f"{_frame('avg', TP, 20)} {sign} {k} * {_frame('stddev_samp', TP, 20)} AS {name}{k}" for k in (1, 2, 4) for sign, name in (("-", "low"), ("+", "high")))
FLOW = f"t AS (SELECT *, {TP} AS tp, lag({TP}) {W}) AS before FROM bars), f AS (SELECT *, CASE WHEN tp > before THEN tp * volume ELSE 0 END AS u, CASE WHEN tp < before THEN tp * volume ELSE 0 END AS n FROM t)"
RATIO = f"""p AS (SELECT symbol, open_time, (close - {_frame('min', 'low', 10)}) / nullif({_frame('max', 'high', 10)} - {_frame('min', 'low', 10)}, 0) AS place,
({_frame('avg', '(4 * high - 2 * low + close) / 3', 20)} - {_frame('avg', '(4 * low - 2 * high + close) / 3', 20)}) / nullif({_frame('avg', TP, 20)}, 0) * 100 AS width FROM bars),
r AS (SELECT symbol, open_time, lag(place, 15) {W}) / nullif(lag(width, 9) {W}), 0) AS ratio FROM p)"""
OUT = {
    "band_reach": (
        band_reach,
        f"""WITH {B}, {FLOW}, s AS (SELECT *, sum(u) {W} ROWS 13 PRECEDING) AS su, sum(n) {W} ROWS 13 PRECEDING) AS sn, row_number() {W}) AS k, {BANDS} FROM f),
m AS (SELECT *, CASE WHEN k > 14 THEN CASE WHEN su + sn = 0 THEN 50 ELSE 100 * su / (su + sn) END END AS mfi FROM s)
SELECT symbol, open_time, round(low1, 6) AS low1, round(high2, 6) AS high2, round(low4, 6) AS low4, round(high4, 6) AS high4, round(mfi, 6) AS mfi,
coalesce(volume > 0 AND close < low1, false) AS enters, coalesce(volume > 0 AND mfi > 46 AND close > high2, false) AS leaves FROM m""",
    ),
    "place_to_width": (place_to_width, f"WITH {B}, {RATIO} SELECT symbol, open_time, round(ratio, 6) AS ratio, coalesce(ratio BETWEEN 0.16 AND 0.75, false) AS enters, false AS leaves FROM r"),
    "mean_ladder": (mean_ladder, None),
    "mean_share": (mean_share, None),
    "oversold_hammer": (oversold_hammer, None),
    "flow_reversal": (flow_reversal, None),
    "strong_dip": (strong_dip, None),
    "volume_burst": (volume_burst, None),
}
