"""Queries on cross-sections, universes, quarantine, forward paths, trades and indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbline.functions import money, stats
from ebbline.operators import cross, episodes, funding, indicators, metrics, paths, rolling, universe
from ebbline.plans import trend
from ebbline.plans.series import REGION, _r
from ebbline.sources.tables import DAY, HOUR, TRADES, bars, bars_sql, panel, panel_sql, ticks, trades

FOUR = 4 * HOUR
B, P, R = bars_sql(), panel_sql(), panel_sql(REGION)


def _hourly(spark, d):
    """Log returns of the hourly bars as cross-sections."""
    made = bars(spark, d).withColumn("value", rolling.log_return())
    return made.filter("value IS NOT NULL").select(F.col("open_time").alias("decision_ms"), "symbol", "value", "volume", "close")


def _daily(spark, d, by=REGION):
    made = panel(spark, d, by).withColumn("value", rolling.log_return("day_ms"))
    return made.filter("value IS NOT NULL").select(F.col("day_ms").alias("decision_ms"), "symbol", "value", "volume", "quote_volume", "close")


HOURLY = f"{B}, x AS (SELECT open_time AS decision_ms, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS value, volume, close FROM bars QUALIFY value IS NOT NULL)"
DAILY = f"{R}, x AS (SELECT day_ms AS decision_ms, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day_ms)) AS value, volume, quote_volume, close FROM panel QUALIFY value IS NOT NULL)"
NATIONS = f"{P}, x AS (SELECT day_ms AS decision_ms, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day_ms)) AS value, volume, quote_volume, close FROM panel QUALIFY value IS NOT NULL)"
COMMON = "c AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY decision_ms) AS common FROM x)"


def xsec_robust_z(spark, d):
    return _r(cross.robust_z(_daily(spark, d, "n_nationkey")).select("decision_ms", "symbol", "residual", "mad", "z"), "residual", "mad", "z")


def xsec_loser_events(spark, d):
    """The lowest robust z of each day, where it is low enough."""
    made = cross.robust_z(_daily(spark, d, "n_nationkey")).filter("z <= -1.5 AND exp(residual) - 1 <= -0.018")
    return _r(cross.leaders(made, "z", largest=False).select("decision_ms", "symbol", "z"), "z")


def xsec_leave_one_out(spark, d):
    return _r(cross.leave_one_out(_daily(spark, d)).select("decision_ms", "symbol", "others_median"), "others_median")


def breadth(spark, d):
    return _r(cross.breadth(_daily(spark, d, "n_nationkey")), "rising", "falling", "median")


def breadth_thrust(spark, d):
    """Days on which most members rose and the median rose far."""
    return _r(cross.breadth(_daily(spark, d, "n_nationkey")).filter("members >= 5 AND rising >= 0.7 AND median >= 0.2").select("decision_ms", "members", "median"), "median")


def stress_leaders(spark, d):
    """On days of broad falls the member that held up best."""
    rows = _daily(spark, d, "n_nationkey")
    stress = cross.breadth(rows).filter("members >= 5 AND falling >= 0.6 AND median <= -0.1").select("decision_ms", "median")
    made = rows.join(stress, "decision_ms").withColumn("residual", F.col("value") - F.col("median")).filter("residual >= 0.02")
    return _r(cross.leaders(made, "residual").select("decision_ms", "symbol", "residual"), "residual")


def volume_share_ratio(spark, d):
    """Share of the day's volume against its own 30-row median before."""
    made = _daily(spark, d).withColumn("share", cross.shares(None, "quote_volume"))
    frame = Window.partitionBy("symbol").orderBy("decision_ms").rowsBetween(-30, -1)
    base = F.when(F.count("share").over(frame) == 30, F.percentile("share", F.lit(0.5)).over(frame))
    return _r(made.select("decision_ms", "symbol", "share", F.try_divide(F.col("share"), base).alias("ratio")), "share", "ratio")


def borda_rank(spark, d):
    rows = _daily(spark, d)
    made = rows.withColumn("a", cross.borda(rows, "value")).withColumn("b", cross.borda(rows, "quote_volume"))
    return made.select("decision_ms", "symbol", (F.col("a") + F.col("b")).alias("score"))


def quartile_membership(spark, d):
    rows = _daily(spark, d, "n_nationkey")
    return rows.select("decision_ms", "symbol", cross.top_quartile("value").alias("top"), cross.bottom_quartile("value").alias("bottom"))


def daily_volume_rank(spark, d):
    return panel(spark, d).select(F.col("day_ms").alias("decision_ms"), "symbol", "volume").select("decision_ms", "symbol", cross.ascending_rank("volume").alias("place"))


def liquidity_laggards(spark, d):
    """Members in the lowest quarter by volume on most of the last 28 days."""
    rows = panel(spark, d, REGION).select(F.col("day_ms").alias("decision_ms"), "symbol", "volume").withColumn("low", cross.bottom_quartile("volume").cast("int"))
    frame = Window.partitionBy("symbol").orderBy("decision_ms").rowsBetween(-27, 0)
    made = rows.withColumn("days", F.sum("low").over(frame)).withColumn("n", F.count("*").over(frame))
    return made.filter("n = 28 AND days >= 16").select("decision_ms", "symbol", "days")


def _month(rows):
    return rows.withColumn("month", universe.month_index("decision_ms"))


def corr_breakdown(spark, d):
    """Correlation with the common series in each half of a month."""
    rows = _month(cross.with_common(_daily(spark, d)))
    half = F.when(F.dayofmonth(F.timestamp_millis("decision_ms")) <= 15, 0).otherwise(1)
    made = cross.co_moments(rows.withColumn("half", half), ["symbol", "month", "half"])
    wide = made.groupBy("symbol", "month").agg(F.max(F.when(F.col("half") == 0, F.col("correlation"))).alias("first"), F.max(F.when(F.col("half") == 1, F.col("correlation"))).alias("second"))
    return _r(wide, "first", "second")


def coskewness_half(spark, d):
    made = cross.co_moments(_month(cross.with_common(_daily(spark, d))), ["symbol", "month"])
    return _r(made.select("symbol", "month", "n", "coskewness"), "coskewness", places=5)


def cokurtosis_half(spark, d):
    made = cross.co_moments(_month(cross.with_common(_daily(spark, d))), ["symbol", "month"])
    return _r(made.select("symbol", "month", "n", "cokurtosis"), "cokurtosis", places=5)


def capture_ratio(spark, d):
    return _r(cross.captures(_month(cross.with_common(_daily(spark, d))), ["symbol", "month"], 3), "up", "down", "score")


def tail_energy_half(spark, d):
    rows = _month(cross.with_common(_daily(spark, d))).withColumn("residual", F.col("value") - F.col("common"))
    return _r(cross.tail_energy(rows, ["symbol", "month"]), "energy", "dominance")


def vol_of_vol_half(spark, d):
    rows = _hourly(spark, d).withColumn("week", F.floor(F.col("decision_ms") / (7 * DAY)).cast("long")).withColumn("block", F.floor(F.col("decision_ms") / DAY).cast("long"))
    return _r(cross.volatility_of_volatility(rows, ["symbol", "week"], "block", "value"), "ratio")


def weekday_residuals(spark, d):
    """Median residual of the same weekday."""
    rows = cross.with_common(_daily(spark, d)).withColumn("residual", F.col("value") - F.col("common"))
    weekday = F.pmod(F.floor(F.col("decision_ms") / DAY) + 3, F.lit(7)).cast("int")
    return _r(rows.groupBy("symbol", weekday.alias("weekday")).agg(F.count("*").alias("n"), F.percentile("residual", F.lit(0.5)).alias("median")), "median")


def lagged_diffusion(spark, d):
    """A member's move on the day after a common shock."""
    rows = cross.with_common(_daily(spark, d))
    shocks = rows.select("decision_ms", "common").distinct().filter("abs(common) >= 0.3").select((F.col("decision_ms") + DAY).alias("decision_ms"), F.signum("common").alias("way"))
    made = rows.join(shocks, "decision_ms")
    return _r(made.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(F.col("value") * F.col("way"), F.lit(0.5)).alias("median")), "median")


def dispersion_expansion(spark, d):
    """The day's dispersion against the median of the 20 days before."""
    daily = _daily(spark, d, "n_nationkey")
    by_day = cross.robust_z(daily).groupBy("decision_ms").agg(F.max("mad").alias("mad"))
    # a day's number of rows before it is bounded by the frame; days are few against rows
    frame = Window.partitionBy(F.lit(0)).orderBy("decision_ms").rowsBetween(-20, -1)
    base = F.when(F.count("mad").over(frame) == 20, F.percentile("mad", F.lit(0.5)).over(frame))
    return _r(by_day.select("decision_ms", "mad", F.try_divide(F.col("mad"), base).alias("ratio")).filter("ratio >= 1.5"), "mad", "ratio")


def range_expansion(spark, d):
    """Log range against its own prior bars, with close location and body."""
    made = panel(spark, d, REGION).withColumn("range", F.ln(F.col("high") / F.col("low")))
    frame = Window.partitionBy("symbol").orderBy("day_ms").rowsBetween(-42, -1)
    base = F.when(F.count("range").over(frame) == 42, F.percentile("range", F.lit(0.5)).over(frame))
    span = F.col("high") - F.col("low")
    out = made.select("symbol", "day_ms", "range", F.try_divide(F.col("range"), base).alias("ratio"), F.try_divide(F.col("close") - F.col("low"), span).alias("location"), F.try_divide(F.abs(F.col("close") - F.col("open")), span).alias("body"))
    return _r(out.filter("ratio >= 1.1 AND location >= 0.8"), "range", "ratio", "location", "body")


def close_location(spark, d):
    """Members that closed near their high on a day on which most closed low."""
    made = panel(spark, d).select(F.col("day_ms").alias("decision_ms"), "symbol", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("location"))
    made = made.withColumn("low_share", F.avg((F.col("location") < 0.5).cast("double")).over(cross.section())).withColumn("members", F.count("*").over(cross.section()))
    return _r(made.filter("members >= 5 AND low_share >= 0.6 AND location >= 0.8").select("decision_ms", "symbol", "location"), "location")


def peak_residuals(spark, d):
    """Largest leave-one-out residual of each month."""
    rows = _month(cross.leave_one_out(_daily(spark, d)))
    return _r(rows.groupBy("symbol", "month").agg(F.max(F.col("value") - F.col("others_median")).alias("peak")), "peak")


def _volumes(spark, d):
    return universe.monthly_volumes(panel(spark, d), 90, 60)


VOLUMES = f"""{P}, d0 AS (SELECT symbol, CAST(day_ms // {DAY} AS BIGINT) AS day, quote_volume FROM panel),
mm AS (SELECT DISTINCT CAST(date_trunc('month', DATE '1970-01-01' + CAST(day AS INTEGER)) AS DATE) AS m0 FROM d0), ms AS (SELECT DISTINCT CAST(m0 + INTERVAL (k) MONTH AS DATE) AS m FROM mm, range(0, 6) r(k)),
ml AS (SELECT m, CAST(m - DATE '1970-01-01' AS BIGINT) AS start FROM ms),
volumes AS (SELECT CAST(year(m) * 12 + month(m) - 1 AS INTEGER) AS month, symbol, quantile_cont(quote_volume, 0.5) AS median_volume, count(*) AS days, count(*) >= 60 AS eligible FROM d0 JOIN ml ON day < start AND day >= start - 90 GROUP BY 1, 2)"""
MEMBERS = f"{VOLUMES}, members AS (SELECT month, symbol, row_number() OVER (PARTITION BY month ORDER BY median_volume DESC, symbol) AS rank, median_volume FROM volumes WHERE eligible QUALIFY rank <= 5)"


def universe_topk_monthly(spark, d):
    return _r(universe.membership(_volumes(spark, d), 5), "median_volume")


def eligibility_status(spark, d):
    return universe.eligibility(_volumes(spark, d), 5, ["3"])


def universe_entrants(spark, d):
    return universe.entrants(universe.membership(_volumes(spark, d), 5))


def universe_best_entrant(spark, d):
    return universe.best_entrants(universe.membership(_volumes(spark, d), 5))


def membership_exits(spark, d):
    return universe.exits(universe.membership(_volumes(spark, d), 5))


def active_member_days(spark, d):
    rows = universe.active(panel(spark, d).select("symbol", "day_ms"), universe.membership(_volumes(spark, d), 5), "day_ms")
    return rows.groupBy("month").agg(F.count_distinct("symbol").alias("active"), F.count("*").alias("rows"))


def _quarantine(spark, d):
    rows = bars(spark, d)
    k = F.pmod(F.col("open_time") / HOUR, F.lit(29)).cast("int")
    bad = ((k == 3) | ((k == 8) & (F.col("symbol") == "click")) | ((k == 9) & F.col("symbol").isin("click", "view", "error", "signup")))
    rows = rows.select("symbol", "open_time", universe.month_index("open_time").alias("month"), (~bad).alias("valid"))
    return rows, rows.select("month", "symbol").distinct()


QUARANTINE = f"""{B}, q AS (SELECT symbol, open_time, CAST(year(make_timestamp(open_time * 1000)) * 12 + month(make_timestamp(open_time * 1000)) - 1 AS INTEGER) AS month, (open_time // {HOUR}) % 29 AS k FROM bars),
v AS (SELECT *, NOT (k = 3 OR (k = 8 AND symbol = 'click') OR (k = 9 AND symbol IN ('click', 'view', 'error', 'signup'))) AS valid FROM q),
m AS (SELECT month, count(DISTINCT symbol) AS active FROM v GROUP BY 1), s AS (SELECT month, open_time, count(*) AS observed, count(*) FILTER (NOT valid) AS invalid FROM v GROUP BY 1, 2),
slots AS (SELECT month, open_time, active, observed, invalid, active - observed AS missing, CASE WHEN invalid = 0 THEN 'clean' WHEN active > observed THEN 'blocked_missing' WHEN invalid >= 2 AND invalid >= 0.8 * active THEN 'event' ELSE 'blocked_isolated' END AS verdict FROM s JOIN m USING (month))"""


def invalid_interval_events(spark, d):
    return universe.invalid_slots(*_quarantine(spark, d)).select("month", "open_time", "active", "observed", "invalid", "missing", "verdict")


def invalid_interval_mask(spark, d):
    rows, members = _quarantine(spark, d)
    return universe.slot_mask(universe.invalid_slots(rows, members), members)


def quarantine_panel(spark, d):
    rows, members = _quarantine(spark, d)
    return universe.panel_status(rows, universe.slot_mask(universe.invalid_slots(rows, members), members), HOUR)


def masked_bars(spark, d):
    rows, members = _quarantine(spark, d)
    return universe.masked(rows, universe.slot_mask(universe.invalid_slots(rows, members), members)).groupBy("symbol").agg(F.count("*").alias("left"))


def _events(spark, d):
    return bars(spark, d).filter("close <= 0.5 * open").select("symbol", F.col("open_time").alias("decision_ms"))


EVENTS = f"{B}, ev AS (SELECT symbol, open_time AS decision_ms FROM bars WHERE close <= 0.5 * open)"
PATH = f"{EVENTS}, path AS (SELECT e.symbol, e.decision_ms AS event_ms, (b.open_time - e.decision_ms) // {HOUR} AS slot, b.high, b.low, b.close, n.open AS entry FROM ev e JOIN bars n ON n.symbol = e.symbol AND n.open_time = e.decision_ms + {HOUR} JOIN bars b ON b.symbol = e.symbol AND b.open_time BETWEEN e.decision_ms + {HOUR} AND e.decision_ms + {24 * HOUR})"


def _path(spark, d):
    return paths.forward(_events(spark, d), bars(spark, d), HOUR, 24)


def mae_mfe(spark, d):
    return _r(paths.observed(_path(spark, d), 24).drop("first_recovery"), "mfe", "mae")


def first_recovery(spark, d):
    return paths.observed(_path(spark, d), 24).select("symbol", "event_ms", F.col("first_recovery").cast("long").alias("first_recovery"))


def forward_path_horizons(spark, d):
    return _r(paths.horizons(_path(spark, d), [1, 4, 8, 24], 0.0015).withColumn("horizon", F.col("horizon").cast("long")), "gross", "net")


def horizon_summary(spark, d):
    made = paths.horizon_summary(paths.horizons(_path(spark, d), [1, 4, 8, 24], 0.0015)).withColumn("horizon", F.col("horizon").cast("long"))
    return _r(made, "mean", "median", "deviation", "win_rate", "p5", "p95", "worst", "net_mean")


def relative_paths(spark, d):
    made = paths.relative(_events(spark, d), bars(spark, d), HOUR, 6)
    return _r(made.withColumn("slot", F.col("slot").cast("long")), "own", "peers", "relative")


def gate_matrix(spark, d):
    return paths.gates(_events(spark, d), 100, 0.4)


def payback_threshold(spark, d):
    made = bars(spark, d).select("symbol", "open_time", money.payback_ratio(F.col("close") / 100, F.lit(30.0), F.lit(money.round_trip(0.001, 0.0005, 0.0005))).alias("ratio"))
    return _r(made, "ratio")


def scenario_cost_returns(spark, d):
    rows = spark.createDataFrame(list(money.COST_SCENARIOS.items()), "scenario string, cost double")
    made = trades(spark, d).select("trade_id", "open_rate", "close_rate").join(F.broadcast(rows))  # four rows
    return _r(made.select("trade_id", "scenario", money.net_return(F.col("open_rate"), F.col("close_rate"), F.col("cost")).alias("net")), "net")


def two_leg_pnl(spark, d):
    t = trades(spark, d).select("trade_id", F.col("open_rate").alias("entry_spot"), F.col("close_rate").alias("exit_spot"), (F.col("open_rate") * 1.001).alias("entry_perp"), (F.col("close_rate") * 0.999).alias("exit_perp"), F.lit(1000.0).alias("notional"), F.lit(0.0003).alias("funding_rate"))
    return _r(funding.two_leg_pnl(t, 0.001, 0.0005).select("trade_id", "spot_pnl", "perp_pnl", "funding_pnl", "costs", "net_pnl"), "spot_pnl", "perp_pnl", "funding_pnl", "costs", "net_pnl")


def position_sizes(spark, d):
    made = rolling.trend_features(panel(spark, d, REGION), slow=20, fast=5, entry=10, exit_=5, atr=14, ts="day_ms")
    size = money.position_size(F.lit(10_000.0), F.lit(8_000.0), F.col("close"), F.col("atr"), F.col("volatility"))
    return _r(made.filter("atr IS NOT NULL AND volatility > 0").select("symbol", "day_ms", size.alias("quantity")), "quantity")


def _customer_trades(spark, d):
    """Trades with their customer as the pair: few of them overlap."""
    owners = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("pair"))
    return trades(spark, d).drop("pair").join(owners, "trade_id")


def occupancy_union(spark, d):
    return episodes.merged(_customer_trades(spark, d))


def occupancy_summary(spark, d):
    return episodes.occupancy(_customer_trades(spark, d))


def max_concurrency(spark, d):
    return episodes.concurrency(trades(spark, d)).withColumn("most", F.col("most").cast("long"))


def sleep_periods(spark, d):
    """Gaps between the trades of each customer."""
    return episodes.sleep_periods(_customer_trades(spark, d))


def realised_equity_daily(spark, d):
    return _r(metrics.daily_equity(trades(spark, d), 10_000.0), "pnl", "equity")


def _marks(spark, d):
    days = panel(spark, d, REGION).select("symbol", F.floor(F.col("day_ms") / DAY).cast("long").alias("day"), "close").filter("symbol = '0'")
    pairs = trades(spark, d).select("pair").distinct()
    return pairs.join(F.broadcast(days.groupBy("day").agg(F.max("close").alias("close"))))  # five pairs, one mark a day


def mtm_equity_daily(spark, d):
    return _r(metrics.marked_equity(trades(spark, d), _marks(spark, d), 10_000.0), "equity", places=3)


def drawdown_curve(spark, d):
    made = metrics.drawdowns(metrics.daily_equity(trades(spark, d), 1_000_000.0))
    return made.select("pair", "day", F.when(F.col("drawdown") < -5e-7, F.round("drawdown", 6)).otherwise(0.0).alias("drawdown"))  # no negative zero


def curve_metrics(spark, d):
    return _r(metrics.curve_metrics(metrics.daily_equity(trades(spark, d), 1_000_000.0)), "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "skew", "kurtosis", places=5)


def curve_metrics_psr(spark, d):
    return _r(metrics.with_psr(metrics.curve_metrics(metrics.daily_equity(trades(spark, d), 1_000_000.0))).select("pair", "sharpe", "psr"), "sharpe", "psr")


def trade_metrics(spark, d):
    return _r(metrics.trade_metrics(trades(spark, d)), "win_rate", "gains", "losses", "profit_factor", "mean_pnl", "median_days", "p95_days")


def concentration_hhi(spark, d):
    return _r(metrics.concentration(trades(spark, d)), "gains", "top3", "hhi")


def delete_best_three(spark, d):
    return _r(metrics.without_best(trades(spark, d)).groupBy("pair").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl")), "pnl")


def losing_streak(spark, d):
    return metrics.losing_streak(trades(spark, d))


def segment_returns(spark, d):
    return _r(metrics.segment_returns(trades(spark, d), 10_000.0), "part_return", places=5)


def cost_attribution(spark, d):
    return _r(metrics.costs(trades(spark, d), 0.001, 0.0005), "fees", "slippage", places=4)


def combined_curve(spark, d):
    return _r(metrics.combined(metrics.daily_equity(trades(spark, d), 1_000_000.0)), "equity")


def bollinger_reentry(spark, d):
    low, mid, high = indicators.bollinger(F.col("close"), 24, 2.0)
    made = bars(spark, d).withColumn("low_band", low).withColumn("high_band", high)
    made = made.withColumn("enters", indicators.crossed_above(F.col("close"), F.col("low_band"))).withColumn("leaves", indicators.crossed_below(F.col("close"), F.col("high_band")))
    return _r(made.filter("enters OR leaves").select("symbol", "open_time", "low_band", "high_band", "enters", "leaves"), "low_band", "high_band", places=4)


def donchian_place(spark, d):
    return _r(bars(spark, d).select("symbol", "open_time", indicators.channel_place(24).alias("place"), indicators.keltner_width(20).alias("width")), "place", "width", places=5)


def money_flow_index(spark, d):
    return _r(bars(spark, d).select("symbol", "open_time", indicators.money_flow(14).alias("mfi")), "mfi", places=5)


def commodity_channel_index(spark, d):
    return _r(bars(spark, d).select("symbol", "open_time", indicators.commodity_channel(20).alias("cci")), "cci", places=5)


def sma_cross(spark, d):
    made = bars(spark, d).withColumn("fast", rolling.sma(F.col("close"), 5)).withColumn("slow", rolling.sma(F.col("close"), 20))
    return made.withColumn("cross", indicators.crossed_above(F.col("fast"), F.col("slow"))).filter("cross").select("symbol", "open_time")


def recursive_indicators(spark, d):
    """Indicators that fold the bars: moving averages, RSI, ADX, parabolic stop, supertrend and smoothed candles."""
    col = lambda p, c: p[c].to_numpy()
    made = indicators.per_symbol(
        bars(spark, d),
        {
            "ema12": lambda p: indicators.ema(col(p, "close"), 12),
            "macd": lambda p: indicators.ema(col(p, "close"), 12) - indicators.ema(col(p, "close"), 26),
            "tema": lambda p: _tema(col(p, "close"), 9),
            "rsi": lambda p: indicators.rsi(col(p, "close"), 14),
            "adx": lambda p: indicators.directional(col(p, "high"), col(p, "low"), col(p, "close"), 14)[2],
            "sar": lambda p: indicators.parabolic(col(p, "high"), col(p, "low")),
            "supertrend": lambda p: indicators.supertrend(col(p, "high"), col(p, "low"), col(p, "close"), 10, 3.0)[0],
            "ha_open": lambda p: indicators.heikin_ashi(*(col(p, c) for c in ("open", "high", "low", "close")))[0],
        },
    )
    return _r(made, "ema12", "macd", "tema", "rsi", "adx", "sar", "supertrend", "ha_open")


def _tema(x, n):
    a = indicators.ema(x, n)
    b = indicators.ema(a, n)
    return 3 * a - 3 * b + indicators.ema(b, n)


def ema_family(spark, d):
    made = indicators.per_symbol(bars(spark, d), {"ema": lambda p: indicators.ema(p["close"].to_numpy(), 20)})
    return _r(made, "ema")


def trend_backtest_equity(spark, d):
    return _r(trend.backtest(rolling.trend_features(panel(spark, d, REGION), slow=50, fast=10, entry=20, exit_=10, atr=14, ts="day_ms"), "day_ms"), "equity", "quantity")


def policy_benchmark(spark, d):
    return _r(trend.policy_benchmark(panel(spark, d, REGION).filter("symbol IN ('0', '1')"), {"0": 0.25, "1": 0.25}, 10_000.0, 0.0015), "equity")


def conservative_reprice(spark, d):
    """Entries on the hourly bars, left at the first of stop, target or timeout."""
    return _r(trend.reprice(_events(spark, d), bars(spark, d), HOUR, 24, target=0.5, stop=0.3), "exit_price", "entry")


def param_grid(spark, d):
    """Every combination of a small parameter neighbourhood, scored on the same bars."""
    made = bars(spark, d).withColumn("ret", rolling.log_return()).select("symbol", "ret").filter("ret IS NOT NULL")
    grid = spark.createDataFrame([(a, b) for a in (0.5, 1.0, 1.5) for b in (0.5, 1.0, 2.0)], "fall double, rise double")
    return made.join(F.broadcast(grid)).groupBy("fall", "rise").agg(F.count_if((F.col("ret") <= -F.col("fall")) | (F.col("ret") >= F.col("rise"))).alias("hits"))  # nine rows


WT = "OVER (PARTITION BY symbol ORDER BY open_time"
MAD = "z0 AS (SELECT decision_ms, symbol, value, value - quantile_cont(value, 0.5) OVER (PARTITION BY decision_ms) AS residual, count(*) OVER (PARTITION BY decision_ms) AS members FROM x), z AS (SELECT *, quantile_cont(abs(residual), 0.5) OVER (PARTITION BY decision_ms) AS mad FROM z0)"
BREADTH = "b AS (SELECT decision_ms, count(*) AS members, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS rising, avg(CASE WHEN value < 0 THEN 1.0 ELSE 0 END) AS falling, quantile_cont(value, 0.5) AS median FROM x GROUP BY 1)"
MONTH_OF = "CAST(year(make_timestamp(decision_ms * 1000)) * 12 + month(make_timestamp(decision_ms * 1000)) - 1 AS INTEGER)"
LOO = "l AS (SELECT a.decision_ms, a.symbol, any_value(a.value) AS value, quantile_cont(b.value, 0.5) AS others_median FROM x a LEFT JOIN x b ON a.decision_ms = b.decision_ms AND a.symbol <> b.symbol GROUP BY 1, 2)"
COV = "avg(x * y) - avg(x) * avg(y)"
EQ = f"""{TRADES}, cal AS (SELECT pair, unnest(generate_series(min(open_ms) // {DAY}, max(close_ms) // {DAY})) AS day FROM trades GROUP BY pair), cl AS (SELECT pair, close_ms // {DAY} AS day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2),
eq AS (SELECT pair, day, coalesce(pnl, 0) AS pnl, sum(coalesce(pnl, 0)) OVER (PARTITION BY pair ORDER BY day) AS gain FROM cal LEFT JOIN cl USING (pair, day))"""
BLOCKS = "u0 AS (SELECT *, CASE WHEN open_ms > max(close_ms) OVER (PARTITION BY pair ORDER BY open_ms, close_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS j FROM t0), u1 AS (SELECT *, sum(j) OVER (PARTITION BY pair ORDER BY open_ms, close_ms ROWS UNBOUNDED PRECEDING) AS g FROM u0), u AS (SELECT pair, min(open_ms) AS start, max(close_ms) AS \"end\", count(*) AS intervals FROM u1 GROUP BY pair, g)"

OUT = {
    "xsec_robust_z": (xsec_robust_z, f"WITH {NATIONS}, {MAD} SELECT decision_ms, symbol, round(residual, 6) AS residual, round(mad, 6) AS mad, CASE WHEN members >= 3 AND mad > 0 THEN round(residual / (1.4826 * mad), 6) END AS z FROM z"),
    "xsec_loser_events": (xsec_loser_events, f"WITH {NATIONS}, {MAD}, y AS (SELECT *, residual / nullif(1.4826 * mad, 0) AS q FROM z WHERE members >= 3) SELECT decision_ms, symbol, round(q, 6) AS z FROM y WHERE q <= -1.5 AND exp(residual) - 1 <= -0.018 QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY q, symbol) = 1"),
    "xsec_leave_one_out": (xsec_leave_one_out, f"WITH {DAILY}, {LOO} SELECT decision_ms, symbol, round(others_median, 6) AS others_median FROM l"),
    "breadth": (breadth, f"WITH {NATIONS}, {BREADTH} SELECT decision_ms, members, round(rising, 6) AS rising, round(falling, 6) AS falling, round(median, 6) AS median FROM b"),
    "breadth_thrust": (breadth_thrust, f"WITH {NATIONS}, {BREADTH} SELECT decision_ms, members, round(median, 6) AS median FROM b WHERE members >= 5 AND rising >= 0.7 AND median >= 0.2"),
    "stress_leaders": (stress_leaders, f"WITH {NATIONS}, {BREADTH} SELECT decision_ms, symbol, round(value - median, 6) AS residual FROM x JOIN b USING (decision_ms) WHERE members >= 5 AND falling >= 0.6 AND median <= -0.1 AND value - median >= 0.02 QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY value - median DESC, symbol) = 1"),
    "volume_share_ratio": (
        volume_share_ratio,
        f"WITH {DAILY}, s AS (SELECT decision_ms, symbol, quote_volume / sum(quote_volume) OVER (PARTITION BY decision_ms) AS share FROM x) SELECT decision_ms, symbol, round(share, 6) AS share, CASE WHEN count(share) OVER w = 30 THEN round(share / quantile_cont(share, 0.5) OVER w, 6) END AS ratio FROM s WINDOW w AS (PARTITION BY symbol ORDER BY decision_ms ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
    ),
    "borda_rank": (borda_rank, f"WITH {DAILY} SELECT decision_ms, symbol, count(*) OVER (PARTITION BY decision_ms) * 2 + 2 - row_number() OVER (PARTITION BY decision_ms ORDER BY value DESC, symbol) - row_number() OVER (PARTITION BY decision_ms ORDER BY quote_volume DESC, symbol) AS score FROM x"),
    "quartile_membership": (
        quartile_membership,
        f"WITH {NATIONS} SELECT decision_ms, symbol, row_number() OVER (PARTITION BY decision_ms ORDER BY value DESC, symbol) <= (count(*) OVER (PARTITION BY decision_ms) + 3) // 4 AS top, row_number() OVER (PARTITION BY decision_ms ORDER BY value, symbol) <= (count(*) OVER (PARTITION BY decision_ms) + 3) // 4 AS bottom FROM x",
    ),
    "daily_volume_rank": (daily_volume_rank, f"WITH {P} SELECT day_ms AS decision_ms, symbol, row_number() OVER (PARTITION BY day_ms ORDER BY volume, symbol) AS place FROM panel"),
    "liquidity_laggards": (
        liquidity_laggards,
        f"WITH {R}, q AS (SELECT day_ms AS decision_ms, symbol, CASE WHEN row_number() OVER (PARTITION BY day_ms ORDER BY volume, symbol) <= (count(*) OVER (PARTITION BY day_ms) + 3) // 4 THEN 1 ELSE 0 END AS low FROM panel) SELECT decision_ms, symbol, CAST(sum(low) OVER w AS BIGINT) AS days FROM q WINDOW w AS (PARTITION BY symbol ORDER BY decision_ms ROWS 27 PRECEDING) QUALIFY count(*) OVER w = 28 AND sum(low) OVER w >= 16",
    ),
    "corr_breakdown": (
        corr_breakdown,
        f"""WITH {DAILY}, {COMMON}, h AS (SELECT symbol, {MONTH_OF} AS month, day(make_timestamp(decision_ms * 1000)) <= 15 AS early, value AS x, common AS y FROM c),
r AS (SELECT symbol, month, early, CASE WHEN count(*) > 1 AND avg(x * x) - avg(x) * avg(x) > 1e-15 AND avg(y * y) - avg(y) * avg(y) > 1e-15 THEN ({COV}) / sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-300) * greatest(avg(y * y) - avg(y) * avg(y), 1e-300)) END AS r FROM h GROUP BY 1, 2, 3)
SELECT symbol, month, round(max(r) FILTER (early), 6) AS first, round(max(r) FILTER (NOT early), 6) AS second FROM r GROUP BY 1, 2""",
    ),
    "coskewness_half": (
        coskewness_half,
        f"""WITH {DAILY}, {COMMON}, h AS (SELECT symbol, {MONTH_OF} AS month, value - common AS x, common AS y FROM c), m AS (SELECT *, avg(x) OVER (PARTITION BY symbol, month) AS mx, avg(y) OVER (PARTITION BY symbol, month) AS my FROM h)
SELECT symbol, month, count(*) AS n, CASE WHEN avg(pow(x - mx, 2)) > 1e-15 AND avg(pow(y - my, 2)) > 1e-15 THEN round(avg((x - mx) * pow(y - my, 2)) / (sqrt(avg(pow(x - mx, 2))) * avg(pow(y - my, 2))), 5) END AS coskewness FROM m GROUP BY 1, 2""",
    ),
    "cokurtosis_half": (
        cokurtosis_half,
        f"""WITH {DAILY}, {COMMON}, h AS (SELECT symbol, {MONTH_OF} AS month, value - common AS x, common AS y FROM c), m AS (SELECT *, avg(x) OVER (PARTITION BY symbol, month) AS mx, avg(y) OVER (PARTITION BY symbol, month) AS my FROM h)
SELECT symbol, month, count(*) AS n, CASE WHEN avg(pow(x - mx, 2)) > 1e-15 AND avg(pow(y - my, 2)) > 1e-15 THEN round(avg(pow(x - mx, 2) * pow(y - my, 2)) / (avg(pow(x - mx, 2)) * avg(pow(y - my, 2))), 5) END AS cokurtosis FROM m GROUP BY 1, 2""",
    ),
    "capture_ratio": (
        capture_ratio,
        f"WITH {DAILY}, {COMMON}, h AS (SELECT symbol, {MONTH_OF} AS month, value, common FROM c), k AS (SELECT symbol, month, CASE WHEN count(*) FILTER (common > 0) >= 3 THEN sum(common * value) FILTER (common > 0) / sum(common * common) FILTER (common > 0) END AS up, CASE WHEN count(*) FILTER (common < 0) >= 3 THEN sum(common * value) FILTER (common < 0) / sum(common * common) FILTER (common < 0) END AS down FROM h GROUP BY 1, 2) SELECT symbol, month, round(up, 6) AS up, round(down, 6) AS down, round(up - down, 6) AS score FROM k",
    ),
    "tail_energy_half": (
        tail_energy_half,
        f"""WITH {DAILY}, {COMMON}, h AS (SELECT symbol, {MONTH_OF} AS month, value - common AS r FROM c), m AS (SELECT *, r - quantile_cont(r, 0.5) OVER (PARTITION BY symbol, month) AS d FROM h), s AS (SELECT *, 1.4826 * quantile_cont(abs(d), 0.5) OVER (PARTITION BY symbol, month) AS s FROM m),
g AS (SELECT symbol, month, count(*) FILTER (d <= -2 * s) AS tail, sum(d * d) FILTER (d <= -2 * s) AS t, sum(d * d) AS a, max(d * d) FILTER (d <= -2 * s) AS x, max(s) AS s FROM s GROUP BY 1, 2)
SELECT symbol, month, tail, CASE WHEN tail >= 2 AND s > 0 AND a > 0 THEN round(t / a, 6) END AS energy, CASE WHEN tail >= 2 AND s > 0 AND a > 0 THEN round(x / t, 6) END AS dominance FROM g""",
    ),
    "vol_of_vol_half": (
        vol_of_vol_half,
        f"WITH {HOURLY}, b AS (SELECT symbol, decision_ms // {7 * DAY} AS week, decision_ms // {DAY} AS block, sqrt(avg(value * value)) AS rms FROM x GROUP BY 1, 2, 3), m AS (SELECT *, quantile_cont(rms, 0.5) OVER (PARTITION BY symbol, week) AS med FROM b) SELECT symbol, week, count(*) AS blocks, round(1.4826 * quantile_cont(abs(rms - med), 0.5) / nullif(max(med), 0), 6) AS ratio FROM m GROUP BY 1, 2",
    ),
    "weekday_residuals": (weekday_residuals, f"WITH {DAILY}, {COMMON} SELECT symbol, CAST((decision_ms // {DAY} + 3) % 7 AS INTEGER) AS weekday, count(*) AS n, round(quantile_cont(value - common, 0.5), 6) AS median FROM c GROUP BY 1, 2"),
    "lagged_diffusion": (lagged_diffusion, f"WITH {DAILY}, {COMMON}, s AS (SELECT DISTINCT decision_ms + {DAY} AS decision_ms, sign(common) AS way FROM c WHERE abs(common) >= 0.3) SELECT symbol, count(*) AS n, round(quantile_cont(value * way, 0.5), 6) AS median FROM c JOIN s USING (decision_ms) GROUP BY 1"),
    "dispersion_expansion": (
        dispersion_expansion,
        f"WITH {NATIONS}, {MAD}, m AS (SELECT decision_ms, max(mad) AS mad FROM z GROUP BY 1), r AS (SELECT decision_ms, mad, CASE WHEN count(mad) OVER w = 20 THEN mad / nullif(quantile_cont(mad, 0.5) OVER w, 0) END AS ratio FROM m WINDOW w AS (ORDER BY decision_ms ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT decision_ms, round(mad, 6) AS mad, round(ratio, 6) AS ratio FROM r WHERE ratio >= 1.5",
    ),
    "range_expansion": (
        range_expansion,
        f"""WITH {R}, g AS (SELECT *, ln(high / low) AS range FROM panel), h AS (SELECT symbol, day_ms, range, CASE WHEN count(range) OVER w = 42 THEN range / nullif(quantile_cont(range, 0.5) OVER w, 0) END AS ratio, (close - low) / nullif(high - low, 0) AS location, abs(close - open) / nullif(high - low, 0) AS body FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day_ms ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING))
SELECT symbol, day_ms, round(range, 6) AS range, round(ratio, 6) AS ratio, round(location, 6) AS location, round(body, 6) AS body FROM h WHERE ratio >= 1.1 AND location >= 0.8""",
    ),
    "close_location": (
        close_location,
        f"WITH {P}, l AS (SELECT day_ms AS decision_ms, symbol, (close - low) / nullif(high - low, 0) AS location FROM panel), s AS (SELECT *, avg(CASE WHEN location IS NULL THEN NULL WHEN location < 0.5 THEN 1.0 ELSE 0 END) OVER (PARTITION BY decision_ms) AS share, count(*) OVER (PARTITION BY decision_ms) AS members FROM l) SELECT decision_ms, symbol, round(location, 6) AS location FROM s WHERE members >= 5 AND share >= 0.6 AND location >= 0.8",
    ),
    "peak_residuals": (peak_residuals, f"WITH {DAILY}, {LOO} SELECT symbol, {MONTH_OF} AS month, round(max(value - others_median), 6) AS peak FROM l GROUP BY 1, 2"),
    "universe_topk_monthly": (universe_topk_monthly, f"WITH {MEMBERS} SELECT month, symbol, rank, round(median_volume, 6) AS median_volume FROM members"),
    "eligibility_status": (
        eligibility_status,
        f"WITH {VOLUMES}, e AS (SELECT *, eligible AND symbol <> '3' AS o FROM volumes), p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY o DESC, median_volume DESC, symbol) AS n FROM e) SELECT month, symbol, CASE WHEN symbol = '3' THEN 'excluded' WHEN NOT eligible THEN 'short_history' WHEN n > 5 THEN 'ranked_out' ELSE 'member' END AS status FROM p",
    ),
    "universe_entrants": (universe_entrants, f"WITH {MEMBERS} SELECT month, symbol, rank FROM members m WHERE month > (SELECT min(month) FROM members) AND NOT EXISTS (SELECT 1 FROM members b WHERE b.symbol = m.symbol AND b.month = m.month - 1)"),
    "universe_best_entrant": (universe_best_entrant, f"WITH {MEMBERS} SELECT month, symbol, rank FROM members m WHERE month > (SELECT min(month) FROM members) AND NOT EXISTS (SELECT 1 FROM members b WHERE b.symbol = m.symbol AND b.month = m.month - 1) QUALIFY row_number() OVER (PARTITION BY month ORDER BY rank, symbol) = 1"),
    "membership_exits": (membership_exits, f"WITH {MEMBERS} SELECT month, symbol, rank FROM members m WHERE month < (SELECT max(month) FROM members) AND NOT EXISTS (SELECT 1 FROM members b WHERE b.symbol = m.symbol AND b.month = m.month + 1)"),
    "active_member_days": (active_member_days, f"WITH {MEMBERS}, q AS (SELECT symbol, CAST(year(make_timestamp(day_ms * 1000)) * 12 + month(make_timestamp(day_ms * 1000)) - 1 AS INTEGER) AS month FROM panel) SELECT month, count(DISTINCT symbol) AS active, count(*) AS rows FROM q SEMI JOIN members USING (month, symbol) GROUP BY 1"),
    "invalid_interval_events": (invalid_interval_events, f"WITH {QUARANTINE} SELECT month, open_time, active, observed, invalid, missing, verdict FROM slots"),
    "invalid_interval_mask": (invalid_interval_mask, f"WITH {QUARANTINE} SELECT DISTINCT v.symbol, s.open_time FROM slots s JOIN v ON v.month = s.month WHERE verdict = 'event'"),
    "quarantine_panel": (
        quarantine_panel,
        f"WITH {QUARANTINE}, p AS (SELECT symbol, v.month, count(*) AS observed, count(*) FILTER (verdict = 'event') AS masked_slots FROM v JOIN slots s USING (open_time) GROUP BY 1, 2) SELECT symbol, month, observed, masked_slots, observed - masked_slots AS valid, CASE WHEN masked_slots = 0 THEN 'clean' WHEN observed = masked_slots THEN 'quarantined' ELSE 'partial' END AS state FROM p",
    ),
    "masked_bars": (masked_bars, f'WITH {QUARANTINE} SELECT symbol, count(*) AS "left" FROM v JOIN slots USING (open_time) WHERE verdict <> \'event\' GROUP BY 1'),
    "mae_mfe": (mae_mfe, f"WITH {PATH} SELECT symbol, event_ms, round(max(high / entry - 1), 6) AS mfe, round(min(low / entry - 1), 6) AS mae, count(*) = 24 AS complete FROM path GROUP BY 1, 2"),
    "first_recovery": (first_recovery, f"WITH {PATH} SELECT symbol, event_ms, min(slot) FILTER (close >= entry) AS first_recovery FROM path GROUP BY 1, 2"),
    "forward_path_horizons": (forward_path_horizons, f"WITH {PATH} SELECT symbol, event_ms, slot AS horizon, round(close / entry - 1, 6) AS gross, round(close * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1, 6) AS net FROM path WHERE slot IN (1, 4, 8, 24)"),
    "horizon_summary": (
        horizon_summary,
        f"""WITH {PATH}, h AS (SELECT slot AS horizon, close / entry - 1 AS g, close * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1 AS n FROM path WHERE slot IN (1, 4, 8, 24))
SELECT horizon, count(*) AS n, round(avg(g), 6) AS mean, round(quantile_cont(g, 0.5), 6) AS median, round(coalesce(stddev_samp(g), 0), 6) AS deviation, round(avg(CASE WHEN g > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(quantile_cont(g, 0.05), 6) AS p5, round(quantile_cont(g, 0.95), 6) AS p95, round(min(g), 6) AS worst, round(avg(n), 6) AS net_mean FROM h GROUP BY 1""",
    ),
    "relative_paths": (
        relative_paths,
        f"""WITH {EVENTS}, j AS (SELECT e.symbol AS candidate, e.decision_ms AS event_ms, (b.open_time - e.decision_ms) // {HOUR} AS slot, b.symbol, ln(b.close / s.close) AS m FROM ev e JOIN bars b ON b.open_time BETWEEN e.decision_ms + {HOUR} AND e.decision_ms + {6 * HOUR} JOIN bars s ON s.symbol = b.symbol AND s.open_time = e.decision_ms),
g AS (SELECT candidate, event_ms, slot, max(m) FILTER (symbol = candidate) AS own, quantile_cont(m, 0.5) FILTER (symbol <> candidate) AS peers FROM j GROUP BY 1, 2, 3) SELECT candidate, event_ms, slot, round(own, 6) AS own, round(peers, 6) AS peers, round(own - peers, 6) AS relative FROM g WHERE own IS NOT NULL AND peers IS NOT NULL""",
    ),
    "gate_matrix": (
        gate_matrix,
        f"""WITH {EVENTS}, a AS (SELECT count(*) AS events, count(DISTINCT symbol) AS symbols, count(DISTINCT strftime(make_timestamp(decision_ms * 1000), '%Y-%m')) AS months FROM ev), s AS (SELECT max(n) AS t FROM (SELECT count(*) AS n FROM ev GROUP BY symbol)), m AS (SELECT max(n) AS u FROM (SELECT count(*) AS n FROM ev GROUP BY strftime(make_timestamp(decision_ms * 1000), '%Y-%m')))
SELECT events, symbols, months, round(coalesce(t / nullif(events, 0), 0), 6) AS symbol_share, round(coalesce(u / nullif(events, 0), 0), 6) AS month_share, events >= 100 AS enough, coalesce(t / nullif(events, 0), 0) <= 0.4 AS spread_symbols, coalesce(u / nullif(events, 0), 0) <= 0.4 AS spread_months FROM a, s, m""",
    ),
    "payback_threshold": (payback_threshold, f"WITH {B} SELECT symbol, open_time, round(close / 100 * 30 / 365 / 0.005, 6) AS ratio FROM bars"),
    "scenario_cost_returns": (scenario_cost_returns, f"WITH {TRADES}, s(scenario, cost) AS (VALUES ('base', 0.0015::DOUBLE), ('cost_x2', 0.0030), ('stress', 0.0040), ('severe', 0.0055)) SELECT trade_id, scenario, round(close_rate * (1 - cost) / (open_rate * (1 + cost)) - 1, 6) AS net FROM trades, s"),
    "two_leg_pnl": (
        two_leg_pnl,
        f"""WITH {TRADES}, c AS (SELECT trade_id, open_rate AS es, close_rate AS xs, open_rate * 1.001::DOUBLE AS ep, close_rate * 0.999::DOUBLE AS xp, 1000.0::DOUBLE / open_rate AS q FROM trades), p AS (SELECT trade_id, (xs - es) * q AS a, (ep - xp) * q AS b, 0.0003::DOUBLE * xp * q AS f, q * (es + xs + ep + xp) * 0.0015::DOUBLE AS k FROM c)
SELECT trade_id, round(a, 6) AS spot_pnl, round(b, 6) AS perp_pnl, round(f, 6) AS funding_pnl, round(k, 6) AS costs, round(a + b + f - k, 6) AS net_pnl FROM p""",
    ),
    "position_sizes": (
        position_sizes,
        f"""WITH {R}, t AS (SELECT *, row_number() OVER s AS n, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, ln(close / lag(close) OVER s) AS ret FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY day_ms)),
f AS (SELECT symbol, day_ms, close, CASE WHEN n >= 14 THEN avg(tr) OVER w END AS atr, CASE WHEN count(ret) OVER w = 14 THEN stddev_pop(ret) OVER w * sqrt(365.0) END AS vol FROM t WINDOW w AS (PARTITION BY symbol ORDER BY day_ms ROWS 13 PRECEDING))
SELECT symbol, day_ms, round(greatest(0, least(10000 * 0.01 / (2 * atr), 10000 * 0.2 / (vol * close), 8000 / (close * 1.0015))), 6) AS quantity FROM f WHERE atr IS NOT NULL AND vol > 0""",
    ),
    "occupancy_union": (occupancy_union, f"WITH {TRADES}, t0 AS (SELECT trades.* REPLACE (o_custkey AS pair) FROM trades JOIN orders ON trade_id = o_orderkey), {BLOCKS} SELECT * FROM u"),
    "occupancy_summary": (occupancy_summary, f"WITH {TRADES}, t0 AS (SELECT trades.* REPLACE (o_custkey AS pair) FROM trades JOIN orders ON trade_id = o_orderkey), {BLOCKS}, n AS (SELECT *, lead(start) OVER (PARTITION BY pair ORDER BY start) - \"end\" AS gap FROM u) SELECT pair, CAST(sum(\"end\" - start) AS BIGINT) AS occupied, count(*) AS blocks, coalesce(max(gap), 0) AS longest_gap FROM n GROUP BY 1"),
    "max_concurrency": (max_concurrency, f"WITH {TRADES}, e AS (SELECT pair, open_ms AS t, 1 AS d FROM trades UNION ALL SELECT pair, close_ms, -1 FROM trades), n AS (SELECT pair, t, sum(d) AS d FROM e GROUP BY 1, 2), c AS (SELECT pair, sum(d) OVER (PARTITION BY pair ORDER BY t) AS c FROM n) SELECT pair, CAST(max(c) AS BIGINT) AS most FROM c GROUP BY 1"),
    "sleep_periods": (sleep_periods, f"WITH {TRADES}, t0 AS (SELECT trades.* REPLACE (o_custkey AS pair) FROM trades JOIN orders ON trade_id = o_orderkey), {BLOCKS}, n AS (SELECT pair, \"end\" AS sleeps, lead(start) OVER (PARTITION BY pair ORDER BY start) AS wakes FROM u) SELECT *, wakes - sleeps AS duration FROM n WHERE wakes > sleeps"),
    "realised_equity_daily": (realised_equity_daily, f"WITH {EQ} SELECT pair, day, round(pnl, 6) AS pnl, round(10000.0 + gain, 6) AS equity FROM eq"),
    "mtm_equity_daily": (
        mtm_equity_daily,
        f"""WITH {EQ}, {R}, mk AS (SELECT day_ms // {DAY} AS day, max(close) AS close FROM panel WHERE symbol = '0' GROUP BY 1),
fl AS (SELECT t.pair, mk.day, sum(stake * (mk.close / open_rate - 1)) AS f, count(*) AS k FROM trades t JOIN mk ON mk.day >= open_ms // {DAY} AND mk.day < close_ms // {DAY} GROUP BY 1, 2) SELECT pair, day, round(10000.0 + gain + coalesce(f, 0), 3) AS equity, coalesce(k, 0) AS open_trades FROM eq LEFT JOIN fl USING (pair, day)""",
    ),
    "drawdown_curve": (drawdown_curve, f"WITH {EQ}, e AS (SELECT pair, day, 1000000.0 + gain AS equity FROM eq), f AS (SELECT pair, day, equity / max(equity) OVER (PARTITION BY pair ORDER BY day) - 1 AS dd FROM e) SELECT pair, day, CASE WHEN dd < -5e-7 THEN round(dd, 6) ELSE 0 END AS drawdown FROM f"),
    "curve_metrics": (
        curve_metrics,
        f"""WITH {EQ}, e AS (SELECT pair, day, 1000000.0 + gain AS equity FROM eq), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM e WINDOW w AS (PARTITION BY pair ORDER BY day)),
c AS (SELECT *, r - avg(r) OVER (PARTITION BY pair) AS d FROM r), a AS (SELECT pair, arg_min(equity, day) AS f, arg_max(equity, day) AS l, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(pow(least(r, 0), 2)) FILTER (r IS NOT NULL)) AS ds, min(dd) AS dd, avg(d * d) AS v, avg(d * d * d) AS t, avg(d * d * d * d) AS q FROM c GROUP BY 1)
SELECT pair, n, round(l / f - 1, 5) AS total_return, round(pow(l / f, 365.0 / n) - 1, 5) AS cagr, round(m / s * sqrt(365), 5) AS sharpe, round(m / ds * sqrt(365), 5) AS sortino, round(-dd, 5) AS max_drawdown, round((pow(l / f, 365.0 / n) - 1) / -dd, 5) AS calmar, round(t / pow(v, 1.5), 5) AS skew, round(q / (v * v), 5) AS kurtosis FROM a""",
    ),
    "curve_metrics_psr": (curve_metrics_psr, None),
    "trade_metrics": (
        trade_metrics,
        f"""WITH {TRADES} SELECT pair, count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(sum(greatest(pnl, 0)), 6) AS gains, round(sum(greatest(-pnl, 0)), 6) AS losses, round(CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) ELSE 'Infinity'::DOUBLE END, 6) AS profit_factor, round(avg(pnl), 6) AS mean_pnl,
 round(quantile_cont((close_ms - open_ms) / {DAY}, 0.5), 6) AS median_days, round(quantile_cont((close_ms - open_ms) / {DAY}, 0.95), 6) AS p95_days FROM trades GROUP BY 1""",
    ),
    "concentration_hhi": (concentration_hhi, f"WITH {TRADES}, w AS (SELECT pair, pnl, row_number() OVER (PARTITION BY pair ORDER BY pnl DESC, trade_id) AS n FROM trades WHERE pnl > 0) SELECT pair, round(sum(pnl), 6) AS gains, round(sum(pnl) FILTER (n <= 3) / sum(pnl), 6) AS top3, round(sum(pnl * pnl) / (sum(pnl) * sum(pnl)), 6) AS hhi FROM w GROUP BY 1"),
    "delete_best_three": (delete_best_three, f"WITH {TRADES}, w AS (SELECT pair, pnl, row_number() OVER (PARTITION BY pair ORDER BY pnl DESC, trade_id) AS n FROM trades) SELECT pair, count(*) AS trades, round(sum(pnl), 6) AS pnl FROM w WHERE n > 3 GROUP BY 1"),
    "losing_streak": (
        losing_streak,
        f"WITH {TRADES}, r AS (SELECT pair, pnl < 0 AS l, row_number() OVER (PARTITION BY pair ORDER BY close_ms, trade_id) - row_number() OVER (PARTITION BY pair, pnl < 0 ORDER BY close_ms, trade_id) AS g FROM trades), n AS (SELECT pair, count(*) AS n FROM r WHERE l GROUP BY pair, g) SELECT p.pair, coalesce(max(n), 0) AS losing_streak FROM (SELECT DISTINCT pair FROM trades) p LEFT JOIN n USING (pair) GROUP BY 1",
    ),
    "segment_returns": (segment_returns, f"WITH {TRADES}, e AS (SELECT pair, min(open_ms) AS a, max(open_ms) AS b FROM trades GROUP BY 1) SELECT pair, CAST(least((open_ms - a) * 4 // greatest(b - a, 1), 3) AS INTEGER) AS part, round(sum(pnl) / 10000, 5) AS part_return, count(*) AS trades FROM trades JOIN e USING (pair) GROUP BY 1, 2"),
    "cost_attribution": (cost_attribution, f"WITH {TRADES} SELECT pair, round(sum((stake + stake * close_rate / open_rate) * 0.001), 4) AS fees, round(sum((stake + stake * close_rate / open_rate) * 0.0005), 4) AS slippage FROM trades GROUP BY 1"),
    "combined_curve": (combined_curve, f"WITH {EQ}, e AS (SELECT pair, day, 1000000.0 + gain AS equity FROM eq), f AS (SELECT *, equity / first_value(equity) OVER (PARTITION BY pair ORDER BY day) AS x FROM e) SELECT day, round(avg(x), 6) AS equity FROM f GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT pair) FROM e)"),
    "bollinger_reentry": (
        bollinger_reentry,
        f"""WITH {B}, k AS (SELECT symbol, open_time, close, CASE WHEN count(*) OVER w = 24 THEN avg(close) OVER w - 2 * stddev_pop(close) OVER w END AS lo, CASE WHEN count(*) OVER w = 24 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END AS hi FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 23 PRECEDING)),
x AS (SELECT *, coalesce(close > lo AND lag(close) {WT}) <= lag(lo) {WT}), false) AS enters, coalesce(close < hi AND lag(close) {WT}) >= lag(hi) {WT}), false) AS leaves FROM k) SELECT symbol, open_time, round(lo, 4) AS low_band, round(hi, 4) AS high_band, enters, leaves FROM x WHERE enters OR leaves""",
    ),
    "donchian_place": (
        donchian_place,
        f"""WITH {B}, n AS (SELECT *, row_number() {WT}) AS n FROM bars) SELECT symbol, open_time, CASE WHEN n >= 24 THEN round((close - min(low) {WT} ROWS 23 PRECEDING)) / nullif(max(high) {WT} ROWS 23 PRECEDING) - min(low) {WT} ROWS 23 PRECEDING), 0), 5) END AS place,
 CASE WHEN n >= 20 THEN round((avg((4 * high - 2 * low + close) / 3) {WT} ROWS 19 PRECEDING) - avg((-2 * high + 4 * low + close) / 3) {WT} ROWS 19 PRECEDING)) / avg((high + low + close) / 3) {WT} ROWS 19 PRECEDING) * 100, 5) END AS width FROM n""",
    ),
    "money_flow_index": (
        money_flow_index,
        f"""WITH {B}, t AS (SELECT *, row_number() {WT}) AS n, (high + low + close) / 3 AS p FROM bars), g AS (SELECT *, lag(p) {WT}) AS b FROM t), f AS (SELECT symbol, open_time, n, sum(CASE WHEN p > b THEN p * volume ELSE 0 END) {WT} ROWS 13 PRECEDING) AS u, sum(CASE WHEN p < b THEN p * volume ELSE 0 END) {WT} ROWS 13 PRECEDING) AS v FROM g)
SELECT symbol, open_time, CASE WHEN n > 14 THEN round(CASE WHEN u + v = 0 THEN 50 ELSE 100 * u / (u + v) END, 5) END AS mfi FROM f""",
    ),
    "commodity_channel_index": (
        commodity_channel_index,
        f"WITH {B}, t AS (SELECT *, (high + low + close) / 3 AS p FROM bars), m AS (SELECT symbol, open_time, p, list(p) {WT} ROWS 19 PRECEDING) AS l FROM t) SELECT symbol, open_time, CASE WHEN len(l) = 20 THEN round((p - list_avg(l)) / nullif(0.015 * list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))), 0), 5) END AS cci FROM m",
    ),
    "sma_cross": (
        sma_cross,
        f"WITH {B}, m AS (SELECT symbol, open_time, CASE WHEN row_number() {WT}) >= 5 THEN avg(close) {WT} ROWS 4 PRECEDING) END AS f, CASE WHEN row_number() {WT}) >= 20 THEN avg(close) {WT} ROWS 19 PRECEDING) END AS s FROM bars) SELECT symbol, open_time FROM m QUALIFY f > s AND lag(f) {WT}) <= lag(s) {WT})",
    ),
    "recursive_indicators": (recursive_indicators, None),
    "ema_family": (
        ema_family,
        f"WITH RECURSIVE {B}, n AS (SELECT symbol, open_time, close, row_number() {WT}) AS n FROM bars), e AS (SELECT symbol, n, open_time, close AS ema FROM n WHERE n = 1 UNION ALL SELECT n.symbol, n.n, n.open_time, 2.0 / 21 * n.close + (1 - 2.0 / 21) * e.ema FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1) SELECT symbol, open_time, round(ema, 6) AS ema FROM e",
    ),
    "trend_backtest_equity": (trend_backtest_equity, None),
    "policy_benchmark": (policy_benchmark, None),
    "conservative_reprice": (
        conservative_reprice,
        f"""WITH {EVENTS}, j AS (SELECT e.symbol, e.decision_ms AS event_ms, b.open_time, (b.open_time - e.decision_ms) // {HOUR} AS slot, b.open, b.high, b.low, b.close, n.open AS entry FROM ev e JOIN bars n ON n.symbol = e.symbol AND n.open_time = e.decision_ms + {HOUR} JOIN bars b ON b.symbol = e.symbol AND b.open_time BETWEEN e.decision_ms + {HOUR} AND e.decision_ms + {24 * HOUR}),
k AS (SELECT *, CASE WHEN low <= entry * 0.7 THEN 'stop' WHEN high >= entry * 1.5 THEN 'target' WHEN slot = 24 THEN 'timeout' END AS reason FROM j), x AS (SELECT * FROM k WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, event_ms ORDER BY slot) = 1)
SELECT symbol, event_ms, slot, reason, round(entry, 6) AS entry, round(CASE reason WHEN 'stop' THEN least(open, entry * 0.7) WHEN 'target' THEN entry * 1.5 ELSE close END, 6) AS exit_price FROM x""",
    ),
    "param_grid": (param_grid, f"WITH {HOURLY}, f(fall) AS (VALUES (0.5::DOUBLE), (1.0), (1.5)), r(rise) AS (VALUES (0.5::DOUBLE), (1.0), (2.0)) SELECT fall, rise, count(*) FILTER (value <= -fall OR value >= rise) AS hits FROM x, f, r GROUP BY 1, 2"),
}
