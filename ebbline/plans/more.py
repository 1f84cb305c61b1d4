"""Queries on registries, availability, confirmations, splits, diagnostics and rule-based signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbline.functions.hashing import checksum_of, row_sha256
from ebbline.operators import asof, cross, funding, indicators, metrics, paths, reconcile, registry, rolling, universe
from ebbline.plans.markets import EQ, MEMBERS, PATH, QUARANTINE, _events, _path, _quarantine, _volumes
from ebbline.plans.series import REGION, _r
from ebbline.sources.tables import DAY, HOUR, TICKS, TRADES, bars, bars_sql, panel, panel_sql, ticks, trades

B, R = bars_sql(), panel_sql(REGION)
W = "OVER (PARTITION BY symbol ORDER BY open_time"


def _copies(spark, d):
    t = ticks(spark, d).select("symbol", "ts_ms", F.format_string("%.2f", "price").alias("v"), "id")
    more = t.filter("id % 4 = 0").union(t.filter("id % 8 = 0").select("symbol", "ts_ms", F.concat("v", F.lit("9")), "id"))
    return t.union(more).select("symbol", "ts_ms", "v", "id")


def row_resolutions(spark, d):
    rows = _copies(spark, d)
    # one rule for a key, whatever the number of its ticks: the last tick decides whether there is one, and the smallest plain text stays
    last = rows.groupBy("symbol", "ts_ms").agg(F.max("id").alias("id"), F.min(F.when(F.col("v").like("%.__"), F.col("v"))).alias("v"))
    rules = last.filter("id % 16 = 0").select("symbol", "ts_ms", row_sha256("v").alias("keep_sha256"))
    return registry.resolve(rows.select("symbol", "ts_ms", "v"), rules, ["symbol", "ts_ms"], ["v"])


def lifecycle_claims(spark, d):
    rows = bars(spark, d).select("symbol", "open_time")
    ends = rows.groupBy("symbol").agg(F.max("open_time").alias("m")).select("symbol", (F.col("m") - 5 * DAY).alias("end_ms")).filter("symbol <> 'view'")
    known = rows.filter(f"(open_time / {HOUR}) % 100 = 7")
    return registry.claims(rows, known, ends).groupBy("symbol", "claim").agg(F.count("*").alias("rows"))


def active_universe_states(spark, d):
    rows, members = _quarantine(spark, d)
    slots = rows.select("month", "open_time").distinct()
    ends = rows.groupBy("symbol").agg((F.min("open_time") + 2 * DAY).alias("start_ms"), (F.max("open_time") - 2 * DAY).alias("end_ms"))
    return registry.availability(members, slots, rows.filter("NOT valid"), ends)


def cross_confirmations(spark, d):
    made = bars(spark, d)
    one = lambda s: made.filter(F.col("symbol") == s).select(F.lit("x").alias("symbol"), "open_time", "open", "high", "low", "close")
    return registry.confirmations(one("click"), [one("view"), one("error"), one("signup")])


def best_reports(spark, d):
    made = bars(spark, d).groupBy("symbol", F.floor(F.col("open_time") / DAY).cast("long").alias("day")).agg(F.count("*").alias("rows"), (F.max("open_time") - F.min("open_time")).alias("span"))
    return registry.best_reports(made, "symbol", ["rows", "span"], "day")


def merged_plans(spark, d):
    made = ticks(spark, d).select("symbol", F.floor(F.col("ts_ms") / DAY).cast("long").alias("day"), F.when(F.col("price") > 200, "large").when(F.col("price") < 5, "small").otherwise("plain").alias("reason"), (F.col("price") > 300).alias("passed"))
    return registry.merged_plans(made, ["symbol", "day"])


def scope_selection(spark, d):
    p = panel(spark, d, REGION).withColumn("month_index", universe.month_index("day_ms"))
    made = p.groupBy("symbol", "month_index").agg(F.max(F.round((F.col("high") - F.col("low")) / F.col("open"), 6)).alias("amplitude"), (F.when(F.count("*") < 25, 1).otherwise(0)).alias("missing"))
    return registry.select_scopes(made)


def decision_ceiling(spark, d):
    return registry.eligible_ceiling(bars(spark, d), HOUR, 24, 12)


def equity_window(spark, d):
    made = metrics.daily_equity(trades(spark, d), 10_000.0)
    return _r(registry.step_window(made, 10_300, 10_400), "equity")


def sample_split(spark, d):
    made = registry.split(panel(spark, d, REGION), ["day_ms"])
    return made.groupBy("symbol", "sample").agg(F.count("*").alias("n"), F.min("day_ms").alias("first_ms"))


def path_prefix(spark, d):
    return registry.contiguous_prefix(_path(spark, d))


def entry_cooldown(spark, d):
    t = trades(spark, d)
    return registry.cooldown(t.select("trade_id", "open_ms"), t.filter("pnl < -95").select("close_ms"), 2 * DAY)


def membership_diff(spark, d):
    a, b = universe.membership(_volumes(spark, d), 5), universe.membership(_volumes(spark, d), 7).filter("rank <> 3")
    return reconcile.membership_changes(a.select("month", "symbol"), b.select("month", "symbol"))


def market_diagnostics(spark, d):
    """Spread between a symbol's ticks and the last hourly close of another before them."""
    t, b = ticks(spark, d), bars(spark, d)
    marks = b.filter("symbol = 'view'").select(F.lit("x").alias("k"), (F.col("open_time") + HOUR - 1).alias("t"), "close")
    points = t.filter("symbol = 'click'").select(F.lit("x").alias("k"), "ts_ms", "price")
    made = asof.backward(points, marks, "k", "ts_ms", "t", "close")
    spread = F.abs(F.col("price") / F.col("as_of_close") - 1)
    return _r(made.agg(F.count("*").alias("points"), F.count_if(F.col("as_of_close").isNull()).alias("missing"), F.avg(spread).alias("mean_spread"), F.max(spread).alias("max_spread")), "mean_spread", "max_spread", places=5)


def funding_contributions(spark, d):
    """Income of each settlement at the last mark."""
    t, b = ticks(spark, d), bars(spark, d)
    marks = b.select("symbol", (F.col("open_time") + HOUR - 1).alias("t"), "close")
    points = t.select("symbol", "ts_ms", "id", (F.col("price") / 1e5).alias("rate"))
    made = asof.backward(points, marks, "symbol", "ts_ms", "t", "close")
    return _r(made.filter("as_of_close IS NOT NULL").select("id", (F.col("as_of_close") * 2.0 * F.col("rate")).alias("income")), "income", places=8)


def crowding_by_bar(spark, d):
    """Bars of days on which the daily maximum has been high for some days."""
    crowded = funding.crowded_days(ticks(spark, d), "price", 200.0, 3)
    made = bars(spark, d).withColumn("day", F.floor(F.col("open_time") / DAY).cast("long"))
    return made.join(crowded.select("symbol", "day", F.lit(True).alias("c")), ["symbol", "day"], "left").groupBy("symbol", "day").agg(F.count("*").alias("bars"), F.coalesce(F.bool_or("c"), F.lit(False)).alias("crowded"))


def synchronized_windows(spark, d):
    """Slots at which most members are invalid, and who isn't."""
    rows, members = _quarantine(spark, d)
    made = rows.groupBy("open_time").agg(F.count_if(~F.col("valid")).alias("invalid"), F.count("*").alias("active"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("symbol")))), ",").alias("complement"))
    return made.filter("invalid >= 2 AND invalid >= 0.8 * active")


def row_hashes(spark, d):
    return ticks(spark, d).select("id", row_sha256("symbol", "ts_ms", "id").alias("sha"))


def checksum_lines(spark, d):
    lines = ticks(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.sha2(F.col("symbol"), 256), F.lit("  file.zip"))).otherwise(F.col("symbol")).alias("text"))
    return lines.select("id", checksum_of(F.col("text")).alias("sha"))


def rotation_signals(spark, d):
    """Once a week the region with the stronger 20-day return, if it is positive."""
    made = panel(spark, d, REGION).withColumn("strength", F.col("close") / F.lag("close", 20).over(Window.partitionBy("symbol").orderBy("day_ms")) - 1)
    sundays = made.filter((F.pmod(F.floor(F.col("day_ms") / DAY) + 3, F.lit(7)) == 6) & F.col("symbol").isin("0", "1") & F.col("strength").isNotNull())
    ranked = cross.leaders(sundays.select(F.col("day_ms").alias("decision_ms"), "symbol", "strength"), "strength")
    return _r(ranked.filter("strength > 0"), "strength")


def power_tower(spark, d):
    """Closes above powers of the closes some bars before."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    past = lambda k: F.pow(F.lag("close", k).over(w), F.lit(0.95))
    made = bars(spark, d).withColumn("hit", F.coalesce((F.col("close") > past(2)) & (F.col("close") > past(3)) & (F.col("close") > past(4)), F.lit(False)))
    return made.filter("hit").select("symbol", "open_time")


def stochastic_fast(spark, d):
    made = bars(spark, d).withColumn("k", indicators.channel_place(5) * 100)
    frame = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-2, 0)
    return _r(made.select("symbol", "open_time", "k", F.when(F.count("k").over(frame) == 3, F.avg("k").over(frame)).alias("d")), "k", "d", places=5)


def volume_multiple(spark, d):
    made = bars(spark, d).withColumn("base", rolling.full(F.col("volume"), F.avg, -20, -1))
    return _r(made.filter("volume > 2 * base").select("symbol", "open_time", "volume", "base"), "volume", "base", places=4)


def segment_metrics(spark, d):
    """Return of each year of each pair's equity."""
    made = metrics.daily_equity(trades(spark, d), 10_000.0).withColumn("year", F.year(F.date_from_unix_date(F.col("day").cast("int"))))
    out = made.groupBy("pair", "year").agg(F.min_by("equity", "day").alias("a"), F.max_by("equity", "day").alias("b"), F.count("*").alias("days"))
    return _r(out.select("pair", "year", "days", (F.col("b") / F.col("a") - 1).alias("gain")), "gain")


def sample_budget(spark, d):
    made = _events(spark, d).agg(F.count("*").alias("events"), ((F.max("decision_ms") - F.min("decision_ms")) / DAY).alias("days"))
    rate = F.try_divide("events", "days")
    return made.select("events", F.floor(rate * 365).alias("per_year"), F.floor(rate * 540).alias("later"), (F.floor(rate * 540) >= 30).alias("enough"))


def horizon_share_positive(spark, d):
    made = paths.horizons(_path(spark, d), [1, 24], 0.003)
    return _r(made.groupBy(F.col("horizon").cast("long").alias("horizon")).agg(F.avg((F.col("net") > 0).cast("double")).alias("positive"), F.count("*").alias("n")), "positive")


OUT = {
    "row_resolutions": (
        row_resolutions,
        f"""WITH {TICKS}, b AS (SELECT symbol, ts_ms, printf('%.2f', price) AS v, id FROM ticks), r AS (SELECT symbol, ts_ms, v, id FROM b UNION ALL SELECT * FROM b WHERE id % 4 = 0 UNION ALL SELECT symbol, ts_ms, v || '9', id FROM b WHERE id % 8 = 0),
g AS (SELECT symbol, ts_ms, count(*) AS n, count(DISTINCT v) AS k, min(v) AS first, max(id) AS id, min(v) FILTER (length(split_part(v, '.', 2)) = 2) AS plain FROM r GROUP BY 1, 2)
SELECT symbol, ts_ms, n, CASE WHEN k = 1 AND n = 1 THEN 'single' WHEN k = 1 THEN 'collapsed' WHEN id % 16 = 0 THEN 'replaced' ELSE 'blocked' END AS outcome, CASE WHEN k = 1 THEN first WHEN id % 16 = 0 THEN plain END AS v FROM g""",
    ),
    "lifecycle_claims": (
        lifecycle_claims,
        f"WITH {B}, e AS (SELECT symbol, max(open_time) - {5 * DAY} AS e FROM bars WHERE symbol <> 'view' GROUP BY 1) SELECT symbol, CASE WHEN (open_time // {HOUR}) % 100 = 7 THEN 'registered' WHEN open_time >= e THEN 'after_end' ELSE 'free' END AS claim, count(*) AS rows FROM bars LEFT JOIN e USING (symbol) GROUP BY 1, 2",
    ),
    "active_universe_states": (
        active_universe_states,
        f"""WITH {QUARANTINE}, e AS (SELECT symbol, min(open_time) + {2 * DAY} AS a, max(open_time) - {2 * DAY} AS b FROM v GROUP BY 1), mm AS (SELECT DISTINCT month, symbol FROM v), ss AS (SELECT DISTINCT month, open_time FROM v),
j AS (SELECT ss.month, ss.open_time, CASE WHEN v.valid = false THEN 'q' WHEN ss.open_time < a THEN 'n' WHEN ss.open_time >= b THEN 't' ELSE 'a' END AS st FROM ss JOIN mm USING (month) JOIN e USING (symbol) LEFT JOIN v ON v.symbol = mm.symbol AND v.open_time = ss.open_time)
SELECT month, open_time, count(*) FILTER (st = 'a') AS active, count(*) FILTER (st = 'n') AS not_yet, count(*) FILTER (st = 't') AS terminated, count(*) FILTER (st = 'q') AS quarantined FROM j GROUP BY 1, 2""",
    ),
    "cross_confirmations": (
        cross_confirmations,
        f"""WITH {B}, f AS (SELECT symbol AS s, open_time, sign(close - open) AS w FROM bars WHERE (high - low) / greatest(abs(open), 1e-18) >= 0.3), c AS (SELECT a.open_time, count(b.s) AS confirmed FROM f a LEFT JOIN f b ON a.open_time = b.open_time AND a.w = b.w AND b.s IN ('view', 'error', 'signup') WHERE a.s = 'click' GROUP BY 1)
SELECT 'x' AS symbol, open_time, confirmed, CASE WHEN confirmed >= 2 THEN 'explained_market_move' ELSE 'unresolved' END AS finding FROM c""",
    ),
    "best_reports": (best_reports, f"WITH {B}, r AS (SELECT symbol, open_time // {DAY} AS day, count(*) AS rows, max(open_time) - min(open_time) AS span FROM bars GROUP BY 1, 2) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rows DESC, span DESC, day) = 1"),
    "merged_plans": (merged_plans, f"WITH {TICKS}, r AS (SELECT symbol, ts_ms // {DAY} AS day, CASE WHEN price > 200 THEN 'large' WHEN price < 5 THEN 'small' ELSE 'plain' END AS reason, price > 300 AS passed FROM ticks) SELECT symbol, day, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, bool_or(passed) AS passed FROM r GROUP BY 1, 2"),
    "scope_selection": (
        scope_selection,
        f"""WITH {R}, m AS (SELECT symbol, CAST(year(make_timestamp(day_ms * 1000)) * 12 + month(make_timestamp(day_ms * 1000)) - 1 AS INTEGER) AS month_index, max(round((high - low) / open, 6)) AS amp, count(*) < 25 AS missing FROM panel GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month_index) AS n, count(*) OVER (PARTITION BY symbol) AS t, row_number() OVER (PARTITION BY symbol ORDER BY amp DESC, month_index) AS s FROM m),
o AS (SELECT symbol, month_index, concat_ws(',', CASE WHEN n = 1 THEN 'first' END, CASE WHEN n = t THEN 'last' END, CASE WHEN n = (t + 1) // 2 THEN 'middle' END, CASE WHEN missing THEN 'missing' END, CASE WHEN s = 1 THEN 'stress' END) AS reasons FROM n) SELECT * FROM o WHERE reasons <> ''""",
    ),
    "decision_ceiling": (decision_ceiling, f"WITH {B} SELECT symbol, open_time FROM bars QUALIFY count(*) {W} RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) = 25 AND count(*) {W} RANGE BETWEEN CURRENT ROW AND {12 * HOUR} FOLLOWING) = 13"),
    "equity_window": (
        equity_window,
        f"WITH {EQ}, e AS (SELECT pair, day, 10000.0 + gain AS equity FROM eq) SELECT pair, day, round(max(equity), 6) AS equity FROM (SELECT * FROM e WHERE day BETWEEN 10300 AND 10400 UNION ALL SELECT pair, 10300, arg_max(equity, day) FROM e WHERE day <= 10300 GROUP BY pair UNION ALL SELECT pair, 10400, arg_max(equity, day) FROM e WHERE day <= 10400 GROUP BY pair) GROUP BY 1, 2",
    ),
    "sample_split": (
        sample_split,
        f"WITH {R}, n AS (SELECT symbol, day_ms, row_number() OVER (PARTITION BY symbol ORDER BY day_ms) AS n, count(*) OVER (PARTITION BY symbol) AS t FROM panel) SELECT symbol, CASE WHEN n <= greatest(1, least(floor(t * (1 - 0.3::DOUBLE)), t - 1)) THEN 'in_sample' ELSE 'out_of_sample' END AS sample, count(*) AS n, min(day_ms) AS first_ms FROM n GROUP BY 1, 2",
    ),
    "path_prefix": (path_prefix, f"WITH {PATH}, n AS (SELECT symbol, event_ms, slot, row_number() OVER (PARTITION BY symbol, event_ms ORDER BY slot) AS n FROM path) SELECT symbol, event_ms, count(*) FILTER (slot = n) AS prefix, count(*) AS seen FROM n GROUP BY 1, 2"),
    "entry_cooldown": (entry_cooldown, f"WITH {TRADES} SELECT trade_id, open_ms FROM trades t WHERE NOT EXISTS (SELECT 1 FROM trades c WHERE c.pnl < -95 AND c.close_ms <= t.open_ms AND c.close_ms > t.open_ms - {2 * DAY})"),
    "membership_diff": (
        membership_diff,
        f"WITH {MEMBERS}, other AS (SELECT month, symbol, row_number() OVER (PARTITION BY month ORDER BY median_volume DESC, symbol) AS k FROM volumes WHERE eligible QUALIFY k <= 7 AND k <> 3) SELECT coalesce(a.month, b.month) AS month, coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'added' ELSE 'removed' END AS change FROM members a FULL JOIN other b ON a.month = b.month AND a.symbol = b.symbol WHERE a.symbol IS NULL OR b.symbol IS NULL",
    ),
    "market_diagnostics": (
        market_diagnostics,
        f"WITH {B}, m AS (SELECT open_time + {HOUR - 1} AS t, close FROM bars WHERE symbol = 'view'), j AS (SELECT k.price, m.close FROM (SELECT * FROM ticks WHERE symbol = 'click') k ASOF LEFT JOIN m ON k.ts_ms >= m.t) SELECT count(*) AS points, count(*) FILTER (close IS NULL) AS missing, round(avg(abs(price / close - 1)), 5) AS mean_spread, round(max(abs(price / close - 1)), 5) AS max_spread FROM j",
    ),
    "funding_contributions": (funding_contributions, f"WITH {B}, m AS (SELECT symbol, open_time + {HOUR - 1} AS t, close FROM bars) SELECT id, round(close * 2 * (price / 1e5), 8) AS income FROM ticks k ASOF JOIN m ON k.symbol = m.symbol AND k.ts_ms >= m.t"),
    "crowding_by_bar": (
        crowding_by_bar,
        f"WITH {B}, p AS (SELECT symbol, ts_ms // {DAY} AS day, max(price) AS m FROM ticks GROUP BY 1, 2), r AS (SELECT symbol, day, day - row_number() OVER (PARTITION BY symbol ORDER BY day) AS g FROM p WHERE m > 200), s AS (SELECT symbol, day FROM r QUALIFY row_number() OVER (PARTITION BY symbol, g ORDER BY day) >= 3) SELECT b.symbol, b.open_time // {DAY} AS day, count(*) AS bars, bool_or(s.day IS NOT NULL) AS crowded FROM bars b LEFT JOIN s ON s.symbol = b.symbol AND s.day = b.open_time // {DAY} GROUP BY 1, 2",
    ),
    "synchronized_windows": (synchronized_windows, f"WITH {QUARANTINE} SELECT open_time, count(*) FILTER (NOT valid) AS invalid, count(*) AS active, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (valid), '') AS complement FROM v GROUP BY 1 HAVING count(*) FILTER (NOT valid) >= 2 AND count(*) FILTER (NOT valid) >= 0.8 * count(*)"),
    "row_hashes": (row_hashes, f"WITH {TICKS} SELECT id, sha256(symbol || chr(31) || ts_ms || chr(31) || id) AS sha FROM ticks"),
    "checksum_lines": (checksum_lines, f"WITH {TICKS} SELECT id, CASE WHEN id % 2 = 0 THEN sha256(symbol) END AS sha FROM ticks"),
    "rotation_signals": (
        rotation_signals,
        f"WITH {R}, s AS (SELECT symbol, day_ms AS decision_ms, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY day_ms) - 1 AS x FROM panel), t AS (SELECT * FROM s WHERE (decision_ms // {DAY} + 3) % 7 = 6 AND symbol IN ('0', '1') AND x IS NOT NULL), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY x DESC, symbol) = 1) SELECT decision_ms, symbol, round(x, 6) AS strength FROM u WHERE x > 0",
    ),
    "power_tower": (power_tower, f"WITH {B} SELECT symbol, open_time FROM bars QUALIFY close > pow(lag(close, 2) {W}), 0.95) AND close > pow(lag(close, 3) {W}), 0.95) AND close > pow(lag(close, 4) {W}), 0.95)"),
    "stochastic_fast": (
        stochastic_fast,
        f"WITH {B}, k AS (SELECT symbol, open_time, CASE WHEN row_number() {W}) >= 5 THEN (close - min(low) {W} ROWS 4 PRECEDING)) / nullif(max(high) {W} ROWS 4 PRECEDING) - min(low) {W} ROWS 4 PRECEDING), 0) * 100 END AS k FROM bars) SELECT symbol, open_time, round(k, 5) AS k, CASE WHEN count(k) {W} ROWS 2 PRECEDING) = 3 THEN round(avg(k) {W} ROWS 2 PRECEDING), 5) END AS d FROM k",
    ),
    "volume_multiple": (volume_multiple, f"WITH {B}, b AS (SELECT symbol, open_time, volume, CASE WHEN row_number() {W}) > 20 THEN avg(volume) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS base FROM bars) SELECT symbol, open_time, round(volume, 4) AS volume, round(base, 4) AS base FROM b WHERE volume > 2 * base"),
    "segment_metrics": (segment_metrics, f"WITH {EQ}, e AS (SELECT pair, day, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, 10000.0 + gain AS equity FROM eq) SELECT pair, CAST(year AS INTEGER) AS year, count(*) AS days, round(arg_max(equity, day) / arg_min(equity, day) - 1, 6) AS gain FROM e GROUP BY 1, 2"),
    "sample_budget": (
        sample_budget,
        f"WITH {B}, e AS (SELECT count(*) AS events, (max(open_time) - min(open_time)) / {DAY} AS days FROM bars WHERE close <= 0.5 * open) SELECT events, CAST(floor(events / nullif(days, 0) * 365) AS BIGINT) AS per_year, CAST(floor(events / nullif(days, 0) * 540) AS BIGINT) AS later, floor(events / nullif(days, 0) * 540) >= 30 AS enough FROM e",
    ),
    "horizon_share_positive": (horizon_share_positive, f"WITH {PATH} SELECT slot AS horizon, round(avg(CASE WHEN close * (1 - 0.003) / (entry * (1 + 0.003)) - 1 > 0 THEN 1.0 ELSE 0 END), 6) AS positive, count(*) AS n FROM path WHERE slot IN (1, 24) GROUP BY 1"),
}
