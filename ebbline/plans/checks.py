"""Queries of checks on curves, registries, months and events, and of cycles' value over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbline.operators import metrics, rolling, universe, validation
from ebbline.plans.markets import EQ, MEMBERS, QUARANTINE, _quarantine, _volumes
from ebbline.plans.series import REGION, _r
from ebbline.sources.tables import DAY, HOUR, TICKS, TRADES, TWO_SOURCES, bars, bars_sql, panel, panel_sql, ticks, trades, two_sources

B, R, N = bars_sql(), panel_sql(REGION), panel_sql()


def feature_violations(spark, d):
    """Ticks as decisions on their own hour's bar, which is known only when the hour is over."""
    made = ticks(spark, d).select("symbol", "id", "ts_ms", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR)) + HOUR - 1).alias("known_ms"))
    return validation.looks_ahead(made, "known_ms", "ts_ms").groupBy("symbol").agg(F.count("*").alias("violations"))


def curve_validity(spark, d):
    return validation.curve_errors(metrics.daily_equity(trades(spark, d), 10_000.0))


def _by_step(spark, d, step):
    b = bars(spark, d, step).withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("open_time")) - 1)
    peak = F.max("close").over(Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0))
    made = b.withColumn("fall", 1 - F.col("close") / peak)
    out = made.groupBy("symbol").agg(F.count_if(F.col("ret") > 0).alias("trades"), (F.avg("ret") / F.stddev("ret")).alias("sharpe"), F.max("fall").alias("drawdown"), (F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1).alias("gain"))
    return out.withColumn("gate", F.col("gain") > 0)


def granularity_check(spark, d):
    return _r(validation.granularity(_by_step(spark, d, HOUR), _by_step(spark, d, 2 * HOUR), "symbol"), "trades", "sharpe", "drawdown", "ending")


def _exclusions(spark, d):
    days = panel(spark, d).groupBy("symbol").agg(F.min("day_ms").alias("a"))
    one = lambda lo, hi, step: days.select("symbol", (F.col("a") + lo * DAY + F.col("symbol").cast("int") * step * DAY).alias("from_ms"), (F.col("a") + hi * DAY if hi else F.lit(None).cast("long")).alias("to_ms"))
    return one(0, 30, 0).union(one(20, 60, 1)).union(one(70, None, 0)).union(one(400, 410, 0))


def registry_overlaps(spark, d):
    return validation.closed_overlaps(_exclusions(spark, d).filter("to_ms IS NULL OR from_ms <= to_ms"), "symbol").groupBy("symbol").agg(F.count("*").alias("overlaps"), F.min("from_ms").alias("first_ms"))


def membership_intervals(spark, d):
    return validation.validity_intervals(universe.membership(_volumes(spark, d), 5)).select("symbol", F.col("first").cast("long").alias("first"), F.col("after").cast("long").alias("after"))


def masked_valid_hours(spark, d):
    rows, _ = _quarantine(spark, d)
    return validation.valid_hours(rows, rows.filter("NOT valid"))


def commission_rates(spark, d):
    """Commission documents in three forms, made of the ticks."""
    form, v = F.col("id") % 3, F.format_string("0.%04d", F.col("id") % 1000)
    text = F.when(form == 0, F.concat(F.lit('{"standardCommission":{"maker":"'), v, F.lit('","taker":"0.001"},"discount":{"discount":"0.75","discountAsset":"BNB"},"discountAsset":"BNB"}')))
    text = text.when(form == 1, F.concat(F.lit('{"makerCommissionRate":"'), v, F.lit('","taker":"0.002","discount":"0.5"}'))).otherwise(F.lit('{"commissionAsset":"X"}'))
    made = ticks(spark, d).select("id", validation.commission(text).alias("c"))
    return made.select("id", *(F.col(f"c.{n}").cast("double").alias(n) for n in ("maker", "taker", "discount")), F.col("c.asset").alias("asset"))


def overflow_signatures(spark, d):
    left = bars(spark, d).select("symbol", "open_time", F.format_string("%.2f", "close").alias("close"), F.format_string("%.2f", "volume").alias("volume"))
    more = F.when(F.pmod(F.col("open_time") / HOUR, F.lit(7)) == 0, (F.col("volume").cast("decimal(38,8)") + F.lit(validation.AROUND).cast("decimal(38,8)")).cast("string")).otherwise(F.col("volume"))
    other = F.when(F.pmod(F.col("open_time") / HOUR, F.lit(14)) == 0, F.lit("0")).otherwise(F.col("close"))
    return validation.overflowed(left, left.select("symbol", "open_time", other.alias("close"), more.alias("volume")), ["symbol", "open_time"], "volume", ["close"])


def decimal_texts(spark, d):
    return ticks(spark, d).select("id", validation.plain_decimal(F.round("price", 2)).alias("text"), validation.utc_text(F.col("ts_ms")).alias("at"))


def rotation_validity(spark, d):
    """Days of the panel as rotation events; every third score is late."""
    made = panel(spark, d, REGION).filter("symbol = '0'").select(F.col("day_ms").alias("opens"), (F.col("day_ms") + DAY).alias("closes"))
    late = F.when(F.pmod(F.col("opens") / DAY, F.lit(3)) == 0, HOUR).otherwise(0)
    made = made.select("opens", "closes", F.col("closes").alias("first_score"), (F.col("closes") + late).alias("second_score"), F.col("closes").alias("fills"), F.when(F.pmod(F.col("opens") / DAY, F.lit(5)) == 0, F.col("closes") + DAY).otherwise(F.col("closes")).alias("exits"))
    return validation.rotation_errors(made).select("opens", "errors")


def field_scan(spark, d):
    p = panel(spark, d).withColumn("month", universe.month_index("day_ms")).withColumn("taker", F.when(F.col("trades") > 4, F.col("quote_volume") + 1).otherwise(F.col("quote_volume") / 2))
    return validation.field_errors(p, ["symbol", "month"], "quote_volume", "taker").drop("digest")


def scope_phrases(spark, d):
    """Texts of conversations that name what a study must not."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", F.array_join(validation.named_phrases(F.col("text"), ["the ", "and", "de la"]), ",").alias("phrases")).filter("phrases <> ''")


def source_freeze(spark, d):
    left, right = two_sources(spark, d)
    return validation.frozen(left, right, ["symbol", "open_time"])


def conflict_decision(spark, d):
    """Classes of the ticks' prices as conflicts, decided by symbol's size class."""
    made = ticks(spark, d).select(F.when(F.col("price") > 100, "corrected").otherwise("schema").alias("class"))
    return validation.overall_decision(made, ["corrected", "schema", "unclear"], ["corrected", "schema"], "unclear")


def pair_month_states(spark, d):
    """Two symbols' hours as slots: what is missing, closes early, or differs between both."""
    b = bars(spark, d).filter("symbol IN ('click', 'purchase')").withColumn("month", universe.month_index("open_time"))
    slots = b.select("month", "open_time").union(ticks(spark, d).filter("symbol = 'view'").select(F.lit(None).cast("int"), (F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR))).alias("open_time"))).select("open_time").distinct().withColumn("month", universe.month_index("open_time"))
    two = F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("symbol")
    both = slots.select("month", "open_time", two)
    missing = both.join(b.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti").select("month", "symbol", F.lit("5m").alias("frame"), F.col("open_time").alias("ts"))
    shared = missing.groupBy("month", "ts").agg(F.count("*").alias("n")).filter("n = 2").select("month", "ts")
    even = F.pmod(F.col("month"), F.lit(2)) == 0
    kept = missing.join(shared, ["month", "ts"], "left_semi").union(missing.join(shared, ["month", "ts"], "left_anti").filter(~even))
    faults = slots.select("month").distinct().withColumn("symbol", F.lit("click")).withColumn("frame", F.lit("5m")).withColumn("n", F.when(F.pmod(F.col("month"), F.lit(5)) == 0, 1).otherwise(0))
    early = shared.select("month", two, "ts")
    parity = shared.select("month", F.lit("click").alias("symbol"), F.lit("1h").alias("frame"), "ts", F.lit("derived").alias("kind"))
    return validation.pair_months(kept, early, faults, parity, ("click", "purchase")).withColumn("month", F.col("month").cast("long"))


def premium_intervals(spark, d):
    b = bars(spark, d).select("symbol", F.col("open_time").alias("ts_ms"))
    last = b.groupBy("symbol").agg(F.max("ts_ms").alias("m"))
    several = b.filter("symbol IN ('click', 'view')").select("symbol", F.col("ts_ms").alias("next_ms"))
    single = last.filter("symbol NOT IN ('click', 'view')").select("symbol", (F.col("m") + 2 * HOUR).alias("next_ms"))
    return validation.premium_interval(several.union(single), b)


def _cycles(spark, d):
    marks = panel(spark, d, REGION)
    one = lambda s: marks.filter(F.col("symbol") == s).select(F.col("day_ms").alias("ts_ms"), "close")
    settlements = marks.filter("symbol = '2'").select(F.col("day_ms").alias("ts_ms"), ((F.col("close") / F.col("open") - 1) / 1000).alias("rate"))
    t = trades(spark, d)
    cycles = t.select(F.col("trade_id").alias("id"), F.col("open_ms").alias("opened"), F.col("close_ms").alias("closed"), F.col("open_rate").alias("entry_spot"), (F.col("open_rate") * 1.001).alias("entry_perp"), F.col("stake").alias("notional"), (F.col("stake") * 0.002).alias("costs"), (F.col("pnl") - 0.2).alias("net"))
    return cycles, settlements, one("0"), one("1")


def cycle_drawdowns(spark, d):
    return _r(validation.cycle_falls(*_cycles(spark, d)), "drawdown")


def cycle_equity(spark, d):
    return _r(validation.cycle_equity(*_cycles(spark, d), 1_000_000.0), "equity", places=4)


def anchor_schedule(spark, d):
    made = bars(spark, d).groupBy("symbol").agg(F.min("open_time").alias("start"), (F.max("open_time") + HOUR).alias("end"))
    return validation.anchors(made, 12 * HOUR)


def short_probe(spark, d):
    """Bars with volume that close below the mean of the last three closes."""
    made = bars(spark, d).withColumn("mean3", rolling.sma(F.col("close"), 3))
    return made.filter("volume > 0 AND close < mean3").select("symbol", "open_time")


MARKS = f"""{R}, {TRADES}, cs AS (SELECT s.ts, s.rate, a.close AS spot, b.close AS perp FROM (SELECT day_ms AS ts, (close / open - 1) / 1000 AS rate FROM panel WHERE symbol = '2') s ASOF JOIN (SELECT day_ms AS ta, close FROM panel WHERE symbol = '0') a ON s.ts >= a.ta ASOF JOIN (SELECT day_ms AS tb, close FROM panel WHERE symbol = '1') b ON s.ts >= b.tb),
cm AS (SELECT trade_id AS id, ts AS ts_ms, close_ms AS closed, stake AS notional, stake + (spot - open_rate + open_rate * 1.001 - perp) * stake / open_rate + sum(perp * stake / open_rate * rate) OVER (PARTITION BY trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - stake * 0.002 / 2 AS value FROM trades JOIN cs ON ts > open_ms AND ts <= close_ms)"""
STEPS = lambda step, name: f"""{name}b AS (SELECT symbol, ts_ms - ts_ms % {step} AS t, arg_max(price, row(ts_ms, id)) AS close FROM ticks GROUP BY ALL), {name}r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS fall FROM {name}b),
{name} AS (SELECT symbol, count(*) FILTER (ret > 0) AS trades, avg(ret) / stddev_samp(ret) AS sharpe, max(fall) AS drawdown, arg_max(close, t) / arg_min(close, t) - 1 AS gain FROM {name}r GROUP BY 1)"""  # noqa: E731
OUT = {
    "feature_violations": (feature_violations, f"WITH {TICKS} SELECT symbol, count(*) AS violations FROM ticks WHERE ts_ms - ts_ms % {HOUR} + {HOUR - 1} > ts_ms GROUP BY 1"),
    "curve_validity": (
        curve_validity,
        f"WITH {EQ}, e AS (SELECT pair, day, 10000.0 + gain AS equity, day - lag(day) OVER (PARTITION BY pair ORDER BY day) AS step FROM eq), g AS (SELECT pair, count(*) AS n, count(*) FILTER (step <> 1) AS gaps, count(*) FILTER (equity IS NULL OR equity <= 0) AS bad FROM e GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN n < 2 THEN 'short' END, CASE WHEN gaps > 0 THEN 'days apart' END, CASE WHEN bad > 0 THEN 'value' END) AS errors FROM g",
    ),
    "granularity_check": (
        granularity_check,
        f"WITH {TICKS}, {STEPS(HOUR, 'a')}, {STEPS(2 * HOUR, 'b')}, j AS (SELECT symbol, (a.gain > 0) = (b.gain > 0) AS gates_agree, abs(b.trades - a.trades) / greatest(a.trades, 1) AS trades, abs(b.sharpe - a.sharpe) AS sharpe, abs(b.drawdown - a.drawdown) AS drawdown, abs(b.gain - a.gain) / greatest(abs(1 + a.gain), 1e-12) AS ending FROM a JOIN b USING (symbol)) SELECT symbol, gates_agree, round(trades, 6) AS trades, round(sharpe, 6) AS sharpe, round(drawdown, 6) AS drawdown, round(ending, 6) AS ending, gates_agree AND j.trades <= 0.05 AND j.sharpe <= 0.15 AND j.drawdown <= 0.02 AND j.ending <= 0.05 AS passed FROM j",
    ),
    "registry_overlaps": (
        registry_overlaps,
        f"WITH {N}, a AS (SELECT symbol, min(day_ms) AS a FROM panel GROUP BY 1), r AS (SELECT symbol, a AS f, a + {30 * DAY} AS t FROM a UNION ALL SELECT symbol, a + {20 * DAY} + CAST(symbol AS INTEGER) * {DAY}, a + {60 * DAY} FROM a UNION ALL SELECT symbol, a + {70 * DAY}, NULL FROM a UNION ALL SELECT symbol, a + {400 * DAY}, a + {410 * DAY} FROM a), w AS (SELECT *, max(coalesce(t, 9223372036854775807)) OVER (PARTITION BY symbol ORDER BY f, t NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE t IS NULL OR f <= t) SELECT symbol, count(*) AS overlaps, min(f) AS first_ms FROM w WHERE f <= reach GROUP BY 1",
    ),
    "membership_intervals": (membership_intervals, f"WITH {MEMBERS}, m AS (SELECT DISTINCT symbol, month FROM members), i AS (SELECT *, month - row_number() OVER (PARTITION BY symbol ORDER BY month) AS i FROM m) SELECT symbol, CAST(min(month) AS BIGINT) AS first, CAST(max(month) + 1 AS BIGINT) AS after FROM i GROUP BY symbol, i"),
    "masked_valid_hours": (masked_valid_hours, f"WITH {QUARANTINE}, h AS (SELECT symbol, month, open_time // {HOUR} AS hour, bool_or(NOT valid) AS gone FROM v GROUP BY 1, 2, 3) SELECT symbol, month, count(*) AS hours, count(*) FILTER (gone) AS masked, count(*) FILTER (NOT gone) AS valid FROM h GROUP BY 1, 2"),
    "commission_rates": (
        commission_rates,
        f"WITH {TICKS} SELECT id, CASE id % 3 WHEN 2 THEN 0.0 ELSE CAST(printf('0.%04d', id % 1000) AS DOUBLE) END AS maker, CASE id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.002 ELSE 0.0 END::DOUBLE AS taker, CASE id % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS discount, CASE id % 3 WHEN 0 THEN 'BNB' WHEN 2 THEN 'X' END AS asset FROM ticks",
    ),
    "overflow_signatures": (overflow_signatures, f"WITH {B} SELECT symbol, open_time FROM bars WHERE (open_time // {HOUR}) % 7 = 0 AND (open_time // {HOUR}) % 14 <> 0"),
    "decimal_texts": (decimal_texts, f"WITH {TICKS} SELECT id, regexp_replace(regexp_replace(printf('%.2f', price), '0+$', ''), '\\.$', '') AS text, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM ticks"),
    "rotation_validity": (
        rotation_validity,
        f"WITH {R} SELECT day_ms AS opens, concat_ws(',', CASE WHEN (day_ms // {DAY} + 3) % 7 <> 6 THEN 'no Sunday' END, CASE WHEN (day_ms // {DAY}) % 3 = 0 THEN 'scores apart' END, CASE WHEN (day_ms // {DAY}) % 5 = 0 THEN 'exit and entry apart' END) AS errors FROM panel WHERE symbol = '0'",
    ),
    "field_scan": (field_scan, f"WITH {N} SELECT symbol, CAST(year(make_timestamp(day_ms * 1000)) * 12 + month(make_timestamp(day_ms * 1000)) - 1 AS INTEGER) AS month, count(*) AS rows, count(*) FILTER (trades > 4 OR quote_volume <= 0) AS bad FROM panel GROUP BY 1, 2"),
    "scope_phrases": (scope_phrases, "SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'the ') THEN 'the ' END, CASE WHEN contains(lower(text), 'and') THEN 'and' END, CASE WHEN contains(lower(text), 'de la') THEN 'de la' END) AS phrases FROM conversations WHERE phrases <> ''"),
    "source_freeze": (source_freeze, f"WITH {TWO_SOURCES} SELECT symbol, open_time, 'registered' AS only FROM lhs ANTI JOIN rhs USING (symbol, open_time) UNION ALL SELECT symbol, open_time, 'observed' FROM rhs ANTI JOIN lhs USING (symbol, open_time)"),
    "conflict_decision": (conflict_decision, f"WITH {TICKS} SELECT count(*) AS conflicts, 'resolved' AS decision FROM ticks"),
    "pair_month_states": (
        pair_month_states,
        f"""WITH {B}, s AS (SELECT DISTINCT open_time FROM bars WHERE symbol IN ('click', 'purchase', 'view')), m AS (SELECT open_time AS ts, CAST(year(make_timestamp(open_time * 1000)) * 12 + month(make_timestamp(open_time * 1000)) - 1 AS BIGINT) AS month, (SELECT count(*) FROM bars b WHERE b.open_time = s.open_time AND b.symbol IN ('click', 'purchase')) AS have FROM s),
g AS (SELECT month, count(*) FILTER (have = 0) AS o, count(*) FILTER (have = 1 AND month % 2 <> 0) AS one FROM m GROUP BY 1)
SELECT month, CASE WHEN one > 0 OR month % 5 = 0 THEN 'blocked' WHEN o > 0 THEN 'complete with outage' ELSE 'complete' END AS state, o AS outage_slots, concat_ws(',', CASE WHEN month % 5 = 0 THEN 'click:5m:invalid or conflict' END, CASE WHEN one > 0 THEN 'one-sided 5m gap' END) AS blockers FROM g""",
    ),
    "premium_intervals": (
        premium_intervals,
        f"""WITH {B}, s AS (SELECT symbol, open_time AS t, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS step FROM bars), c AS (SELECT symbol, step, count(*) AS n, min(t) AS t FROM s WHERE step IS NOT NULL AND symbol IN ('click', 'view') GROUP BY 1, 2),
o AS (SELECT symbol, {2 * HOUR} AS step, max(step) AS longest FROM s WHERE symbol NOT IN ('click', 'view') GROUP BY 1) SELECT symbol, step / {HOUR} AS hours FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, t) = 1 UNION ALL SELECT symbol, step / {HOUR} FROM o WHERE longest IS NULL OR step <= longest""",
    ),
    "cycle_drawdowns": (cycle_drawdowns, f"WITH {MARKS}, p AS (SELECT id, 1 - value / greatest(notional, max(value) OVER (PARTITION BY id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)) AS fall FROM cm) SELECT id, round(greatest(max(fall), 0.0), 6) AS drawdown, count(*) AS settlements FROM p GROUP BY 1"),
    "cycle_equity": (
        cycle_equity,
        f"WITH {MARKS}, u AS (SELECT ts_ms, coalesce(sum(value - notional) FILTER (ts_ms < closed), 0) AS un FROM cm GROUP BY 1), e AS (SELECT close_ms, sum(pnl - 0.2) AS made FROM trades GROUP BY 1), c AS (SELECT close_ms, sum(made) OVER (ORDER BY close_ms) AS made FROM e) SELECT ts_ms, round(1000000.0 + coalesce(made, 0) + un, 4) AS equity FROM u ASOF LEFT JOIN c ON u.ts_ms >= c.close_ms",
    ),
    "anchor_schedule": (anchor_schedule, f"WITH {B}, f AS (SELECT symbol, min(open_time) AS s, max(open_time) + {HOUR} AS e FROM bars GROUP BY 1), a AS (SELECT symbol, e, unnest(range(s, e, {12 * HOUR})) AS anchor FROM f) SELECT symbol, anchor, anchor + {12 * HOUR} <= e AS complete FROM a"),
    "short_probe": (short_probe, f"WITH {B}, m AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS 2 PRECEDING) AS m, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n FROM bars) SELECT symbol, open_time FROM m WHERE n >= 3 AND volume > 0 AND close < m"),
}
