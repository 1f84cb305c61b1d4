"""Queries of the event detectors, with thresholds at which the small tables give events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.operators import cross, detectors
from ebbline.plans.markets import DAILY, _daily
from ebbline.plans.series import REGION, _r
from ebbline.sources.tables import DAY, ms, panel, panel_sql

R, N = panel_sql(REGION), panel_sql()


def _against_others(spark, d):
    """Daily returns of regions, and as common series the median of the others."""
    return cross.leave_one_out(_daily(spark, d)).withColumnRenamed("others_median", "common")


OTHERS = f"{DAILY}, xo AS (SELECT a.decision_ms, a.symbol, any_value(a.value) AS value, quantile_cont(b.value, 0.5) AS common FROM x a LEFT JOIN x b ON a.decision_ms = b.decision_ms AND a.symbol <> b.symbol GROUP BY 1, 2)"


def _held(value: str, n: int, name: str, last: int = 0) -> str:
    """A history as a list, null unless all rows are there."""
    frame = f"(PARTITION BY symbol ORDER BY decision_ms ROWS BETWEEN {n - 1 - last} PRECEDING AND {-last} PRECEDING)" if last else f"(PARTITION BY symbol ORDER BY decision_ms ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN list({value}) OVER {frame} END AS {name}"


def _median(values: str) -> str:
    return f"list_aggregate({values}, 'median')"


def _first(order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY {order}, symbol) = 1"


HALF = 15
#: Histories of both halves: k, x (own), y (common) and r (their difference).
HALVES = f"""{OTHERS}, h AS (SELECT decision_ms, symbol, {_held("value", 2 * HALF, "l")}, {_held("common", 2 * HALF, "m")} FROM xo),
g AS (SELECT decision_ms, symbol, k, l[k * {HALF} + 1:(k + 1) * {HALF}] AS x, m[k * {HALF} + 1:(k + 1) * {HALF}] AS y FROM h, (VALUES (0), (1)) t(k) WHERE l IS NOT NULL AND m IS NOT NULL),
q AS (SELECT *, list_transform(range(1, {HALF + 1}), lambda i: x[i] - y[i]) AS r FROM g),
c AS (SELECT *, list_transform(r, lambda v: v - list_avg(r)) AS dr, list_transform(y, lambda v: v - list_avg(y)) AS dy FROM q)"""


def _both(stat: str, bound: float, largest: bool) -> str:
    sign, beyond = ("-", ">=") if largest else ("", "<=")
    order = "-least(first, second), -greatest(first, second)" if largest else "greatest(first, second), least(first, second)"
    return f"""WITH {HALVES}, {stat}, s AS (SELECT decision_ms, symbol, max(v) FILTER (k = 0) AS first, max(v) FILTER (k = 1) AS second FROM v GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY decision_ms) AS members FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY decision_ms ORDER BY {sign}first, symbol) AS a, row_number() OVER (PARTITION BY decision_ms ORDER BY {sign}second, symbol) AS b FROM n WHERE members >= 4 AND first IS NOT NULL AND second IS NOT NULL),
w AS (SELECT * FROM p WHERE first {beyond} {bound} AND second {beyond} {bound} AND a <= (members + 3) // 4 AND b <= (members + 3) // 4 {_first(order)})
SELECT decision_ms, symbol, round(first, 5) AS first, round(second, 5) AS second, members FROM w"""


def _moment(p: int, q: int) -> str:
    mean = lambda of: f"list_avg(list_transform(range(1, {HALF + 1}), lambda i: {of}))"
    vx, vy = mean("dr[i] * dr[i]"), mean("dy[i] * dy[i]")
    return f"e AS (SELECT *, {vx} AS vx, {vy} AS vy, {mean(f'pow(dr[i], {p}) * pow(dy[i], {q})')} AS j FROM c), v AS (SELECT decision_ms, symbol, k, CASE WHEN vx > 0 AND vy > 0 THEN j / (pow(vx, {p / 2}) * pow(vy, {q / 2})) END AS v FROM e)"


def negative_coskewness_events(spark, d):
    return _r(detectors.negative_coskewness(_against_others(spark, d), HALF, bound=-0.05, members=4), "first", "second", places=5)


def systematic_cokurtosis_events(spark, d):
    return _r(detectors.systematic_cokurtosis(_against_others(spark, d), HALF, bound=0.8, members=4), "first", "second", places=5)


def unstable_volatility_events(spark, d):
    return _r(detectors.unstable_volatility(_against_others(spark, d), HALF, block=3, bound=0.1, members=4), "first", "second", places=5)


def downside_tail_events(spark, d):
    return _r(detectors.downside_tails(_against_others(spark, d), HALF, share=0.2, dominance=0.8), "share", "dominance", "lowest", places=5)


def correlation_breakdown_events(spark, d):
    made = detectors.correlation_breakdown(_against_others(spark, d), baseline=18, recent=12, displacement=0.02, positive=6, largest=5.0, single=0.9, before=-0.2, after=0.2, fall=0.1)
    return _r(made, "displacement", "baseline", "recent", places=5)


def persistent_laggard_events(spark, d):
    rows = panel(spark, d, REGION).select(F.col("day_ms").alias("decision_ms"), "symbol", "volume")
    return _r(detectors.persistent_laggards(rows, 28, 15), "median_volume")


def downside_rejection_events(spark, d):
    rows = panel(spark, d, REGION).withColumnRenamed("day_ms", "decision_ms")
    return _r(detectors.downside_rejection(rows, members=3, median=0.02, negative=0.4, span=0.018, fall=-0.012, location=0.7, residual=0.1), "residual", "location", "fall", "span")


def _taken(spark, d):
    """Daily volume of nations and the part of it that was sold at a discount, as what takers bought."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    goods = read("lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    rows = goods.join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    volume = F.col("l_quantity") * F.col("l_extendedprice") / 1000
    bought = rows.groupBy(F.col("s_nationkey").cast("string").alias("symbol"), ms("l_shipdate").alias("day_ms")).agg(F.round(F.sum(F.when(F.col("l_discount") >= 0.05, volume).otherwise(0.0)), 6).alias("buy_volume"))
    return panel(spark, d).join(bought, ["symbol", "day_ms"]).withColumnRenamed("day_ms", "decision_ms")


def buy_absorption_events(spark, d):
    return _r(detectors.buy_absorption(_taken(spark, d), members=5, share=0.55, z=0.8, fall=2.0, move=0.5), "z", "share", "relative")


def dispersion_leader_events(spark, d):
    rows = _daily(spark, d)
    return _r(detectors.dispersion_leader(rows, 40 * DAY, 12 * DAY, members=2, ratio=0.8, total=0.02, positive=5, single=0.9), "baseline", "recent", "total", "single")


def range_strength_events(spark, d):
    rows = panel(spark, d, REGION).withColumnRenamed("day_ms", "decision_ms")
    return _r(detectors.range_strength(rows, 42, members=2, ratio=1.0, z=0.2, location=0.6, body=0.1, relative=0.01), "range", "relative", "ratio", "z", "location", "body")


def low_peak_events(spark, d):
    return _r(detectors.low_peaks(_daily(spark, d), HALF, members=4, most=10.0), "first", "second")


def attention_day_events(spark, d):
    rows = panel(spark, d, REGION).withColumnRenamed("day_ms", "decision_ms")
    return _r(detectors.attention_days(rows, 30, members=3, share=1.2, volume=1.2, muted=1.0), "share_ratio", "volume_ratio", "relative")


def joint_trend_events(spark, d):
    rows = panel(spark, d, REGION).withColumnRenamed("day_ms", "decision_ms")
    return _r(detectors.joint_trends(rows, members=3, ratio=1.01), "trend", "ratio")


MAD = "1.4826"
TAIL = f"""e AS (SELECT *, {_median("r")} AS m FROM q), f AS (SELECT *, {MAD} * list_aggregate(list_transform(r, lambda v: abs(v - m)), 'median') AS s FROM e),
t AS (SELECT *, list_filter(r, lambda v: v <= m - 2 * s) AS low FROM f),
v AS (SELECT *, list_sum(list_transform(low, lambda v: (v - m) * (v - m))) AS energy, list_sum(list_transform(r, lambda v: (v - m) * (v - m))) AS every, list_max(list_transform(low, lambda v: (v - m) * (v - m))) AS top, list_min(low) AS bottom FROM t WHERE len(low) >= 2 AND s > 0)"""
BLOCK = 3
VOV = f"""e AS (SELECT *, list_transform(range(0, {HALF // BLOCK}), lambda i: sqrt(list_avg(list_transform(r[i * {BLOCK} + 1:i * {BLOCK} + {BLOCK}], lambda v: v * v)))) AS b FROM q),
f AS (SELECT *, {_median("b")} AS m FROM e), t AS (SELECT *, {MAD} * list_aggregate(list_transform(b, lambda v: abs(v - m)), 'median') AS s FROM f), v AS (SELECT decision_ms, symbol, k, CASE WHEN m > 0 AND s > 0 THEN s / m END AS v FROM t)"""
_pearson = lambda x, y, n: f"(list_avg(list_transform(range(1, {n + 1}), lambda i: ({x}[i] - list_avg({x})) * ({y}[i] - list_avg({y})))) / sqrt(list_avg(list_transform({x}, lambda v: (v - list_avg({x})) * (v - list_avg({x})))) * list_avg(list_transform({y}, lambda v: (v - list_avg({y})) * (v - list_avg({y}))))))"
_loo = lambda src, value: f"(SELECT a.decision_ms, a.symbol, quantile_cont(b.{value}, 0.5) AS others FROM {src} a LEFT JOIN {src} b ON a.decision_ms = b.decision_ms AND a.symbol <> b.symbol GROUP BY 1, 2)"
SEC = "OVER (PARTITION BY decision_ms)"
OUT = {
    "negative_coskewness_events": (negative_coskewness_events, _both(_moment(1, 2), -0.05, False)),
    "systematic_cokurtosis_events": (systematic_cokurtosis_events, _both(_moment(2, 2), 0.8, True)),
    "unstable_volatility_events": (unstable_volatility_events, _both(VOV, 0.1, True)),
    "downside_tail_events": (
        downside_tail_events,
        f"""WITH {HALVES}, {TAIL}, z AS (SELECT decision_ms, symbol, CAST(max(len(low)) FILTER (k = 0) AS INTEGER) AS first_tail, CAST(max(len(low)) FILTER (k = 1) AS INTEGER) AS second_tail, min(energy / every) AS share, max(top / energy) AS dominance, min((bottom - m) / s) AS lowest FROM v GROUP BY 1, 2 HAVING count(*) = 2)
SELECT decision_ms, symbol, first_tail, second_tail, round(share, 5) AS share, round(dominance, 5) AS dominance, round(lowest, 5) AS lowest FROM z WHERE share >= 0.2 AND dominance <= 0.8""",
    ),
    "correlation_breakdown_events": (
        correlation_breakdown_events,
        f"""WITH {OTHERS}, h AS (SELECT decision_ms, symbol, {_held("value", 30, "l")}, {_held("common", 30, "m")} FROM xo), g AS (SELECT *, l[1:18] AS xa, m[1:18] AS ya, l[19:30] AS xb, m[19:30] AS yb FROM h WHERE l IS NOT NULL AND m IS NOT NULL),
r AS (SELECT *, list_transform(range(1, 13), lambda i: xb[i] - yb[i]) AS r FROM g), t AS (SELECT *, list_sum(r) AS displacement FROM r),
s AS (SELECT decision_ms, symbol, displacement, {_pearson("xa", "ya", 18)} AS baseline, {_pearson("xb", "yb", 12)} AS recent FROM t WHERE displacement >= 0.02 AND len(list_filter(r, lambda v: v > 0)) >= 6 AND list_max(list_transform(xb, lambda v: abs(v))) <= 5 AND greatest(r[12], 0) <= 0.9 * displacement)
SELECT decision_ms, symbol, round(displacement, 5) AS displacement, round(baseline, 5) AS baseline, round(recent, 5) AS recent FROM s WHERE baseline >= -0.2 AND recent <= 0.2 AND baseline - recent >= 0.1""",
    ),
    "persistent_laggard_events": (
        persistent_laggard_events,
        f"""WITH {R}, p AS (SELECT day_ms AS decision_ms, symbol, volume, row_number() OVER (PARTITION BY day_ms ORDER BY volume, symbol) AS p, count(*) OVER (PARTITION BY day_ms) AS n FROM panel), h AS (SELECT decision_ms, symbol, {_held("CAST(p <= (n + 3) // 4 AS INTEGER)", 28, "a")}, {_held("p", 28, "b")}, {_held("volume", 28, "c")} FROM p),
t AS (SELECT decision_ms, symbol, CAST(list_sum(a) AS INTEGER) AS low_days, {_median("b")} AS median_place, {_median("c")} AS mv FROM h WHERE a IS NOT NULL) SELECT decision_ms, symbol, low_days, CAST(median_place AS DOUBLE) AS median_place, round(mv, 6) AS median_volume FROM t WHERE low_days >= 15""",
    ),
    "downside_rejection_events": (
        downside_rejection_events,
        f"""WITH {R}, b AS (SELECT day_ms AS decision_ms, symbol, ln(close / open) AS ret, high / low - 1 AS span, low / open - 1 AS fall, CASE WHEN high > low THEN (close - low) / (high - low) END AS location FROM panel),
s AS (SELECT *, count(*) {SEC} AS members, count(*) FILTER (location IS NULL) {SEC} AS bad, quantile_cont(ret, 0.5) {SEC} AS med, count(*) FILTER (ret < 0) {SEC} AS down FROM b),
f AS (SELECT * FROM s WHERE members >= 3 AND bad = 0 AND med <= 0.02 AND down >= 0.4 * members - 1e-9), o AS {_loo("f", "location")},
r AS (SELECT f.*, location - others AS residual FROM f JOIN o USING (decision_ms, symbol)), p AS (SELECT *, row_number() OVER (PARTITION BY decision_ms ORDER BY residual DESC, symbol) AS p FROM r)
SELECT decision_ms, symbol, round(residual, 6) AS residual, round(location, 6) AS location, round(fall, 6) AS fall, round(span, 6) AS span FROM p WHERE ret > 0 AND span >= 0.018 AND fall <= -0.012 AND location >= 0.7 AND residual >= 0.1 AND p <= (members + 3) // 4
QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY p.residual DESC, p.location DESC, p.fall, p.span DESC, symbol) = 1""",
    ),
    "buy_absorption_events": (
        buy_absorption_events,
        f"""WITH {N}, k AS (SELECT CAST(s_nationkey AS VARCHAR) AS symbol, epoch_ms(l_shipdate) AS day_ms, round(sum(CASE WHEN l_discount >= 0.05 THEN l_quantity * l_extendedprice / 1000 ELSE 0.0 END), 6) AS buy FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
b AS (SELECT day_ms AS decision_ms, symbol, open, close, quote_volume AS q, buy FROM panel JOIN k USING (symbol, day_ms)), s AS (SELECT *, count(*) {SEC} AS members, count(*) FILTER (least(open, close, q) > 0 AND buy BETWEEN 0 AND q) {SEC} AS good FROM b),
t AS (SELECT decision_ms, symbol, ln(close / open) AS ret, buy / q AS share FROM s WHERE members >= 5 AND good = members), u AS (SELECT *, quantile_cont(share, 0.5) {SEC} AS c, quantile_cont(ret, 0.5) {SEC} AS m FROM t),
w AS (SELECT *, {MAD} * quantile_cont(abs(share - c), 0.5) {SEC} AS s FROM u), e AS (SELECT decision_ms, symbol, (share - c) / s AS z, share, ret - m AS relative FROM w WHERE s > 0 AND abs(ret) <= 0.5)
SELECT decision_ms, symbol, round(z, 6) AS z, round(share, 6) AS share, round(relative, 6) AS relative FROM e WHERE share >= 0.55 AND e.z >= 0.8 AND e.relative BETWEEN -2 AND 0 QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY e.z DESC, e.share DESC, e.relative, symbol) = 1""",
    ),
    "dispersion_leader_events": (
        dispersion_leader_events,
        f"""WITH {DAILY}, m AS (SELECT *, quantile_cont(value, 0.5) {SEC} AS med FROM x), r AS (SELECT decision_ms, symbol, value - med AS residual, decision_ms // {40 * DAY} AS win, decision_ms >= (decision_ms // {40 * DAY} + 1) * {40 * DAY} - {12 * DAY} AS late, decision_ms >= (decision_ms // {40 * DAY} + 1) * {40 * DAY} - {6 * DAY} AS half FROM m),
t AS (SELECT win, decision_ms, late, {MAD} * quantile_cont(abs(residual), 0.5) AS disp FROM r GROUP BY 1, 2, 3), l AS (SELECT win, count(*) AS times, quantile_cont(disp, 0.5) FILTER (NOT late) AS baseline, quantile_cont(disp, 0.5) FILTER (late) AS recent FROM t GROUP BY 1 HAVING baseline > 0 AND recent >= 0.8 * baseline AND recent >= 0),
g AS (SELECT win, symbol, count(*) AS n, sum(residual) FILTER (late) AS total, count(*) FILTER (late AND residual > 0) AS positive, coalesce(sum(residual) FILTER (late AND NOT half), 0) AS h1, coalesce(sum(residual) FILTER (late AND half), 0) AS h2, coalesce(max(residual) FILTER (late AND residual > 0) / sum(residual) FILTER (late AND residual > 0), 1) AS single FROM r GROUP BY 1, 2),
f AS (SELECT g.*, baseline, recent, count(*) OVER (PARTITION BY win) AS members, row_number() OVER (PARTITION BY win ORDER BY total DESC, symbol) AS p FROM g JOIN l USING (win) WHERE n = times AND total IS NOT NULL)
SELECT win AS "window", symbol, round(baseline, 6) AS baseline, round(recent, 6) AS recent, round(total, 6) AS total, positive, round(single, 6) AS single FROM f WHERE p = 1 AND members >= 2 AND f.total >= 0.02 AND positive >= 5 AND h1 > 0 AND h2 > 0 AND f.single <= 0.9""",
    ),
    "range_strength_events": (
        range_strength_events,
        f"""WITH {R}, b AS (SELECT *, day_ms AS decision_ms, ln(high / low) AS rg FROM panel), h AS (SELECT *, {_held("rg", 42, "l", -1)} FROM b), s AS (SELECT *, ln(close / open) - quantile_cont(ln(close / open), 0.5) {SEC} AS relative, count(*) {SEC} AS members, {_median("l")} AS base FROM h WHERE l IS NOT NULL AND high > low),
t AS (SELECT *, {MAD} * list_aggregate(list_transform(l, lambda v: abs(v - base)), 'median') AS s FROM s),
e AS (SELECT decision_ms, symbol, rg, relative, rg / base AS ratio, (rg - base) / s AS z, (close - low) / (high - low) AS location, (close - open) / (high - low) AS body FROM t WHERE base > 0 AND s > 0 AND members >= 2 AND rg >= 0.03922071315328133)
SELECT decision_ms, symbol, round(rg, 6) AS range, round(relative, 6) AS relative, round(ratio, 6) AS ratio, round(z, 6) AS z, round(location, 6) AS location, round(body, 6) AS body FROM e WHERE e.ratio >= 1 AND e.z >= 0.2 AND e.location >= 0.6 AND e.body >= 0.1 AND e.relative >= 0.01 QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY e.relative DESC, e.z DESC, symbol) = 1""",
    ),
    "low_peak_events": (
        low_peak_events,
        f"""WITH {OTHERS}, h AS (SELECT decision_ms, symbol, {_held("(value - common)", HALF, "a", -HALF)}, {_held("(value - common)", HALF, "b")} FROM xo), s AS (SELECT decision_ms, symbol, list_max(a) AS first, list_max(b) AS second, count(*) {SEC} AS members FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY decision_ms ORDER BY first, symbol) AS pa, row_number() OVER (PARTITION BY decision_ms ORDER BY second, symbol) AS pb FROM s), w AS (SELECT * FROM p WHERE members >= 4 AND greatest(first, second) <= 10 AND pa <= (members + 3) // 4 AND pb <= (members + 3) // 4 {_first("greatest(first, second), first + second")})
SELECT decision_ms, symbol, round(first, 6) AS first, round(second, 6) AS second FROM w""",
    ),
    "attention_day_events": (
        attention_day_events,
        f"""WITH {R}, b AS (SELECT day_ms AS decision_ms, symbol, close / open - 1 AS value, quote_volume AS q, quote_volume / sum(quote_volume) OVER (PARTITION BY day_ms) AS share, count(*) OVER (PARTITION BY day_ms) AS members FROM panel), o AS {_loo("b", "value")},
h AS (SELECT b.*, value - others AS relative, {_held("share", 30, "s", -1)}, {_held("q", 30, "v", -1)} FROM b JOIN o USING (decision_ms, symbol)), e AS (SELECT decision_ms, symbol, members, relative, share / {_median("s")} AS share_ratio, q / {_median("v")} AS volume_ratio FROM h WHERE s IS NOT NULL AND v IS NOT NULL AND {_median("s")} > 0 AND {_median("v")} > 0)
SELECT decision_ms, symbol, round(share_ratio, 6) AS share_ratio, round(volume_ratio, 6) AS volume_ratio, round(relative, 6) AS relative FROM e WHERE members >= 3 AND e.share_ratio >= 1.2 AND e.volume_ratio >= 1.2 AND e.relative BETWEEN -1 AND 1 QUALIFY row_number() OVER (PARTITION BY decision_ms ORDER BY e.share_ratio DESC, e.volume_ratio DESC, symbol) = 1""",
    ),
    "joint_trend_events": (
        joint_trend_events,
        f"""WITH {R}, b AS (SELECT day_ms AS decision_ms, symbol, close, quote_volume / sum(quote_volume) OVER (PARTITION BY day_ms) AS share FROM panel), h AS (SELECT *, lag(close, 7) OVER (PARTITION BY symbol ORDER BY decision_ms) AS c7, {_held("share", 3, "r")}, {_held("share", 21, "l", -3)} FROM b),
t AS (SELECT decision_ms, symbol, ln(close / c7) - quantile_cont(ln(close / c7), 0.5) {SEC} AS trend, count(*) {SEC} AS members, {_median("r")} / {_median("l")} AS ratio, list_min(r) > {_median("l")} AS steady FROM h WHERE c7 IS NOT NULL AND r IS NOT NULL AND l IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY decision_ms ORDER BY trend DESC, symbol) AS pa, row_number() OVER (PARTITION BY decision_ms ORDER BY ratio DESC, symbol) AS pb FROM t),
w AS (SELECT *, 2 * members - pa - pb + 2 AS score FROM p WHERE members >= 3 AND pa <= (members + 3) // 4 AND pb <= (members + 3) // 4 AND trend >= 0.03 AND ratio >= 1.01 AND steady {_first("-(2 * members - pa - pb + 2), trend DESC, ratio DESC")})
SELECT decision_ms, symbol, round(trend, 6) AS trend, round(ratio, 6) AS ratio, score FROM w""",
    ),
}
