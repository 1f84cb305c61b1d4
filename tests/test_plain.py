"""Queries that have no SQL form, against plain Python versions that go row by row."""

import math
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ebbline import catalogue
from ebbline.operators import indicators, metrics, rolling, rules
from ebbline.plans import markets, rulesets, strategies, trend
from ebbline.plans.series import REGION
from ebbline.sources.tables import DAY, HOUR, bars, panel, ticks, trades

DIR = "/root/testdata/sf0.001"


def by_symbol(df, order, key="symbol"):
    out = defaultdict(list)
    for r in df.orderBy(key, order).collect():
        out[r[key]].append(r)
    return out


def same(a, b, within=1e-5):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or math.isnan(b)
    return b is not None and a == pytest.approx(b, abs=within, rel=1e-7)


def ema(xs, n):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] + 2 / (n + 1) * (x - out[-1]))
    return out


def wilder(xs, n):
    out = [None] * len(xs)
    for i in range(n - 1, len(xs)):
        out[i] = sum(xs[:n]) / n if i == n - 1 else out[i - 1] + (xs[i] - out[i - 1]) / n
    return out


def rsi(closes, n):
    moves = [b - a for a, b in zip(closes, closes[1:])]
    up, down = wilder([max(m, 0) for m in moves], n), wilder([max(-m, 0) for m in moves], n)
    return [None] + [None if u is None else 50.0 if u + d == 0 else 100 * u / (u + d) for u, d in zip(up, down)]


def adx(h, l, c, n):
    plus, minus, ranges = [], [], []
    for i in range(1, len(h)):
        up, down = h[i] - h[i - 1], l[i - 1] - l[i]
        plus.append(up if up > max(down, 0) else 0.0)
        minus.append(down if down > max(up, 0) else 0.0)
        ranges.append(max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])))
    p, m, r = wilder(plus, n), wilder(minus, n), wilder(ranges, n)
    both = [(100 * a / t, 100 * b / t) for a, b, t in zip(p, m, r) if t is not None]
    strength = wilder([0.0 if a + b == 0 else 100 * abs(a - b) / (a + b) for a, b in both], n)
    return [None] * (len(h) - len(both)) + strength, [None] * (len(h) - len(both)) + [b for _, b in both]


def supertrend(h, l, c, n, multiple):
    """Final bands by their published definition, day by day."""
    out, way, upper, lower, trend = [0.0] * len(c), [0] * len(c), 0.0, 0.0, -1
    tr = [max(h[i] - l[i], abs(h[i] - c[max(i - 1, 0)]), abs(l[i] - c[max(i - 1, 0)])) for i in range(len(c))]
    for i in range(n, len(c)):
        middle, width = (h[i] + l[i]) / 2, multiple * sum(tr[i - n + 1 : i + 1]) / n
        upper = middle + width if c[i - 1] > upper else min(upper, middle + width)
        lower = middle - width if c[i - 1] < lower else max(lower, middle - width)
        if trend < 0 and c[i] > upper:
            trend = 1
        elif trend > 0 and c[i] < lower:
            trend = -1
        out[i], way[i] = (lower if trend > 0 else upper), trend
    return out, way


def candles(o, h, l, c):
    closes = [sum(x) / 4 for x in zip(o, h, l, c)]
    opens = [(o[0] + c[0]) / 2]
    for k in closes[:-1]:
        opens.append((opens[-1] + k) / 2)
    return opens, closes


@pytest.fixture(scope="module")
def hours(spark):
    return by_symbol(bars(spark, DIR), "open_time")


def test_recursive_indicators(spark, hours):
    for symbol, got in by_symbol(markets.recursive_indicators(spark, DIR), "open_time").items():
        o, h, l, c = ([r[k] for r in hours[symbol]] for k in ("open", "high", "low", "close"))
        one = ema(c, 9)
        two = ema(one, 9)
        want = {
            "ema12": ema(c, 12),
            "macd": [a - b for a, b in zip(ema(c, 12), ema(c, 26))],
            "tema": [3 * (a - b) + d for a, b, d in zip(one, two, ema(two, 9))],
            "rsi": rsi(c, 14),
            "adx": adx(h, l, c, 14)[0],
            "supertrend": supertrend(h, l, c, 10, 3.0)[0],
            "ha_open": candles(o, h, l, c)[0],
        }
        for name, values in want.items():
            assert all(same(v, r[name]) for v, r in zip(values, got, strict=True)), (symbol, name)
        # the parabolic stop stays on the other side of the price until it is touched
        turned = [r.sar > k.high or r.sar < k.low or not (k.low < r.sar < k.high) for r, k in zip(got[1:], hours[symbol][1:])]
        assert all(turned)


def test_composite_signals(spark, hours):
    got = {(r.symbol, r.open_time): set(r.entries.split(",")) for r in strategies.composite_signals(spark, DIR).collect()}
    checked = 0
    for symbol, rows in hours.items():
        o, h, l, c, v = ([r[k] for r in rows] for k in ("open", "high", "low", "close", "volume"))
        short, long, (ho, hc) = ema(c, 20), ema(c, 50), candles(o, h, l, c)
        strength, minus = adx(h, l, c, 14)
        way = supertrend(h, l, c, 10, 3.0)[1]
        share = [a / b - 1 for a, b in zip(ema(c, 12), ema(c, 26))]
        for i, r in enumerate(rows):
            have = got.get((symbol, r.open_time), set())
            cross = i > 0 and short[i] > long[i] and short[i - 1] <= long[i - 1] and hc[i] > short[i] and ho[i] < hc[i]
            mean = statistics.fmean(v[max(0, i - 12) : i]) if i else None
            strong = strength[i] is not None and strength[i] > 20 and minus[i] > 15 and mean is not None and v[i] > mean
            turn = i > 0 and way[i] == 1 and way[i - 1] == -1
            for name, want in (("candle_trend", cross), ("momentum", 0.02 <= share[i] <= 0.3), ("strength", strong), ("direction", turn)):
                assert (name in have) == want, (symbol, i, name)
                checked += want
    assert checked > 20


def test_trend_backtest(spark):
    features = rolling.trend_features(panel(spark, DIR, REGION), slow=50, fast=10, entry=20, exit_=10, atr=14, ts="day_ms")
    got = by_symbol(trend.backtest(features, "day_ms"), "day_ms")
    fills = 0
    for symbol, rows in by_symbol(features, "day_ms").items():
        cash, units, stop, wanted = 10_000.0, 0.0, None, None
        for i, (r, g) in enumerate(zip(rows, got[symbol], strict=True)):
            if wanted == "buy":
                y = rows[i - 1]
                units = min(100 / (2 * y.atr), cash / (r.open * 1.0015))
                cash -= units * r.open * 1.0015
                stop = y.close - 2 * y.atr
            elif wanted == "sell":
                cash += units * r.open * 0.9985
                units = 0.0
            fills += wanted is not None
            assert g.equity == pytest.approx(cash + units * r.close) and g.quantity == pytest.approx(units)
            wanted = None
            if i < len(rows) - 1:
                if not units and r.enters and r.atr:
                    wanted = "buy"
                elif units and (r.exits or r.close < stop):
                    wanted = "sell"
    assert fills > 4


def test_policy_benchmark(spark):
    days = defaultdict(dict)
    for r in panel(spark, DIR, REGION).filter("symbol IN ('0', '1')").collect():
        days[r.day_ms][r.symbol] = r
    days = {k: v for k, v in sorted(days.items()) if len(v) == 2}
    got = {r.day_ms: r.equity for r in markets.policy_benchmark(spark, DIR).collect()}
    assert list(sorted(got)) == list(days)
    cash, units = 10_000.0, {"0": 0.0, "1": 0.0}
    for k, (day, both) in enumerate(days.items()):
        if k == 0 or (day // DAY) % 7 == 4:  # 1970-01-01 was a Thursday
            worth = cash + sum(units[s] * both[s].open for s in units)
            target = {s: 0.25 * worth / both[s].open for s in units}
            turned = sum(abs(target[s] - units[s]) * both[s].open for s in units)
            cash = worth - sum(target[s] * both[s].open for s in units) - 0.0015 * turned
            units = target
        assert got[day] == pytest.approx(cash + sum(units[s] * both[s].close for s in units), abs=1e-5)


def test_probabilistic_sharpe(spark):
    curves = by_symbol(metrics.daily_equity(trades(spark, DIR), 1_000_000.0), "day", "pair")
    got = {r.pair: (r.sharpe, r.psr) for r in markets.curve_metrics_psr(spark, DIR).collect()}
    assert set(got) == set(curves)
    for pair, rows in curves.items():
        r = [b.equity / a.equity - 1 for a, b in zip(rows, rows[1:])]
        n, mean = len(r), statistics.fmean(r)
        moment = lambda k: statistics.fmean((x - mean) ** k for x in r)
        sharpe = mean / statistics.stdev(r)
        skew, kurtosis = moment(3) / moment(2) ** 1.5, moment(4) / moment(2) ** 2
        z = sharpe * math.sqrt(n - 1) / math.sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2)
        assert got[pair][0] == pytest.approx(sharpe * math.sqrt(365), abs=1e-5)
        assert got[pair][1] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-4)


def test_funding_cycles(spark, hours):
    got = sorted((r.symbol, r.opened, r.closed, r.settlements, r.finished) for r in strategies.funding_cycles(spark, DIR).collect())
    want = []
    for symbol, rows in by_symbol(ticks(spark, DIR), F.struct("ts_ms", "id")).items():
        opens = [b.open_time for b in hours[symbol]]
        rates = [((r.price - 45) / 1e5, r.ts_ms) for r in rows]
        state, last = None, None
        for rate, t in rates:
            following = next((x for x in opens if x > t), None)
            last = t
            if state:
                if t > state[0]:
                    state[1] += 1
                state[2] = state[2] + 1 if rate < 0 else 0
                if state[2] >= 3 and following is not None:
                    want.append((symbol, state[0], following, state[1], True))
                    state = None
            else:
                near = [x for x, u in rates if t - 3 * DAY < u <= t]
                if statistics.fmean(near) >= 2e-5 and rate > 0 and following is not None:
                    state = [following, 0, 0]
        if state:
            want.append((symbol, state[0], last, state[1], False))
    assert got == sorted(want) and any(w[4] for w in want)


def test_cycles_end_the_same_whatever_the_order():
    import pandas as pd

    rows = pd.DataFrame([("A", t, t, 1e-4, 1e-4, float(t + HOUR), 100.0 + t, 101.0 + t) for t in range(5)], columns=["symbol", "ts_ms", "id", "rate", "mean3d", "next_open", "spot", "perp"])
    a, b = strategies._cycles(rows, 2e-5, 3, 1000.0), strategies._cycles(rows[::-1], 2e-5, 3, 1000.0)
    assert a.equals(b) and a.closed[0] == 4 and a.exit_spot[0] == 104


def test_every_query_has_sql_or_a_plain_version():
    plain = {"recursive_indicators", "composite_signals", "trend_backtest_equity", "policy_benchmark", "curve_metrics_psr", "funding_cycles"}
    plain |= {"mean_ladder", "mean_share", "oversold_hammer", "flow_reversal", "strong_dip", "volume_burst"}
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == plain


def seeded(xs, n):
    known = [i for i, x in enumerate(xs) if x is not None]
    out, last = [None] * len(xs), None
    for place, i in enumerate(known, 1):
        if place == n:
            last = sum(xs[k] for k in known[:n]) / n
        elif place > n:
            last = (2 * xs[i] + (n - 1) * last) / (n + 1)
        out[i] = last
    return out


def triple(xs, n):
    one = seeded(xs, n)
    two = seeded(one, n)
    return [None if c is None else 3 * a - 3 * b + c for a, b, c in zip(one, two, seeded(two, n))]


def mean_of(xs, i, n):
    part = xs[i - n + 1 : i + 1] if i >= n - 1 else [None]
    return None if None in part else statistics.fmean(part)


def oscillator(h, l, c, n):
    fast = [None if i < n - 1 else 0.0 if max(h[i - n + 1 : i + 1]) == min(l[i - n + 1 : i + 1]) else 100 * (c[i] - min(l[i - n + 1 : i + 1])) / (max(h[i - n + 1 : i + 1]) - min(l[i - n + 1 : i + 1])) for i in range(len(c))]
    return fast, [mean_of(fast, i, 3) for i in range(len(c))]


def money(h, l, c, v, i, n=14):
    if i < n:
        return None
    p = [sum(x) / 3 for x in zip(h, l, c)]
    up = sum(p[k] * v[k] for k in range(i - n + 1, i + 1) if p[k] > p[k - 1])
    down = sum(p[k] * v[k] for k in range(i - n + 1, i + 1) if p[k] < p[k - 1])
    return 50.0 if up + down == 0 else 100 * up / (up + down)


def deviation_index(h, l, c, i, n=14):
    p = [sum(x) / 3 for x in zip(h, l, c)][max(i - n + 1, 0) : i + 1]
    if len(p) < n:
        return None
    off = statistics.fmean(abs(x - statistics.fmean(p)) for x in p)
    return None if off == 0 else (p[-1] - statistics.fmean(p)) / (0.015 * off)


def is_hammer(o, h, l, c, i):
    if i < 10:
        return False
    body, reach = [abs(a - b) for a, b in zip(o, c)], [a - b for a, b in zip(h, l)]
    shadow_below, shadow_above = min(o[i], c[i]) - l[i], h[i] - max(o[i], c[i])
    near = l[i - 1] + 0.2 * statistics.fmean(reach[i - 6 : i - 1])
    return body[i] < statistics.fmean(body[i - 10 : i]) and shadow_below > body[i] and shadow_above < 0.1 * statistics.fmean(reach[i - 10 : i]) and min(o[i], c[i]) <= near


def holds(*conditions):
    """Each condition is (value, test); an undefined value holds nothing."""
    return all(v is not None and test(v) for v, test in conditions)


def over(a, b):
    return None if a is None or b is None else a - b


def compare(marked, hours, plain, at_least=(0, 0)):
    """marked against plain(series of a symbol) -> columns by name, enters and leaves by bar."""
    found = [0, 0]
    for symbol, got in by_symbol(marked, "open_time").items():
        columns, enters, leaves = plain(*([r[k] for r in hours[symbol]] for k in ("open", "high", "low", "close", "volume")), got)
        for name, values in columns.items():
            assert all(same(v, r[name]) for v, r in zip(values, got, strict=True)), (symbol, name)
        for i, r in enumerate(got):
            assert (r.enters, r.leaves) == (enters(i), leaves(i)), (symbol, i)
            found = [found[0] + r.enters, found[1] + r.leaves]
    assert found[0] >= at_least[0] and found[1] >= at_least[1], found


def test_mean_ladder(spark, hours):
    assert rules.rungs(4, 15) == [(30, 15), (45, 30)] and rules.rungs(4, 1) == [(3, 2)] and rules.rungs(1, 5) == []

    def plain(o, h, l, c, v, got):
        t = {n: triple(c, n) for n in (2, 4, 6, 8, 15, 30, 45)}
        return {"tema15": t[15]}, lambda i: holds((over(t[30][i], t[15][i]), lambda x: x < 0), (over(t[45][i], t[30][i]), lambda x: x < 0)), lambda i: any(holds((over(t[n][i], t[n - 2][i]), lambda x: x > 0)) for n in (4, 6, 8))

    means = {f"tema{n}": lambda p, n=n: indicators.tema(p["close"].to_numpy(), n) for n in (2, 4, 6, 8, 15, 30, 45)}
    compare(rules.mean_ladder(indicators.per_symbol(bars(spark, DIR), means, carry=True), exit_=(5, 2)), hours, lambda *a: ({"tema15": plain(*a)[0]["tema15"]}, *plain(*a)[1:]), (5, 5))
    # the query's own lengths
    compare(rulesets.mean_ladder(spark, DIR), hours, lambda o, h, l, c, v, got: ({"tema15": triple(c, 15), "tema68": triple(c, 68)}, plain(o, h, l, c, v, got)[1], lambda i: got[i].leaves), (5, 0))
    empty = spark.createDataFrame([], "symbol string, open_time long, open double, high double, low double, close double, volume double")
    assert rules.mean_ladder(indicators.per_symbol(empty, means, carry=True), exit_=(5, 2)).count() == 0
    assert not rules.mean_ladder(bars(spark, DIR), entry=(1, 5), exit_=(1, 5)).filter("enters OR leaves").count()


def test_mean_share(spark, hours):
    def plain(o, h, l, c, v, got):
        share = [None if b is None else a / b - 1 for a, b in zip(seeded(c, 12), seeded(c, 26))]
        return {"share": share}, lambda i: holds((share[i], lambda x: -0.01416 <= x <= -0.01176)), lambda i: False

    compare(rulesets.mean_share(spark, DIR), hours, plain, (1, 0))


def fisher(x):
    return None if x is None else math.tanh(0.1 * (x - 50))


def test_oversold_hammer(spark, hours):
    def limits(most_rsi, most_slow):
        def plain(o, h, l, c, v, got):
            strength, slow = rsi(c, 14), oscillator(h, l, c, 5)[1]
            p = [sum(x) / 3 for x in zip(h, l, c)]
            low = [None if i < 19 else statistics.fmean(p[i - 19 : i + 1]) - 2 * statistics.stdev(p[i - 19 : i + 1]) for i in range(len(c))]
            enters = lambda i: is_hammer(o, h, l, c, i) and holds((strength[i], lambda x: x < most_rsi), (slow[i], lambda x: x < most_slow), (low[i], lambda x: x > c[i]))
            leaves = lambda i: got[i].sar is not None and got[i].sar > c[i] and holds((fisher(strength[i]), lambda x: x > 0.3))
            return {"rsi": strength, "slowk": slow, "low2": low, "hammer": [is_hammer(o, h, l, c, i) for i in range(len(c))]}, enters, leaves

        return plain

    made = rulesets.folded(spark, DIR, "rsi", "sar")
    compare(rules.oversold_hammer(made), hours, limits(30, 20), (0, 5))
    compare(rules.oversold_hammer(made, 100, 101), hours, limits(100, 101))


def test_hammer(spark):
    rows = [("A", i, 10.0, 11.0, 9.0, 10.5) for i in range(12)] + [("A", 12, 8.95, 9.02, 7.5, 9.0), ("A", 13, 8.95, 9.9, 7.5, 9.0), ("A", 14, 8.0, 9.02, 7.5, 9.0)]
    made = spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double")
    assert [r.open_time for r in made.withColumn("x", indicators.hammer()).filter("x").collect()] == [12]


def test_flow_reversal(spark, hours):
    def limits(most_rsi, most_fisher, most_money):
        def plain(o, h, l, c, v, got):
            strength, (fast, slow) = rsi(c, 14), oscillator(h, l, c, 5)
            e = {n: seeded(c, n) for n in (5, 10, 50, 100)}
            flow = [money(h, l, c, v, i) for i in range(len(c))]
            up = lambda i: holds((over(e[50][i], e[100][i]), lambda x: x > 0)) or i > 0 and holds((over(e[5][i], e[10][i]), lambda x: x > 0), (over(e[5][i - 1], e[10][i - 1]), lambda x: x <= 0))
            enters = lambda i: up(i) and holds((strength[i], lambda x: 0 < x < most_rsi), (fisher(strength[i]), lambda x: x < most_fisher), (flow[i], lambda x: x < most_money), (over(mean_of(c, i, 40), c[i]), lambda x: x > 0), (over(slow[i], fast[i]), lambda x: x > 0), (slow[i], lambda x: x > 0))
            return {"rsi": strength, "slow": slow, "mfi": flow, "ema100": e[100]}, enters, lambda i: got[i].sar is not None and got[i].sar > c[i] and holds((fisher(strength[i]), lambda x: x > 0.3))

        return plain

    made = rulesets.folded(spark, DIR, "rsi", "sar", "ema5", "ema10", "ema50", "ema100")
    compare(rules.flow_reversal(made), hours, limits(28, -0.94, 16), (0, 5))
    compare(rules.flow_reversal(made, 100, 1, 101), hours, limits(100, 1, 101), (5, 5))


def test_strong_dip(spark, hours):
    def limits(least, least_slow, most_cci, most_fast, most_slow):
        def plain(o, h, l, c, v, got):
            a, b = adx(h, l, c, 14)[0], adx(h, l, c, 35)[0]
            (k, d), (lk, ld) = oscillator(h, l, c, 5), oscillator(h, l, c, 50)
            e, cci = seeded(c, 5), [deviation_index(h, l, c, i) for i in range(len(c))]
            under = lambda i: i > 0 and holds((over(k[i - 1], d[i - 1]), lambda x: x < 0))
            strong = lambda i: holds((a[i], lambda x: x > least)) or holds((b[i], lambda x: x > least_slow))
            low = lambda i: holds((k[i - 1], lambda x: x < most_fast), (d[i - 1], lambda x: x < most_fast), (lk[i - 1], lambda x: x < most_slow), (ld[i - 1], lambda x: x < most_slow))
            enters = lambda i: under(i) and strong(i) and low(i) and holds((over(k[i], d[i]), lambda x: x > 0), (cci[i], lambda x: x < most_cci), (mean_of(v, i, 12), lambda x: x > 0.75))
            leaves = lambda i: under(i) and (holds((k[i], lambda x: x > 70)) or holds((d[i], lambda x: x > 70))) and holds((b[i], lambda x: x < 25), (over(c[i], e[i]), lambda x: x > 0))
            return {"adx": a, "slow_adx": b, "cci": cci, "k": k, "d": d, "long_k": lk, "long_d": ld}, enters, leaves

        return plain

    made = rulesets.folded(spark, DIR, "adx", "slow_adx", "ema5")
    compare(rules.strong_dip(made), hours, limits(50, 26, -100, 20, 30), (0, 5))
    compare(rules.strong_dip(made, 5, 5, 50, 60, 90), hours, limits(5, 5, 50, 60, 90), (5, 5))


def test_volume_burst(spark, hours):
    def limits(times, least_rsi, most_fisher, exit_rsi):
        def plain(o, h, l, c, v, got):
            strength, (fast, slow) = rsi(c, 14), oscillator(h, l, c, 5)
            minus = adx(h, l, c, 14)[1]
            turn = [None if b is None else a - b for a, b in zip([None] * 14 + seeded(c[14:], 12), seeded(c, 26))]
            usual = [mean_of(v, i, 150) for i in range(len(c))]
            scaled = [None if x is None else 50 * (fisher(x) + 1) for x in strength]
            enters = lambda i: holds((over(v[i], usual[i] and times * usual[i]), lambda x: x > 0), (over(mean_of(c, i, 40), c[i]), lambda x: x > 0), (over(slow[i], fast[i]), lambda x: x > 0), (slow[i], lambda x: x > 1), (strength[i], lambda x: x > least_rsi), (scaled[i], lambda x: x < most_fisher))
            leaves = lambda i: i > 0 and holds((strength[i], lambda x: x > exit_rsi), (strength[i - 1], lambda x: x <= exit_rsi), (turn[i], lambda x: x < 0), (minus[i], lambda x: x > 4))
            return {"rsi": strength, "macd": turn, "minus": minus, "usual": usual, "fisher": scaled}, enters, leaves

        return plain

    made = rulesets.folded(spark, DIR, "rsi", "macd", "minus")
    compare(rules.volume_burst(made), hours, limits(4, 26, 5, 74))
    compare(rules.volume_burst(made, 1, 10, 101, 50), hours, limits(1, 10, 101, 50), (1, 5))
