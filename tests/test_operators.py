"""Rules that no single query shows: order, causality, policies, boundaries, sources, sinks and streams."""

import gzip
import io
import json
import math
import random
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.functions import hashing, money, stats, time
from ebbline.operators import asof, dedup, episodes, funding, grid, indicators, paths, reconcile, resample, rolling, universe, validation
from ebbline.plans import checks, strategies, trend
from ebbline.plans import series as series_plans
from ebbline.sources import archives, candles, envelopes, exports, sinks
from ebbline.streaming import stateful, windows

H = 3_600_000
BAR = "symbol string, open_time long, open double, high double, low double, close double, volume double, trades long"


def series(n, symbol="A", skip=()):
    out, price = [], 100.0
    for i in range(n):
        close = price + (0.5 if i % 7 else -3) + (2 if 20 <= i < 45 else 0)
        if i not in skip:
            out.append((symbol, i * H, price, max(price, close) + 1, min(price, close) - 1, close, 1000.0 + i, 1))
        price = close
    return out


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_results_do_not_depend_on_input_order(spark):
    rows = series(80) + series(80, "B", skip=(5, 6))
    made = [rolling.trend_features(spark.createDataFrame(r, BAR).repartition(k), 20, 5, 10, 5, 7) for r, k in ((rows, 1), (rows[::-1], 5))]
    assert collected(made[0], "symbol", "open_time") == collected(made[1], "symbol", "open_time")


def test_no_row_looks_ahead(spark):
    rows = series(80)
    full = collected(rolling.trend_features(spark.createDataFrame(rows, BAR), 20, 5, 10, 5, 7), "open_time")
    part = collected(rolling.trend_features(spark.createDataFrame(rows[:60], BAR), 20, 5, 10, 5, 7), "open_time")
    assert full[:60] == part


def test_backtest_is_causal_and_fills_at_the_next_open(spark):
    features = rolling.trend_features(spark.createDataFrame(series(120), BAR), 10, 5, 5, 5, 5)
    all_rows = collected(trend.backtest(features), "open_time")
    part = collected(trend.backtest(features.filter(F.col("open_time") < 90 * H)), "open_time")
    assert all_rows[:90] == part
    fills = [r for r in all_rows if r[4] != "hold"]
    assert fills and fills[0][4] == "buy"
    by_time = {r.open_time: r for r in features.collect()}
    assert by_time[fills[0][1] - H].enters


def test_only_complete_buckets(spark):
    bars = spark.createDataFrame(series(16, skip=(5,)), BAR)
    assert [r.open_time // H for r in resample.complete_only(bars, H, 4 * H).orderBy("open_time").collect()] == [0, 8, 12]
    assert resample.aggregate_bars(bars, H, 4 * H).filter("NOT complete").first().slots == 3


def test_duplicate_policies(spark):
    df = spark.createDataFrame([("A", 1, "1.0", 1), ("A", 1, "1.00", 2), ("A", 2, "5", 1), ("A", 3, "7", 1), ("A", 3, "7", 2), ("A", 4, "1", 1), ("A", 4, "2", 2)], "symbol string, t long, v string, n int")
    found = {r.t: (r["class"], r.collapsible) for r in dedup.classes(df, ["symbol", "t"], "v", ["v"]).collect()}
    assert found == {1: ("semantic_identical", False), 2: ("single", True), 3: ("byte_identical", True), 4: ("conflicting", False)}
    assert {r.v for r in dedup.first_wins(df, ["t"], ["n"]).collect()} == {"1.0", "5", "7", "1"}
    assert {r.v for r in dedup.last_wins(df, ["t"], ["n"]).collect()} == {"1.00", "5", "7", "2"}


def test_primary_is_never_overwritten(spark):
    cols = "symbol string, open_time long, open string, high string, low string, close string"
    a = spark.createDataFrame([("A", 1, "1", "2", "1", "2"), ("A", 2, "1", "2", "1", "2.0")], cols)
    b = spark.createDataFrame([("A", 1, "1", "2", "1", "999"), ("A", 2, "1", "2", "1", "2"), ("A", 3, "1", "2", "1", "3")], cols)
    got = {r.open_time: (r.close, r.origin, r.state) for r in reconcile.primary_merge(a, b, ["symbol", "open_time"]).collect()}
    assert got == {1: ("2", "primary", "blocked"), 2: ("2.0", "primary", "ok"), 3: ("3", "fill", "ok")}
    kinds = {r.open_time: r["class"] for r in reconcile.row_classes(a, b, ["symbol", "open_time"]).collect()}
    assert kinds == {1: "value_conflict", 2: "format_only", 3: "right_only"}


def test_episodes_chain(spark):
    df = spark.createDataFrame([("A", h * H, h) for h in (0, 24, 48, 73)], "symbol string, ts_ms long, id long")
    assert [r["first"] // H for r in episodes.connected(df, 24 * H).orderBy("first").collect()] == [0, 73]
    assert [r["first"] // H for r in episodes.sessions(df, 24 * H).orderBy("first").collect()] == [0, 73]
    assert [r.ts_ms // H for r in episodes.spaced(df, 24 * H).orderBy("ts_ms").collect()] == [0, 48, 73]


def test_window_boundaries(spark):
    df = spark.createDataFrame([("A", 0, 0), ("A", 10, 1)], "symbol string, ts_ms long, id long")
    assert rolling.most_in_window(df, 10, closed=False).first().most == 1
    assert rolling.most_in_window(df, 10, closed=True).first().most == 2


def test_as_of_crosses_empty_buckets(spark):
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 900, 2.0)], "k string, rt long, v double")
    left = spark.createDataFrame([("k", t) for t in (4, 5, 899, 900, 5000)], "k string, t long")
    got = {r.t: (r.as_of_ts, r.as_of_v) for r in asof.backward(left, right, "k", "t", "rt", "v", span=100).collect()}
    assert got == {4: (None, None), 5: (5, 1.0), 899: (5, 1.0), 900: (900, 2.0), 5000: (900, 2.0)}


def test_overlapping_exclusions_raise(spark):
    rows = spark.createDataFrame([("A", 5)], "symbol string, day_ms long")
    registry = spark.createDataFrame([("A", 1, 5, "x"), ("A", 5, None, "y")], "symbol string, from_ms long, to_ms long, category string")
    with pytest.raises(Exception, match="overlapping"):
        asof.exclusions(rows, registry).collect()


def test_missing_path_slot_censors(spark):
    bars = spark.createDataFrame(series(10, skip=(4,)), BAR)
    events = spark.createDataFrame([("A", 1 * H), ("A", 4 * H)], "symbol string, decision_ms long")
    got = {r.event_ms // H: r.complete for r in paths.observed(paths.forward(events, bars, H, 3), 3).collect()}
    assert got == {1: False, 4: True}


def test_invalid_slots_mask_everyone(spark):
    members = spark.createDataFrame([(1, f"S{i:02d}") for i in range(15)], "month int, symbol string")
    rows = [(f"S{i:02d}", t, 1, not (i < bad)) for t, bad in ((0, 0), (1, 12), (2, 14), (3, 11), (4, 1)) for i in range(15)]
    slots = universe.invalid_slots(spark.createDataFrame(rows, "symbol string, open_time long, month int, valid boolean"), members)
    assert {r.open_time: r.verdict for r in slots.collect()} == {0: "clean", 1: "event", 2: "event", 3: "blocked_isolated", 4: "blocked_isolated"}
    assert universe.slot_mask(slots, members).count() == 30


def test_recursive_indicators():
    x = np.arange(1, 60, dtype=float)
    assert indicators.ema(x[:3], 3).tolist() == [1, 1.5, 2.25]
    assert indicators.rsi(x, 14)[-1] == 100
    plus, minus, adx = indicators.directional(x + 1, x - 1, x, 14)
    assert plus[-1] > minus[-1] and adx[-1] == pytest.approx(100)
    assert (indicators.supertrend(x + 1, x - 1, x, 10, 3.0)[1][10:] == 1).sum() > 40
    assert indicators.parabolic(x + 1, x - 1)[-1] < x[-1]


def test_scalars(spark):
    row = spark.range(1).select(
        time.from_archive(F.lit("1700000000000000")).alias("a"),
        time.next_slot(F.lit(600_000), 300_000).alias("b"),
        time.snapped_hours(F.lit(28_800_500)).alias("c"),
        money.annualised(F.lit(0.0001), F.lit(8.0)).alias("d"),
        money.payback_ratio(F.lit(0.1), F.lit(36.5), F.lit(0.0)).alias("e"),
        time.month_of(F.lit(1_700_000_000_000)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.e, row.f) == (1_700_000_000_000, 900_000, 8.0, float("inf"), "2023-11")
    assert row.d == pytest.approx(0.1095)
    assert stats.probabilistic_sharpe(0.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert 1.5 < stats.expected_maximum_sharpe(1.0, 10) < 1.6
    with pytest.raises(ValueError):
        time.interval_to_ms("7m")


def test_canonical_json():
    assert hashing.canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            hashing.strict_loads(bad)
    with pytest.raises(ValueError):
        hashing.canonical_hash(float("inf"))


def test_envelopes(spark, tmp_path):
    root = str(tmp_path / "raw")
    payload = json.dumps([[H, "1", "2", "0.5", "1.5", "10", 2 * H - 1, "15", 3, "4", "6"], {"open_time": 0, "open": "1", "high": "2", "low": "1", "close": "2", "volume": "1"}, ["bad"], [H, "9", "9", "9", "9", "9"]])
    rows = [("klines", "rest", "/k", {"symbol": "A", "interval": "1h"}, payload, 1_700_000_000_000, None)]
    envelopes.append(spark.createDataFrame(rows, envelopes.SCHEMA), root)
    envelopes.append(spark.createDataFrame(rows, envelopes.SCHEMA), root)
    found = envelopes.scan(spark, root, "klines")
    bars = envelopes.bars(found, "A", "1h").orderBy("open_time").collect()
    assert [(b.open_time, b.open, b.trade_count) for b in bars] == [(0, 1.0, None), (H, 1.0, 3)]
    with pytest.raises(ValueError):
        envelopes.scan(spark, root, "../x")
    assert envelopes.index(spark, found, "raw_index") == 1
    assert envelopes.index(spark, found, "raw_index") == 0
    assert envelopes.indexed(spark, "raw_index", "/nowhere", "klines").count() == 1


def _zip(path, member, text):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(member, text)
    path.write_bytes(buffer.getvalue())


def test_archives(spark, tmp_path):
    line = "0,1,2,0.5,1.5,10,3599999,15,3,4,6,0"
    _zip(tmp_path / "AUSDT-1h-2024-01.zip", "AUSDT-1h-2024-01.csv", f"open_time,open\n{line}\n{line.replace('0,1', '3600000000000000,1', 1)}\n1,2\n")
    _zip(tmp_path / "BUSDT-1h-2024-01.zip", "CUSDT-1h-2024-01.csv", line)
    (tmp_path / "DUSDT-1h-2024-01.zip").write_bytes(b"no zip")
    lines = archives.scan(spark, str(tmp_path))
    got = archives.typed(lines).orderBy("line_number").collect()
    assert [(r.symbol, r.open_time, r.trade_count) for r in got] == [("AUSDT", 0, 3), ("AUSDT", 3_600_000_000_000, 3)]
    assert sorted(r.error for r in lines.filter("error IS NOT NULL").collect()) == ["broken archive: BadZipFile", "field count", "member name"]
    assert archives.before(archives.typed(lines), 1).count() == 1


def test_archives_against_their_checksums(spark, tmp_path):
    import hashlib

    line = "0,1,2,0.5,1.5,10,3599999,15,3,4,6,0\n"
    for name, member in (("A", "AUSDT"), ("B", "BUSDT"), ("C", "XUSDT"), ("D", "DUSDT"), ("E", "EUSDT")):
        _zip(tmp_path / f"{name}USDT-1h-2024-01.zip", f"{member}-1h-2024-01.csv", line * 50)
    hurt = bytearray((tmp_path / "DUSDT-1h-2024-01.zip").read_bytes())
    hurt[60] ^= 255
    (tmp_path / "DUSDT-1h-2024-01.zip").write_bytes(bytes(hurt))
    sums = [(f.name, hashlib.sha256(f.read_bytes()).hexdigest().upper()) for f in tmp_path.glob("[A-D]*.zip")]
    sums = [(n, "0" * 64 if n.startswith("B") else s) for n, s in sums]
    checksums = spark.createDataFrame(sums, "name string, sha256 string")
    got = {r.name[0]: r.verdict for r in archives.verdicts(spark, str(tmp_path), checksums).collect()}
    assert got.pop("D") in ("damaged member", "broken archive")
    assert got == {"A": "ok", "B": "checksum differs", "C": "member name", "E": "no checksum"}
    assert {r.symbol for r in archives.verified(spark, str(tmp_path), checksums).collect()} == {"AUSDT"}


def test_guard_against_looking_ahead(spark):
    from ebbline.operators import validation

    rows = spark.createDataFrame([(1, 2), (3, 3)], "known long, decided long")
    assert validation.guarded(rows, "known", "decided").count() == 2 and validation.looks_ahead(rows, "known", "decided").isEmpty()
    with pytest.raises(Exception, match="feature after decision"):
        validation.guarded(rows.union(spark.createDataFrame([(9, 8)], rows.schema)), "known", "decided").collect()


def test_episodes_cross_buckets(spark):
    times = [0, 5, 90, 105, 195, 290, 310, 1000, 1050, 1101, 1500]
    df = spark.createDataFrame([("A", t, i) for i, t in enumerate(times)] + [("B", 50, 99)], "symbol string, ts_ms long, id long")
    for span in (7, 100, 10_000):
        got = {(r.symbol, r["first"], r["last"], r.events, r.first_id) for r in episodes.connected(df, 100, span=span).collect()}
        assert got == {("A", 0, 310, 7, 0), ("A", 1000, 1101, 3, 7), ("A", 1500, 1500, 1, 10), ("B", 50, 50, 1, 99)}


def test_sinks(spark, tmp_path):
    bars = spark.createDataFrame(series(10), BAR)
    one = sinks.write_json_lines(bars, str(tmp_path / "a"), ["symbol", "open_time"])
    assert one == sinks.digest(bars.repartition(3), ["symbol", "open_time"]) != sinks.digest(bars.limit(9), ["symbol", "open_time"])
    files = list((tmp_path / "a").glob("*.gz"))
    assert sum(len(gzip.open(f).read().splitlines()) for f in files) == 10
    path = str(tmp_path / "m.json")
    sinks.write_manifest({"content": {"x": 1}}, path)
    assert sinks.verify_manifest(path)
    sinks.append_derived(spark, bars, "derived_bars")
    with pytest.raises(ValueError):
        sinks.append_derived(spark, bars.drop("trades"), "derived_bars")


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("A", m * 600_000, m, 100.0 + m % 13) for m in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, id long, price double").withColumn("ts", F.timestamp_millis("ts_ms"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windows.bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = collected(spark.table("bars_out"), "open_time")
    want = collected(resample.bars_from_ticks(df, H), "open_time")
    assert got and got == want[: len(got)] and len(got) >= len(want) - 2


def test_stateful_fills(spark, tmp_path):
    features = rolling.trend_features(spark.createDataFrame(series(60), BAR), 10, 5, 5, 5, 5).select("symbol", "open_time", "open", "close", "atr", "enters", "exits")
    features.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stateful.fills(spark.readStream.schema(features.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fills_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    fills = [(r.open_time, r.side) for r in spark.table("fills_out").orderBy("open_time").collect()]
    batch = [(r.open_time, r.filled) for r in trend.backtest(features).filter("filled <> 'hold'").orderBy("open_time").collect()]
    assert fills == batch


def test_segments_restart_after_gaps(spark):
    got = grid.segments(spark.createDataFrame(series(6, skip=(3,)), BAR), H).orderBy("open_time").collect()
    assert [(r.segment_id, r.bars_since_segment_start) for r in got] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def test_funding_cycles_take_every_tick(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.filter("event_id % 3 <> 0").write.parquet(f"{tmp_path}/events.parquet")
    assert strategies.funding_cycles(spark, str(tmp_path)).count() > 0


def test_candle_files(spark, tmp_path):
    good = [[0, "1.50", "2", "1", "1.5", "3"], [10, "1.5", 2.5, "1.250", "2", "0"], [20, "1e0", "1", "1", "1", "4"]]
    with gzip.open(tmp_path / "A-1h.json.gz", "wt") as f:
        json.dump(good, f)
    (tmp_path / "B-1h.json").write_text(json.dumps({"data": [[40, 1, 2, 1, 1, 1], [0, 1, 2, 1, 3, 1], [0, 0, 2, 1, 1, 1], [10, "x", 2, 1, 1, 1], [20, 1, 2, 1, 1, 1, 9], [30, 1], "no row", [99, 1, 2, 1, 1, 1]]}))
    (tmp_path / "C-1h.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "D-1h.json").write_text("no json")
    rows = candles.scan(spark, str(tmp_path))
    name = F.regexp_extract("file", "([A-Z])-1h", 1).alias("name")
    assert [(r.name, r["count"]) for r in rows.groupBy(name).count().orderBy("name").collect()] == [("A", 3), ("B", 6)]
    kept = {(r.name, r.open_time): (r.open, r.high, r.low) for r in candles.normalised(rows).select(name, "*").collect()}
    assert kept["A", 0] == ("1.5", "2", "1") and kept["A", 10] == ("1.5", "2.5", "1.25") and kept["A", 20][0] == "1"
    assert kept["B", 0][0] == "0" and kept["B", 10][0] is None and len(kept) == 8
    faults = {(r.name, r.place): r.fault for r in candles.faults(rows, 50).select(name, "*").collect()}
    assert faults == {("A", 0): None, ("A", 1): None, ("A", 2): None, ("B", 0): None, ("B", 1): "range", ("B", 2): "values", ("B", 3): "values", ("B", 4): None}
    got = {r.name: (r.rows, r.first_ms, r.last_ms, r.missing) for r in candles.profile(rows, 10, 0, 41).select(name, "*").collect()}
    assert got == {"A": (3, 0, 20, 0), "B": (4, 0, 40, 1)}


def test_exports(spark, tmp_path):
    trade = {"pair": "A", "open_date": "2024-01-01 00:00:00+00:00", "close_date": "2024-01-02 00:00:00+00:00", "open_rate": 1.0, "close_rate": 2, "stake_amount": 10, "profit_abs": 3.5, "exit_reason": "roi", "is_open": False}
    meta = {"notes": "base", "timeframe": "1h", "timeframe_detail": "5m", "backtest_end_ts": 1_706_745_600}

    def export(name, trades, meta=meta, strategy="S", files=("r.json", "r_config.json")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for f in files:
                z.writestr(f, json.dumps({"strategy": {strategy: {"trades": trades}}}))
        if meta:
            (tmp_path / f"{name}.meta.json").write_text(json.dumps({strategy: meta}))

    export("ok", [trade, {**trade, "exit_reason": "force_exit"}, {**trade, "exit_reason": None}])
    export("open", [{**trade, "is_open": True}])
    export("late", [{**trade, "close_date": "2024-02-01 00:00:00+00:00"}])
    export("undated", [{**trade, "open_date": None}])
    export("other", [trade], strategy="T")
    export("two", [trade], files=("a.json", "b.json"))
    export("bare", [trade], meta=None)
    export("note", [trade], {**meta, "notes": "x"})
    export("frame", [trade], {**meta, "timeframe_detail": None})
    export("end", [trade], {**meta, "backtest_end_ts": 1})
    export("none", [])
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    found = exports.verdicts(exports.scan(spark, str(tmp_path), "S"), "base", "1h", "5m", 1_704_067_200_000, 1_706_745_600_000)
    name = F.regexp_extract("archive", "([a-z]+)\\.zip", 1)
    assert {r[0]: r[1] for r in found.select(name, "verdict").collect()} == {
        "ok": "ok", "open": "open trades", "late": "boundary", "undated": "boundary", "other": "no strategy", "two": "not one result",
        "bare": "no metadata", "note": "note", "frame": "timeframe", "end": "end", "none": "ok", "broken": "broken archive",
    }
    rows = exports.trades(found.filter("verdict = 'ok'"))
    assert rows.count() == 3 and exports.trades(found.filter("verdict = 'ok'"), forced=False).count() == 2
    assert (rows.first().open_ms, rows.first().close_ms, rows.first().pnl) == (1_704_067_200_000, 1_704_153_600_000, 3.5)


def test_discover(spark, tmp_path):
    for name in ("AUSDT-1d-2024-01", "AUSDT-1d-2024-03", "BUSDT-1d-2023-12", "CEUR-1d-2024-02", "DUSDT-1h-2024-01", "EUSDT-1d-2024-02"):
        (tmp_path / name[:4]).mkdir(exist_ok=True)
        (tmp_path / name[:4] / f"{name}.zip").write_bytes(b"never opened")
    found = archives.discover(spark, str(tmp_path), "1d", "2024-01", "2024-02", "USDT")
    assert sorted((r.symbol, r.period) for r in found.collect()) == [("AUSDT", "2024-01"), ("EUSDT", "2024-02")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _spread(spark):
    """Points with ties, gaps of more than a span, nulls and values of unlike sizes."""
    rows = [("a", t, i, v) for i, (t, v) in enumerate([(0, 1.0), (9, 2.0), (10, None), (10, 1e9), (19, 0.1), (20, 0.2), (21, 1e-9), (55, None), (64, 3.0), (65, 4.0), (None, 5.0)])]
    return spark.createDataFrame([*rows, ("b", 3, 20, 7.0)], "symbol string, ts_ms long, id long, v double")


def test_rolling_mean_has_growing_windows_only(spark):
    points = _spread(spark)
    made = rolling.with_mean_before(points, "v", 10, "mean")
    assert "RangeFrame, -10" not in _plan(made) and "RangeFrame, -9" not in _plan(made)
    rows = points.collect()
    for r in made.collect():
        inside = [p.v for p in rows if p.symbol == r.symbol and p.v is not None and (p.ts_ms is None if r.ts_ms is None else p.ts_ms is not None and r.ts_ms - 10 < p.ts_ms <= r.ts_ms)]
        assert r["mean"] == (pytest.approx(math.fsum(inside) / len(inside), rel=1e-15) if inside else None)
    assert made.count() == len(rows)


def test_most_in_closed_window_has_growing_windows_only(spark):
    points = _spread(spark)
    made = rolling.most_in_window(points, 10, closed=True)
    assert "RangeFrame, -10" not in _plan(made)
    assert {r.symbol: r.most for r in made.collect()} == {"a": 4, "b": 1}


def test_most_in_half_open_window_has_growing_windows_only(spark):
    points = _spread(spark)
    made = rolling.most_in_window(points, 10, closed=False)
    assert "RangeFrame, -9" not in _plan(made)
    assert {r.symbol: r.most for r in made.collect()} == {"a": 3, "b": 1}


def test_forward_as_of_goes_through_each_window_once(spark):
    signals = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 4, 5, 9, 10, 24, 25, 26, None))], "symbol string, ts_ms long, id long")
    opens = spark.createDataFrame([("a", t) for t in (5, 10, 25)], "symbol string, open_time long")
    made = asof.forward_common(signals, opens, opens, span=10)
    assert "unboundedfollowing" not in _plan(made).lower()
    assert {r.id: r.next_open for r in made.collect() if r.ts_ms is not None} == {0: 5, 1: 5, 2: 10, 3: 10, 4: 25, 5: 25, 6: None, 7: None}


def test_corwin_schultz_takes_lows_of_zero(spark):
    rows = [("a", 0, 2.0, 1.0), ("a", 1, 2.0, 0.0), ("a", 2, 0.0, 0.0), ("a", 3, 2.0, 2.0), ("a", 4, 2.0, 2.0)]
    made = rolling.corwin_schultz(spark.createDataFrame(rows, "symbol string, open_time long, high double, low double"), 1)
    assert {r.open_time: r.spread for r in made.collect()} == {1: 2.0, 2: 2.0, 3: 2.0, 4: 0.0}


def _same_as_sql(spark, name, folder):
    import __spark_entry__ as entry

    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    made = entry.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))


def _events(folder, rows):
    duckdb.connect().execute(f"COPY (SELECT id::BIGINT AS event_id, make_timestamp(ms::BIGINT * 1000) AS ts, 1::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value FROM (VALUES {rows}) t(id, ms, v)) TO '{folder}/events.parquet'")


def test_early_closed_bars_with_prices_of_zero(spark, tmp_path):
    _events(tmp_path, "(1, 0, 0), (2, 60000, 1.5), (3, 18000000, 2), (4, 21600000, 0)")
    _same_as_sql(spark, "early_closed_bars", tmp_path)


def test_row_resolutions_with_several_ticks_at_a_time(spark, tmp_path):
    _events(tmp_path, "(16, 5, 1.5), (32, 5, 1.25), (16, 6, 2), (17, 6, 3), (16, 7, 4), (3, 7, 4.5), (48, 8, 1), (64, 8, 1)")
    _same_as_sql(spark, "row_resolutions", tmp_path)


def _tied_lines(folder):
    """The tables with every order's lines under one number and one supplier of each nation: all keys of a day's first and last line are tied."""
    base, db = "/root/testdata/sf0.01", duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (l_orderkey % 3 AS l_orderkey, 1::INTEGER AS l_linenumber) FROM '{base}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    for t in ("supplier", "nation", "orders"):
        db.execute(f"COPY (SELECT * FROM '{base}/{t}.parquet') TO '{folder}/{t}.parquet'")


@pytest.mark.parametrize("name", ["xsec_robust_z", "borda_rank", "buy_absorption_events", "negative_coskewness_events", "realized_vol"])
def test_tied_lines_give_what_the_sql_gives(spark, tmp_path, name):
    _tied_lines(tmp_path)
    _same_as_sql(spark, name, tmp_path)


def test_marks_of_cycles_stay_with_their_cycle(spark):
    prices = lambda p: spark.createDataFrame([(t * 24 * H, p + t) for t in range(0, 9, 2)], "ts_ms long, close double")
    settlements = spark.createDataFrame([(t * 24 * H, 0.01) for t in range(1, 9)], "ts_ms long, rate double")
    cycles = spark.createDataFrame([(1, 24 * H, 5 * 24 * H, 10.0, 11.0, 100.0, 2.0), (2, 7 * 24 * H, 7 * 24 * H + 1, 10.0, 11.0, 100.0, 2.0)], "id long, opened long, closed long, entry_spot double, entry_perp double, notional double, costs double")
    marked = validation.cycle_marks(cycles, settlements, prices(10.0), prices(12.0))
    assert "hashpartitioning(id" not in _plan(validation.cycle_drawdowns(marked))
    income, want = 0.0, []
    for t in range(2, 6):
        even = t - t % 2
        income += (12.0 + even) * 10 * 0.01
        want.append((t * 24 * H, pytest.approx(100 + (10.0 + even - 10 + 11 - 12 - even) * 10 + income - 1)))
    assert [(r.id, [tuple(m) for m in r.marks]) for r in marked.collect()] == [(1, want)]


def test_funding_cycles_have_growing_windows_only(spark):
    text = _plan(strategies.funding_cycles(spark, "/root/testdata/sf0.001")).lower()
    assert "rangeframe, -259" not in text and "unboundedfollowing" not in text


def test_cycle_equity_adds_up_cycles_where_they_open_and_close(spark):
    assert "explode(marks" not in _plan(checks.cycle_equity(spark, "/root/testdata/sf0.001"))
    day, rng = 24 * H, random.Random(5)
    spot, perp = ([(t * day, rng.uniform(9, 11)) for t in range(1, 40, k)] for k in (2, 3))
    settled = [(t * day + h * H, rng.uniform(-0.01, 0.01) if t % 7 else None) for t in range(40) if t not in range(20, 25) for h in (0, 8)]
    settled.append((41 * day, 0.002))
    cycles = [(i, o := rng.randrange(0, 40 * 3) * 8 * H, o + rng.randrange(-1, 30) * 8 * H, rng.uniform(5, 20), rng.uniform(5, 20), 100.0, 0.2, rng.choice([None, 1.5, -1.25])) for i in range(60)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    price = "ts_ms long, close double"
    made = validation.cycle_equity(frame(cycles, "id long, opened long, closed long, entry_spot double, entry_perp double, notional double, costs double, net double"), frame(settled, "ts_ms long, rate double"), frame(spot, price), frame(perp, price), 1000.0)
    last = lambda rows, t: max((r for r in rows if r[0] <= t), default=(0, None))[1]
    want = {}
    for t, _ in settled:
        if last(spot, t) is None or last(perp, t) is None or not any(c[1] < t <= c[2] for c in cycles):
            continue
        worth = sum(c[7] or 0 for c in cycles if c[2] <= t)
        for _, opened, closed, s, p, notional, costs, _ in cycles:
            if opened < t < closed:
                income = sum(last(perp, u) * r for u, r in settled if opened < u <= t and r is not None and last(spot, u) is not None and last(perp, u) is not None)
                worth += (last(spot, t) - s + p - last(perp, t) + income) * notional / s - costs / 2
        want[t] = pytest.approx(1000 + worth, abs=1e-9)
    assert want and {r.ts_ms: r.equity for r in made.collect()} == want


def _counts_times_once(spark, name, closed):
    """The table is read once, and no event reaches a window before events of one time are one row; the numbers are those of a search."""
    text = _plan(getattr(series_plans, name)(spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan") == 1 and text.rindex("partial_count") > text.rindex("Window")
    rng = random.Random(3)
    rows = [(s, rng.choice([rng.randrange(400), rng.randrange(400) // 20 * 20])) for s in "aab" for _ in range(150)] + [("c", -5), ("d", None), ("d", None), ("d", 7), (None, 9)]
    points = spark.createDataFrame(rows, "symbol string, ts_ms long")
    for span, bin in ((20, 7), (20, 20), (3, 50), (90, 30)):
        inside = lambda t, u: u == t if t is None or u is None else t - span <= u <= t if closed else t - span < u <= t
        want = {s: max(sum(r == s and inside(t, u) for r, u in rows) for q, t in rows if q == s) for s in ("a", "b", "c", "d", None)}
        assert {r.symbol: r.most for r in rolling.most_in_window(points, span, closed, bin=bin).collect()} == want


def test_most_in_closed_window_counts_times_once(spark):
    _counts_times_once(spark, "rolling_event_max_closed", True)


def test_most_in_half_open_window_counts_times_once(spark):
    _counts_times_once(spark, "rolling_event_max_half_open", False)


def test_most_in_half_open_window_sorts_events_once(spark):
    """One sort by time, of the times themselves: no second row for a time that drops out, and no chain of bins afterwards."""
    rng = random.Random(4)
    rows = [(s, t) for s in "ab" for t in rng.sample(range(-900, 900), 300)] + [("c", t) for t in (0, 10, 19, 20, 79, 80, 99)] + [("d", None)]
    made = rolling.most_in_window(spark.createDataFrame(rows, "symbol string, ts_ms long"), 20, closed=False)
    assert _plan(made).count("Window [") == 1 and "array(struct(" not in _plan(made)
    want = {s: max(sum(q == s and (u == t if t is None or u is None else t - 20 < u <= t) for q, u in rows) for r, t in rows if r == s) for s in "abcd"}
    assert {r.symbol: r.most for r in made.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_two_leg_cycles_are_those_of_a_fold(spark, seed):
    import pandas as pd

    assert "InPandas" not in _plan(strategies.funding_cycles(spark, "/root/testdata/sf0.001"))
    rng, nan = random.Random(seed), float("nan")
    rate = lambda: rng.choice([rng.uniform(-1, 1.2), rng.uniform(-1, -0.1), rng.uniform(-1, 1.2), None if seed == 1 else 0.5, nan if seed == 2 else -0.5])
    points = [(s, t, i, rate()) for s in "ab" for i, t in enumerate(sorted(rng.randrange(900) for _ in range(300)))] + [("c", 5, 1, 1.0), ("c", 6, 2, 1.0), ("c", None, 3, 1.0)]
    points += [("a", t, 1000 + t, -0.3) for t in range(400, 470, 9)]  # negative ones over several bins
    rng.shuffle(points)
    opens = [(s, t, 10.0 + t, 11.0 + t) for s in "ab" for t in range(0, 850, 13) if rng.random() < 0.7] + [("c", 6, 1.0, 2.0)]
    want = []
    for s in "abc":
        rows = []
        for _, t, i, r in (p for p in points if p[0] == s and p[1] is not None):
            near = [x for q, u, _, x in points if q == s and u is not None and t - 30 < u <= t and x is not None]
            following = min((o for o in opens if o[0] == s and o[1] > t), default=(s, None, None, None))
            rows.append((s, t, i, nan if r is None else r, sum(near) / len(near) if near else nan, *following[1:]))
        frame = pd.DataFrame(rows, columns=["symbol", "ts_ms", "id", "rate", "mean3d", "next_open", "spot", "perp"]).astype({"next_open": float, "spot": float, "perp": float})
        want += strategies._cycles(frame, 0.02, 3, 100.0).itertuples(index=False)
    clean = lambda r: tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v for v in r)
    want = sorted(map(str, (clean((w.symbol, int(w.opened), int(w.closed), int(w.settlements), *map(float, w[4:10]), bool(w.finished))) for w in want)))
    df, legs = spark.createDataFrame(points, "symbol string, ts_ms long, id long, rate double"), spark.createDataFrame(opens, "symbol string, open_time long, spot double, perp double")
    assert len(want) > 5
    for bin in (7, 50):
        assert sorted(str(clean(r)) for r in funding.two_leg_cycles(df, legs, 0.02, 3, 30, 100.0, bin=bin).collect()) == want


def test_cycle_drawdowns_are_not_touched_by_income_before_a_cycle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(validation, "PART", 100, raising=False)
    base, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("supplier", "nation", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    # before the first order a day whose rate is 10^12, and its income 10^18 a unit
    region = "SELECT min(s_suppkey) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY n_regionkey"
    more = f"SELECT l.* REPLACE (1000000 + i AS l_orderkey, s AS l_suppkey, TIMESTAMP '1994-12-31' AS l_shipdate, CASE i WHEN 0 THEN 1e-9 ELSE 1e6 END AS l_extendedprice) FROM (SELECT * FROM lineitem LIMIT 1) l, (VALUES (0), (1)) v(i), ({region}) r"
    db.execute(f"COPY (SELECT * FROM lineitem UNION ALL {more}) TO '{tmp_path}/lineitem.parquet'")
    for t in ("supplier", "nation", "orders"):
        db.execute(f"COPY (SELECT * FROM {t}) TO '{tmp_path}/{t}.parquet'")
    _same_as_sql(spark, "cycle_drawdowns", tmp_path)


def test_cycle_falls_in_parts(spark, monkeypatch):
    monkeypatch.setattr(validation, "PART", 7)
    day, rng = 24 * H, random.Random(7)
    spot, perp = ([(t * day, rng.uniform(9, 11)) for t in range(1, 40, k)] for k in (2, 3))
    settled = [(t * day, rng.uniform(-0.01, 0.01) if t % 7 else None) for t in range(40)]
    cycles = [(i, o := rng.randrange(0, 40 * 3) * 8 * H, o + rng.randrange(-1, 30) * 8 * H, rng.uniform(5, 20), rng.uniform(5, 20), 100.0, rng.choice([0.2, None])) for i in range(80)]
    price = "ts_ms long, close double"
    columns = "id long, opened long, closed long, entry_spot double, entry_perp double, notional double, costs double"
    tables = [spark.createDataFrame(rows, names) for rows, names in ((cycles, columns), (settled, "ts_ms long, rate double"), (spot, price), (perp, price))]
    made = validation.cycle_falls(*tables)
    assert "collect_list" not in _plan(made)
    want = {r.id: (pytest.approx(r.drawdown, abs=1e-12), r.settlements) for r in validation.cycle_drawdowns(validation.cycle_marks(*tables)).collect()}
    assert len(want) > 40 and {r.id: (r.drawdown, r.settlements) for r in made.collect()} == want
