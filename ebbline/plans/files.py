"""Queries of sources and sinks: the driver's tables go into archives, envelopes, caches and exports, and come back through the readers."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ebbline.functions import time
from ebbline.sources import archives, candles, envelopes, exports, scratch, sinks
from ebbline.sources.tables import DAY, HOUR, TICKS, TRADES, bars, bars_sql, ticks, trades

B = bars_sql()
PACKED = "path string, content binary"


def _zipped(member: str, text: str) -> bytes:
    """An archive whose bytes depend on its content only: a lost task makes the same one again."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo(member, (2020, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _day_archive(pdf: pd.DataFrame) -> pd.DataFrame:
    """A day's bars of a symbol as an archive; on odd days its times are microseconds."""
    name, scale = pdf["name"].iloc[0], 1000 if pdf["odd"].iloc[0] else 1
    lines = [
        ",".join(map(str, (t * scale, repr(o), repr(h), repr(lo), repr(c), repr(v), (t + HOUR - 1) * scale, 0, n, 0, 0, 0)))
        for t, o, h, lo, c, v, n in pdf.sort_values("open_time")[["open_time", "open", "high", "low", "close", "volume", "trades"]].itertuples(index=False)
    ]
    return pd.DataFrame({"path": [f"daily/{name}.zip"], "content": [_zipped(f"{name}.csv", "\n".join(["open_time,open", *lines]))]})


def _day_number():
    return F.floor(F.col("open_time") / DAY)


def _archives(spark, d):
    """One archive for each symbol and day of hourly bars."""
    made = bars(spark, d).withColumn("symbol", F.upper(F.translate("symbol", "_-", ""))).withColumn("odd", _day_number() % 2 == 1)
    made = made.withColumn("name", F.concat_ws("-", "symbol", F.lit("1h"), time.day_of(F.col("open_time"))))
    return made.groupBy("name").applyInPandas(_day_archive, PACKED)


def archive_bars(spark, d):
    return archives.typed(archives.unpacked(_archives(spark, d))).select("symbol", "interval", "open_time", "open", "high", "low", "close", "volume", "close_time", "trade_count")


def archive_checks(spark, d):
    made = archives.checks(archives.unpacked(_archives(spark, d)))
    return made.select("archive", "rows", "first_ms", "last_ms", "errors", "ordered")


def archive_verdicts(spark, d):
    """Of every four days' archives one is sound, one has another checksum, one has none and one is cut off."""
    k = F.floor(F.unix_millis(F.to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.zip$", 1))) / DAY) % 4
    made = _archives(spark, d).withColumn("k", k)
    packed = made.withColumn("content", F.when(F.col("k") == 3, F.substring("content", 1, 40)).otherwise(F.col("content")))
    sums = packed.filter("k <> 2").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.when(F.col("k") == 1, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)).alias("sha256"))
    return archives.judged(packed, sums).select("name", "verdict")


def envelope_bars(spark, d):
    """Bars in payloads of a day each, every one ingested twice."""
    row = F.array(*(F.col(c).cast("string") for c in ("open_time", "open", "high", "low", "close", "volume")))
    made = bars(spark, d).withColumn("day", _day_number()).groupBy("symbol", "day").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("payload"))
    twice = made.withColumn("ingested_at_ms", F.explode(F.array((F.col("day") + 1) * DAY, (F.col("day") + 2) * DAY)))
    root = scratch.fresh(spark)
    envelopes.append(_enveloped(twice, "klines", F.create_map(F.lit("symbol"), F.col("symbol"), F.lit("interval"), F.lit("1h"))), root)
    return envelopes.bars(envelopes.scan(spark, root, "klines"), None, "1h").select("symbol", "open_time", "open", "high", "low", "close", "volume")


def _enveloped(rows, dataset, params):
    return rows.select(F.lit(dataset).alias("dataset"), F.lit("rest").alias("source"), F.lit("/v1").alias("endpoint"), params.alias("params"), "payload", "ingested_at_ms")


def envelope_settlements(spark, d):
    """Ticks as settlements in payloads of an hour each; every third names no symbol of its own."""
    own = F.when(F.col("id") % 3 != 0, F.col("symbol"))
    row = F.struct(own.alias("symbol"), F.col("ts_ms").alias("fundingTime"), (F.col("price") / 1000).cast("string").alias("fundingRate"))
    made = ticks(spark, d).groupBy("symbol", F.floor(F.col("ts_ms") / HOUR).alias("hour")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    root = scratch.fresh(spark)
    envelopes.append(_enveloped(made.withColumn("ingested_at_ms", F.col("hour") * HOUR), "funding.rates", F.create_map(F.lit("symbol"), F.col("symbol"))), root)
    return envelopes.funding(envelopes.scan(spark, root, "funding.rates"), None).select("symbol", "ts_ms", F.round("rate", 9).alias("rate"))


def _caches(spark, d):
    """Candle caches of a symbol's month each, as gzip files; rows of symbol, month and the cache's own columns."""
    row = F.array(F.col("open_time").cast("string"), *(F.format_string("%.4f", F.col(c)) for c in candles.FIELDS))
    made = bars(spark, d).groupBy("symbol", time.month_of(F.col("open_time")).alias("month")).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))
    root = scratch.fresh(spark)
    made.write.partitionBy("symbol", "month").option("compression", "gzip").text(root)
    return candles.scan(spark, root, "*.gz")


def _named(df, *columns):
    part = lambda c: F.regexp_extract("file", f"{c}=([^/]+)/", 1).alias(c)
    return df.select(part("symbol"), part("month"), *columns)


def candle_texts(spark, d):
    return _named(candles.normalised(_caches(spark, d)), "open_time", "open", "high", "low", "close")


def candle_profiles(spark, d):
    return _named(candles.profile(_caches(spark, d), HOUR, 0, 2**53), "rows", "first_ms", "last_ms", "missing")


def candle_faults(spark, d):
    return _named(candles.faults(_caches(spark, d), 2**53), "open_time", F.col("fault").isNull().alias("sound"))


def json_line_bars(spark, d):
    root = scratch.fresh(spark)
    sinks.write_json_lines(bars(spark, d), root, ["symbol", "open_time"])
    return spark.read.schema("symbol string, open_time long, open double, high double, low double, close double, trades long").json(root)


def compact_candles(spark, d):
    root = scratch.fresh(spark)
    sinks.write_candles(bars(spark, d), root)
    rows = spark.read.schema("value string, symbol string").text(root).withColumn("r", F.from_json("value", "array<string>"))
    return rows.select("symbol", *(F.get("r", F.lit(i)).cast("long" if i == 0 else "double").alias(n) for i, n in enumerate(("open_time", *candles.FIELDS))))


def _export(pdf: pd.DataFrame) -> pd.DataFrame:
    """A pair's month of trades as an export."""
    names = {"pair": "pair", "opened": "open_date", "closed": "close_date", "open_rate": "open_rate", "close_rate": "close_rate", "stake": "stake_amount", "pnl": "profit_abs"}
    rows = [{**r, "is_open": False, "exit_reason": "roi"} for r in pdf[list(names)].rename(columns=names).to_dict("records")]
    return pd.DataFrame({"path": [pdf["archive"].iloc[0]], "content": [_zipped("result.json", json.dumps({"strategy": {"S": {"trades": rows}}}))]})


def exported_trades(spark, d):
    """Trades in exports of a pair's month each; the notes of odd months are not the expected one."""
    text = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd HH:mm:ssXXX")
    made = trades(spark, d).withColumn("archive", F.concat_ws("/", F.lit("runs"), "pair", F.concat(time.month_of(F.col("open_ms")), F.lit(".zip"))))
    packed = made.withColumn("opened", text("open_ms")).withColumn("closed", text("close_ms")).groupBy("archive").applyInPandas(_export, PACKED)
    odd = F.regexp_extract("archive", r"-(\d\d)\.zip$", 1).cast("int") % 2 == 1
    fields = F.struct(F.when(odd, "other").otherwise("base").alias("notes"), F.lit("1h").alias("timeframe"), F.lit("5m").alias("timeframe_detail"), F.lit(4102444800).alias("backtest_end_ts"))
    meta = made.select("archive").distinct().select("archive", F.to_json(F.struct(fields.alias("S"))).alias("meta"))
    found = exports.verdicts(exports.read(packed, meta, "S"), "base", "1h", "5m", 0, 4102444800000)
    return exports.trades(found).join(found.select("archive", "verdict"), "archive").select("archive", "pair", "open_ms", "close_ms", "stake", "pnl", "verdict")


def time_bounds(spark, d):
    """Bounds of each tick's month, day and four hours; every other time comes as microseconds."""
    raw = F.when(F.col("id") % 2 == 0, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms"))
    t = ticks(spark, d).select("id", time.from_archive(raw).alias("t"))
    at = F.col("t")
    four = time.interval_to_ms("4h")
    return t.select("id", "t", time.month_start(at).alias("month_start"), time.next_month(at).alias("next_month"), time.day_of(at).alias("day"), time.bucket(at, four).alias("slot"), time.next_slot(at, four).alias("next_slot"))


NAME = f"upper(translate(symbol, '_-', '')) || '-1h-' || strftime(make_timestamp(open_time * 1000), '%Y-%m-%d')"
MONTH = "strftime(make_timestamp(open_time * 1000), '%Y-%m')"
PLAIN = lambda c: f"regexp_replace(regexp_replace(printf('%.4f', {c}), '0+$', ''), '\\.$', '') AS {c}"
OUT = {
    "archive_bars": (archive_bars, f"WITH {B} SELECT upper(translate(symbol, '_-', '')) AS symbol, '1h' AS interval, open_time, open, high, low, close, volume, open_time + {HOUR - 1} AS close_time, trades AS trade_count FROM bars"),
    "archive_checks": (archive_checks, f"WITH {B} SELECT 'daily/' || {NAME} || '.zip' AS archive, count(*) AS rows, min(open_time) AS first_ms, max(open_time) AS last_ms, 0 AS errors, true AS ordered FROM bars GROUP BY 1"),
    "archive_verdicts": (
        archive_verdicts,
        f"WITH {B} SELECT DISTINCT {NAME} || '.zip' AS name, CASE (open_time // {DAY}) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'checksum differs' WHEN 2 THEN 'no checksum' ELSE 'broken archive' END AS verdict FROM bars",
    ),
    "envelope_bars": (envelope_bars, f"WITH {B} SELECT symbol, open_time, open, high, low, close, volume FROM bars"),
    "envelope_settlements": (envelope_settlements, f"WITH {TICKS} SELECT symbol, ts_ms, round(price / 1000, 9) AS rate FROM ticks"),
    "candle_texts": (candle_texts, f"WITH {B} SELECT symbol, {MONTH} AS month, open_time, {', '.join(PLAIN(c) for c in candles.FIELDS[:4])} FROM bars"),
    "candle_profiles": (candle_profiles, f"WITH {B} SELECT symbol, {MONTH} AS month, count(*) AS rows, min(open_time) AS first_ms, max(open_time) AS last_ms, (max(open_time) - min(open_time)) // {HOUR} + 1 - count(*) AS missing FROM bars GROUP BY 1, 2"),
    "candle_faults": (candle_faults, f"WITH {B} SELECT symbol, {MONTH} AS month, open_time, least(open, high, low, close) > 0 AS sound FROM bars"),
    "json_line_bars": (json_line_bars, f"WITH {B} SELECT symbol, open_time, open, high, low, close, trades FROM bars"),
    "compact_candles": (compact_candles, f"WITH {B} SELECT symbol, open_time, open, high, low, close, volume FROM bars"),
    "exported_trades": (
        exported_trades,
        f"WITH {TRADES} SELECT 'runs/' || pair || '/' || strftime(make_timestamp(open_ms * 1000), '%Y-%m') || '.zip' AS archive, pair, open_ms, close_ms, stake, pnl, CASE WHEN month(make_timestamp(open_ms * 1000)) % 2 = 1 THEN 'note' ELSE 'ok' END AS verdict FROM trades",
    ),
    "time_bounds": (
        time_bounds,
        f"WITH {TICKS}, m AS (SELECT id, ts_ms AS t, date_trunc('month', make_timestamp(ts_ms * 1000)) AS m FROM ticks) SELECT id, t, epoch_ms(m) AS month_start, epoch_ms(m + INTERVAL 1 MONTH) AS next_month, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day, t - t % {4 * HOUR} AS slot, t - t % {4 * HOUR} + {4 * HOUR} AS next_slot FROM m",
    ),
}
