"""Exported backtests: a ZIP with one result document, and a metadata document beside it."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.sources.archives import files

TRADE = "array<struct<pair:string,open_date:string,close_date:string,open_rate:double,close_rate:double,stake_amount:double,profit_abs:double,exit_reason:string,is_open:boolean>>"


def _document(content: bytes) -> tuple[str | None, str | None]:
    """The result document's text, or why there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if n.endswith(".json") and not n.endswith("_config.json")]
            return (z.read(names[0]).decode("utf-8"), None) if len(names) == 1 else (None, "not one result")
    except (zipfile.BadZipFile, OSError, RuntimeError, UnicodeDecodeError, zlib.error):
        return None, "broken archive"


def documents(archives: DataFrame) -> DataFrame:
    """archive, sha256, document and fault of every export (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(p, hashlib.sha256(c).hexdigest(), *_document(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(made, columns=["archive", "sha256", "document", "fault"])

    return archives.select("path", "content").mapInPandas(run, "archive string, sha256 string, document string, fault string")


def scan(spark: SparkSession, root: str, strategy: str, pattern: str = "*.zip") -> DataFrame:
    """Exports below root, as ``read`` gives them."""
    meta = files(spark, root, "*.meta.json").select(F.regexp_replace("path", r"\.meta\.json$", ".zip").alias("archive"), F.col("content").cast("string").alias("meta"))
    return read(files(spark, root, pattern), meta, strategy)


def read(archives: DataFrame, meta: DataFrame, strategy: str) -> DataFrame:
    """archive, sha256, trades, metadata fields and fault of every export (path, content) with its metadata (archive, meta).

    Faults, the first that applies: "broken archive", "not one result", "no strategy", "open trades", "no metadata"."""
    at = lambda c, *path: F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))
    made = documents(archives).join(meta, "archive", "left").select(
        "archive",
        "sha256",
        "fault",
        F.from_json(at("document", "strategy", strategy, "trades"), TRADE).alias("trades"),
        at("meta", strategy, "notes").alias("note"),
        at("meta", strategy, "timeframe").alias("timeframe"),
        at("meta", strategy, "timeframe_detail").alias("detail"),
        at("meta", strategy, "backtest_end_ts").try_cast("long").alias("end_s"),
        at("meta", strategy).isNull().alias("bare"),
    )
    is_open = F.exists("trades", lambda t: F.coalesce(t["is_open"], F.lit(False)))
    return made.withColumn("fault", F.coalesce("fault", F.when(F.col("trades").isNull(), "no strategy").when(is_open, "open trades").when(F.col("bare"), "no metadata"))).drop("bare")


def verdicts(exports: DataFrame, note: str, timeframe: str, detail: str, start_ms: int, end_ms: int) -> DataFrame:
    """Exports with the first thing wrong: scan's faults, then "boundary" (a trade not within [start, end)), "note", "timeframe" or "end"; else "ok"."""
    at = lambda c: F.unix_millis(F.to_timestamp(c))
    within = lambda t: (at(t["open_date"]) >= start_ms) & (at(t["open_date"]) < end_ms) & (at(t["close_date"]) < end_ms)
    crossing = F.exists("trades", lambda t: ~F.coalesce(within(t), F.lit(False)))
    wrong = F.when(crossing, "boundary").when(~F.col("note").eqNullSafe(note), "note")
    wrong = wrong.when(~(F.col("timeframe").eqNullSafe(timeframe) & F.col("detail").eqNullSafe(detail)), "timeframe").when(~F.col("end_s").eqNullSafe(end_ms // 1000), "end")
    return exports.withColumn("verdict", F.coalesce("fault", wrong, F.lit("ok")))


def trades(exports: DataFrame, forced: bool = True) -> DataFrame:
    """One row for each trade; without forced, trades closed by force are left out."""
    t = exports.select("archive", F.explode("trades").alias("t"))
    time = lambda c: F.unix_millis(F.to_timestamp(f"t.{c}_date")).alias(f"{c}_ms")
    made = t.select("archive", "t.pair", time("open"), time("close"), "t.open_rate", "t.close_rate", F.col("t.stake_amount").alias("stake"), F.col("t.profit_abs").alias("pnl"), "t.exit_reason")
    return made if forced else made.filter("exit_reason IS NULL OR exit_reason <> 'force_exit'")
