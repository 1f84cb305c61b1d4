"""Raw envelopes: an append-only log of JSON payloads, its index, and the rows inside the payloads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.operators.dedup import first_wins

#: The columns of an envelope.
COLUMNS = {"dataset": "string", "source": "string", "endpoint": "string", "params": "map<string,string>", "payload": "string", "ingested_at_ms": "long", "content_sha256": "string"}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_\-]*")
_DATASET = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]*")

#: The places of a bar's fields in a positional payload row.
POSITIONS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume")


def checked_name(name: str, dots: bool = False) -> str:
    """A table name, or a dataset name (with dots), that can be a folder; anything else raises."""
    if not (_DATASET if dots else _NAME).fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def append(envelopes: DataFrame, root: str) -> None:
    """Appends envelopes (columns of SCHEMA but for the hash, which is that of the payload's text) below dataset and day of ingestion."""
    day = F.timestamp_millis(F.col("ingested_at_ms"))
    out = envelopes.withColumn("content_sha256", F.sha2("payload", 256)).withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")})
    out.write.mode("append").partitionBy("dataset", "year", "month", "day").json(root)


def scan(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Envelopes of a dataset; partition folders are pruned by name and blank lines skipped."""
    fields = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items() if name != "dataset")
    rows = spark.read.schema(fields).option("mode", "FAILFAST").json(f"{root}/dataset={checked_name(dataset, dots=True)}")
    return rows.withColumn("dataset", F.lit(dataset)).filter("content_sha256 IS NOT NULL")


def indexed(spark: SparkSession, table: str, root: str, dataset: str) -> DataFrame:
    """From the index table if it has the dataset, else from the raw files; a broken index raises."""
    if spark.catalog.tableExists(table):
        found = spark.table(table).filter(F.col("dataset") == dataset)
        if not found.isEmpty():
            return found
    return scan(spark, root, dataset)


def index(spark: SparkSession, envelopes: DataFrame, table: str) -> int:
    """Adds envelopes whose key the index doesn't have yet; returns how many."""
    key = ["dataset", "ingested_at_ms", "content_sha256"]
    new = envelopes.dropDuplicates(key)
    if spark.catalog.tableExists(checked_name(table)):
        new = new.join(spark.table(table).select(*key), key, "left_anti")
    new = new.select(*COLUMNS)
    n = new.count()
    new.write.mode("append").saveAsTable(table)
    return n


def _of(envelopes: DataFrame, symbol: str | None) -> DataFrame:
    """Envelopes of one symbol, or of all, with the symbol as a column."""
    made = envelopes.withColumn("symbol", F.col("params")["symbol"])
    return made.filter("symbol IS NOT NULL") if symbol is None else made.filter(F.col("symbol") == symbol)


def bars(envelopes: DataFrame, symbol: str | None, interval: str) -> DataFrame:
    """Bars inside the payloads (of every symbol if it is None): rows are arrays or objects, bad ones are dropped, the first of a time wins."""
    picked = _of(envelopes, symbol).filter(F.col("params")["interval"] == interval)
    rows = picked.select("symbol", "ingested_at_ms", "content_sha256", F.posexplode(F.from_json("payload", "array<string>")).alias("place", "row"))
    listed = F.from_json("row", "array<string>")
    value = lambda i, name: F.coalesce(F.get(listed, F.lit(i)), F.get_json_object("row", f"$.{name}"))
    number = lambda c, kind: c.try_cast(kind)
    made = rows.select(
        "symbol",
        "ingested_at_ms",
        "content_sha256",
        "place",
        *(number(value(i, n), "long" if n in ("open_time", "close_time", "trade_count") else "double").alias(n) for i, n in enumerate(POSITIONS)),
    )
    good = made.filter("open_time IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    return first_wins(good, ["symbol", "open_time"], ["ingested_at_ms", "content_sha256", "place"]).drop("ingested_at_ms", "content_sha256", "place")


def funding(envelopes: DataFrame, symbol: str | None) -> DataFrame:
    """Settlements inside the payloads, of every symbol if it is None."""
    rows = _of(envelopes, symbol).select("symbol", F.explode(F.from_json("payload", "array<struct<symbol:string,fundingTime:bigint,fundingRate:string>>")).alias("r"))
    return rows.select(F.coalesce("r.symbol", "symbol").alias("symbol"), F.col("r.fundingTime").alias("ts_ms"), F.col("r.fundingRate").try_cast("double").alias("rate")).filter("ts_ms IS NOT NULL AND rate IS NOT NULL")
