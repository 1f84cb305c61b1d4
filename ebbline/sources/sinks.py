"""Sinks with content digests: compressed JSON lines, compact candle arrays, manifests and derived tables."""

from __future__ import annotations

import json
import os
import tempfile
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions.hashing import canonical, canonical_hash
from ebbline.sources.envelopes import checked_name


def digest(rows: DataFrame, order: list[str]) -> str:
    """Hash of a row set that doesn't depend on its order or partitions: a sum of row hashes, computed where the rows are."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    part = lambda k: F.conv(F.substring(F.sha2(text, 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(4))).first()
    return canonical_hash({"rows": sums["n"], "sums": [str(sums[f"s{k}"] or Decimal(0)) for k in range(4)], "columns": sorted(rows.columns), "order": order})


def write_json_lines(rows: DataFrame, path: str, order: list[str]) -> str:
    """Gzip JSON lines, range-sorted across files; returns the digest."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").json(path)
    return digest(rows, order)


def write_candles(bars: DataFrame, path: str) -> None:
    """One file per symbol of [time, open, high, low, close, volume] lines."""
    line = F.to_json(F.array(*(F.col(c).cast("string") for c in ("open_time", "open", "high", "low", "close", "volume"))))
    bars.select("symbol", line.alias("value")).write.mode("overwrite").partitionBy("symbol").option("compression", "gzip").text(path)


def write_manifest(document: dict, path: str) -> str:
    """Sorted JSON with its own content hash, written beside and renamed."""
    sealed = {**document, "content_hash": canonical_hash(document.get("content"))}
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
        f.write(json.dumps(json.loads(canonical(sealed)), sort_keys=True, indent=2))
    os.replace(f.name, path)
    return sealed["content_hash"]


def verify_manifest(path: str) -> bool:
    with open(path) as f:
        document = json.load(f)
    return document.get("content_hash") == canonical_hash(document.get("content"))


def append_derived(spark: SparkSession, rows: DataFrame, table: str) -> int:
    """Appends to a derived table; other columns than it has raise."""
    if spark.catalog.tableExists(checked_name(table)):
        have = sorted(spark.table(table).columns)
        if have != sorted(rows.columns):
            raise ValueError(f"columns differ: {have} and {sorted(rows.columns)}")
        rows = rows.select(*spark.table(table).columns)
    rows.write.mode("append").saveAsTable(table)
    return rows.count()
