"""Candle caches: JSON files, plain or gzip, that hold one symbol's rows as [time, open, high, low, close, volume] arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.operators.validation import plain_decimal

FIELDS = ("open", "high", "low", "close", "volume")


def scan(spark: SparkSession, root: str, pattern: str = "*.json*") -> DataFrame:
    """file, place, open_time and the fields as text. A file is a list of rows, or an object with one under data or candles;
    rows that aren't arrays of six are left out, and anything else gives no row. One file is one symbol's cache and is read by one task."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.coalesce(F.get_json_object("value", "$.data"), F.get_json_object("value", "$.candles")))
    rows = files.select(F.input_file_name().alias("file"), F.posexplode(F.from_json(listed, "array<string>")).alias("place", "row"))
    made = rows.withColumn("r", F.from_json("row", "array<string>")).filter(F.size("r") >= 6)
    return made.select("file", "place", F.get("r", F.lit(0)).try_cast("long").alias("open_time"), *(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(FIELDS, 1)))


def text_of(c: str) -> Column:
    """Plain decimal text without trailing zeros; null if the value is no number."""
    return plain_decimal(F.col(c).try_cast("decimal(38,18)"))


def normalised(rows: DataFrame) -> DataFrame:
    """One row for each file and time, the last one in the file, with fields as plain decimals."""
    last = F.row_number().over(Window.partitionBy("file", "open_time").orderBy(F.desc("place")))
    return rows.filter("open_time IS NOT NULL").withColumn("n", last).filter("n = 1").select("file", "open_time", *(text_of(c).alias(c) for c in FIELDS))


def faults(rows: DataFrame, end_ms: int) -> DataFrame:
    """Rows before a sealed end as doubles, with what is wrong with each: "values" (missing or not positive), "range" (not within low and high), "order" (not after the row before)."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    made = rows.filter(F.col("open_time") < end_ms).select("file", "place", "open_time", *map(number, FIELDS))
    before = F.lag("open_time").over(Window.partitionBy("file").orderBy("place"))
    prices = F.array(*FIELDS[:4])
    values = F.exists(prices, lambda x: x.isNull() | F.isnan(x) | (x <= 0))
    outside = ~(F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high")))
    fault = F.when(values, "values").when(outside, "range").when(before >= F.col("open_time"), "order")
    return made.withColumn("fault", fault)


def profile(rows: DataFrame, step: int, start_ms: int, end_ms: int) -> DataFrame:
    """Per file in [start, end): rows, first and last time, and how many steps are missing between them."""
    kept = rows.filter((F.col("open_time") >= start_ms) & (F.col("open_time") < end_ms)).select("file", "open_time").distinct()
    out = kept.groupBy("file").agg(F.count("*").alias("rows"), F.min("open_time").alias("first_ms"), F.max("open_time").alias("last_ms"))
    return out.withColumn("missing", ((F.col("last_ms") - F.col("first_ms")) / step + 1 - F.col("rows")).cast("long"))
