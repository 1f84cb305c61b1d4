"""Duplicate policies. They differ by operator on purpose: first wins, last wins, conflict, and classes of a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_wins(rows, key, [F.col(c).desc() for c in order])


def classes(rows: DataFrame, key: list[str], raw: str, values: list[str]) -> DataFrame:
    """Class of each key's rows: single, byte_identical, semantic_identical (same values, other text) or conflicting."""
    semantic = F.struct(*(F.col(c).cast("double") for c in values))
    counted = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct(raw).alias("texts"), F.count_distinct(semantic).alias("meanings"))
    kind = F.when(F.col("rows") == 1, "single").when(F.col("texts") == 1, "byte_identical").when(F.col("meanings") == 1, "semantic_identical").otherwise("conflicting")
    return counted.select(*key, "rows", kind.alias("class"), kind.isin("single", "byte_identical").alias("collapsible"))


def settlement_quality(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """Per symbol: rows, identical duplicates, conflicting times, and times kept."""
    times = rows.groupBy("symbol", ts).agg(F.count("*").alias("n"), F.count_distinct(value).alias("d"))
    return times.groupBy("symbol").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("d") == 1, F.col("n") - 1).otherwise(0)).alias("identical"),
        F.count_if(F.col("d") > 1).alias("conflicts"),
        F.count_if(F.col("d") == 1).alias("kept"),
    )


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't have, each key once (insert or ignore)."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
