"""Comparison and merging of sources that should agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.stats import relative_difference

FIELDS = ["open", "high", "low", "close"]


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} AS decimal(38, 8))")


def matched(left: DataFrame, right: DataFrame, key: list[str], fields: list[str] = FIELDS, how: str = "full_outer") -> DataFrame:
    """Both sides by key: l_<field>, r_<field>, in_left, in_right."""
    a = left.select(*key, *(F.col(c).alias(f"l_{c}") for c in fields), F.lit(True).alias("in_left"))
    b = right.select(*key, *(F.col(c).alias(f"r_{c}") for c in fields), F.lit(True).alias("in_right"))
    return a.join(b, key, how).withColumn("in_left", F.coalesce("in_left", F.lit(False))).withColumn("in_right", F.coalesce("in_right", F.lit(False)))


def row_classes(left: DataFrame, right: DataFrame, key: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """Class of every key: left_only, right_only, exact, format_only (equal numbers in other texts) or value_conflict, with the fields that differ in value."""
    both = matched(left, right, key, fields)
    differ = F.array_compact(F.array(*(F.when(~_number(f"l_{c}").eqNullSafe(_number(f"r_{c}")), F.lit(c)) for c in fields)))
    texts = F.lit(True)
    for c in fields:
        texts &= F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    kind = F.when(~F.col("in_right"), "left_only").when(~F.col("in_left"), "right_only").when(texts, "exact").when(F.size(differ) == 0, "format_only").otherwise("value_conflict")
    fields_text = F.when(F.col("in_left") & F.col("in_right"), F.array_join(differ, ",")).otherwise("")
    return both.select(*key, kind.alias("class"), fields_text.alias("fields"))


def field_differences(left: DataFrame, right: DataFrame, key: list[str], fields: list[str] = FIELDS, tolerance: float = 0.001) -> DataFrame:
    """One row for each field of a shared key that differs by more than the tolerance."""
    both = matched(left, right, key, fields, "inner")
    rows = both.select(*key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").cast("double").alias("l"), F.col(f"r_{c}").cast("double").alias("r")) for c in fields))).alias("x"))
    gap = relative_difference(F.col("x.l"), F.col("x.r"))
    return rows.filter(gap > tolerance).select(*key, "x.field", F.col("x.l").alias("left_value"), F.col("x.r").alias("right_value"), F.round(gap, 8).alias("difference"))


def overlap(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Counts of shared and one-sided keys in one row per symbol."""
    both = matched(left, right, key)
    return both.groupBy("symbol").agg(F.count_if(F.col("in_left") & F.col("in_right")).alias("shared"), F.count_if(~F.col("in_right")).alias("left_only"), F.count_if(~F.col("in_left")).alias("right_only"))


def primary_merge(primary: DataFrame, filler: DataFrame, key: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """The primary source, filled by the other one where a key is missing; a differing value blocks the row and is never overwritten."""
    both = matched(primary, filler, key, fields)
    differ = F.lit(False)
    for c in fields:
        differ |= ~_number(f"l_{c}").eqNullSafe(_number(f"r_{c}"))
    conflict = F.col("in_left") & F.col("in_right") & differ
    origin = F.when(F.col("in_left"), "primary").otherwise("fill")
    state = F.when(conflict, "blocked").otherwise("ok")
    return both.select(*key, *(F.when(F.col("in_left"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in fields), origin.alias("origin"), state.alias("state"))


def patched(primary: DataFrame, other: DataFrame, supported: DataFrame, key: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """The other source wins only at keys that a third one supports, or where the primary has none; each row says what decided."""
    both = matched(primary, other, key, fields).join(supported.select(*key, F.lit(True).alias("backed")), key, "left")
    use_other = F.col("in_right") & (~F.col("in_left") | F.coalesce("backed", F.lit(False)))
    decision = F.when(~F.col("in_left"), "filled").when(use_other, "patched").when(~F.col("in_right"), "primary_only").otherwise("primary")
    return both.select(*key, *(F.when(use_other, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in fields), decision.alias("decision"))


def majority(a: DataFrame, b: DataFrame, c: DataFrame, key: list[str], field: str = "close") -> DataFrame:
    """Three-source vote on one field: all agree, the odd one out, or no majority."""
    one = lambda df, n: df.select(*key, _number(field).alias(n))
    rows = one(a, "x").join(one(b, "y"), key).join(one(c, "z"), key, "left")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    vote = F.when(z.isNull(), F.when(x == y, "two_agree").otherwise("unresolved")).when((x == y) & (y == z), "all_agree").when(x == y, "third_differs").when(x == z, "second_differs").when(y == z, "first_differs").otherwise("no_majority")
    return rows.select(*key, vote.alias("vote"))


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed members by month. Both: month, symbol."""
    a = before.select("month", "symbol", F.lit(1).alias("b"))
    c = after.select("month", "symbol", F.lit(1).alias("a"))
    return a.join(c, ["month", "symbol"], "full_outer").filter("a IS NULL OR b IS NULL").select("month", "symbol", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))
