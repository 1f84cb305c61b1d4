"""Point-in-time universes: monthly ranking, eligibility, entrants, exits, and quarantine of bad slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def month_index(ts: str):
    """Months since year 0 of an epoch time."""
    t = F.timestamp_millis(F.col(ts))
    return F.year(t) * 12 + F.month(t) - 1


def monthly_volumes(panel: DataFrame, history: int, least: int) -> DataFrame:
    """Per month and symbol: median quote volume of the days of the `history` days before the month, and whether there are enough of them.

    A day feeds the months whose look-back holds it, so days are dealt to months and no range join is needed."""
    back = -(-history // 28) + 1
    day = F.floor(F.col("day_ms") / DAY).cast("long")
    dealt = panel.select("symbol", day.alias("day"), "quote_volume", F.explode(F.sequence(F.lit(0), F.lit(back))).alias("ahead"))
    start = F.add_months(F.trunc(F.date_from_unix_date(F.col("day").cast("int")), "month"), F.col("ahead") + 0)
    rows = dealt.withColumn("start", F.datediff(start, F.to_date(F.lit("1970-01-01")))).filter((F.col("day") < F.col("start")) & (F.col("day") >= F.col("start") - history))
    made = rows.withColumn("month", F.year(F.date_from_unix_date("start")) * 12 + F.month(F.date_from_unix_date("start")) - 1)
    return made.groupBy("month", "symbol").agg(F.percentile("quote_volume", F.lit(0.5)).alias("median_volume"), F.count("*").alias("days")).withColumn("eligible", F.col("days") >= least)


def membership(volumes: DataFrame, size: int) -> DataFrame:
    """The largest eligible symbols of each month, ranked by median volume, ties by symbol."""
    w = Window.partitionBy("month").orderBy(F.col("median_volume").desc(), "symbol")
    return volumes.filter("eligible").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("month", "symbol", "rank", "median_volume")


def eligibility(volumes: DataFrame, size: int, excluded: list[str] = ()) -> DataFrame:
    """Status of every symbol and month: excluded before short_history before ranked_out before member."""
    w = Window.partitionBy("month").orderBy(F.col("open_to_rank").desc(), F.col("median_volume").desc(), "symbol")
    barred = F.col("symbol").isin(list(excluded)) if excluded else F.lit(False)
    made = volumes.withColumn("barred", barred).withColumn("open_to_rank", F.col("eligible") & ~F.col("barred")).withColumn("place", F.row_number().over(w))
    status = F.when(F.col("barred"), "excluded").when(~F.col("eligible"), "short_history").when(F.col("place") > size, "ranked_out").otherwise("member")
    return made.select("month", "symbol", status.alias("status"))


def entrants(members: DataFrame) -> DataFrame:
    """Members that were not members the month before; the first month has none."""
    genesis = members.agg(F.min("month").alias("genesis"))
    before = members.select((F.col("month") + 1).alias("month"), "symbol")
    new = members.join(before, ["month", "symbol"], "left_anti")
    return new.join(F.broadcast(genesis)).filter("month > genesis").select("month", "symbol", "rank")  # one row


def best_entrants(members: DataFrame) -> DataFrame:
    w = Window.partitionBy("month").orderBy("rank", "symbol")
    return entrants(members).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def exits(members: DataFrame) -> DataFrame:
    """Months whose next month lacks the member, but for the last month."""
    last = members.agg(F.max("month").alias("final"))
    after = members.select((F.col("month") - 1).alias("month"), "symbol")
    return members.join(after, ["month", "symbol"], "left_anti").join(F.broadcast(last)).filter("month < final").select("month", "symbol", "rank")  # one row


def active(rows: DataFrame, members: DataFrame, ts: str) -> DataFrame:
    """Rows whose symbol is a member in the row's month."""
    return rows.withColumn("month", month_index(ts)).join(members.select("month", "symbol"), ["month", "symbol"], "left_semi")


def invalid_slots(rows: DataFrame, members: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """Slots at which so many members are invalid that the whole slot is masked.

    rows: symbol, open_time, month, valid. members: month, symbol. Per slot: active, observed, invalid, duplicates,
    strangers, missing, and the verdict; blockers come before events, in this order: duplicate, non_member, missing."""
    tagged = rows.join(members.select("month", "symbol", F.lit(True).alias("member")), ["month", "symbol"], "left")
    one = tagged.groupBy("month", "open_time", "symbol").agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"), F.max("member").alias("member"))
    size = members.groupBy("month").agg(F.count_distinct("symbol").alias("active"))
    slots = one.groupBy("month", "open_time").agg(
        F.count_if(F.col("member")).alias("observed"),
        F.count_if(F.col("member") & ~F.col("valid")).alias("invalid"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(F.col("member").isNull()).alias("strangers"),
    )
    made = slots.join(size, "month").withColumn("missing", F.col("active") - F.col("observed"))
    verdict = (
        F.when(F.col("invalid") == 0, "clean")
        .when(F.col("duplicates") > 0, "blocked_duplicate")
        .when(F.col("strangers") > 0, "blocked_non_member")
        .when(F.col("missing") > 0, "blocked_missing")
        .when((F.col("invalid") >= least) & (F.col("invalid") >= share * F.col("active")), "event")
        .otherwise("blocked_isolated")
    )
    return made.select("month", "open_time", "active", "observed", "invalid", "duplicates", "strangers", "missing", verdict.alias("verdict"))


def slot_mask(slots: DataFrame, members: DataFrame) -> DataFrame:
    """(symbol, open_time) of all members, valid or not, at the slots of events."""
    return slots.filter("verdict = 'event'").select("month", "open_time").join(members.select("month", "symbol"), "month").select("symbol", "open_time")


def masked(rows: DataFrame, mask: DataFrame) -> DataFrame:
    return rows.join(mask, ["symbol", "open_time"], "left_anti")


def panel_status(bars: DataFrame, mask: DataFrame, step: int) -> DataFrame:
    """Per symbol and month: observed and masked slots, those left, and the state."""
    both = bars.select("symbol", "open_time").join(mask.select("symbol", "open_time", F.lit(1).alias("m")), ["symbol", "open_time"], "left").withColumn("month", month_index("open_time"))
    out = both.groupBy("symbol", "month").agg(F.count("*").alias("observed"), F.count("m").alias("masked_slots"))
    left = F.col("observed") - F.col("masked_slots")
    return out.select("symbol", "month", "observed", "masked_slots", left.alias("valid"), F.when(F.col("masked_slots") == 0, "clean").when(left == 0, "quarantined").otherwise("partial").alias("state"))


def overlapping_epochs(epochs: DataFrame) -> DataFrame:
    """Neighbouring validity ranges of a symbol that overlap."""
    ahead = F.lead("start_ms").over(Window.partitionBy("symbol").orderBy("start_ms", "end_ms"))
    return epochs.withColumn("next_start", ahead).filter(F.col("next_start") < F.col("end_ms"))
