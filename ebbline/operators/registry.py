"""Rules from registries: row resolutions, lifecycle claims, confirmations, plans and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.hashing import row_sha256


def resolve(rows: DataFrame, rules: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row per key: collapsed where all its rows are alike, replaced where a rule names the hash of the row to keep, else blocked.

    rules: key columns, keep_sha256. A rule whose row isn't there blocks too."""
    hashed = rows.withColumn("sha", row_sha256(*values))
    groups = hashed.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("sha").alias("kinds"), F.min("sha").alias("only"))
    plan = groups.join(rules.select(*key, "keep_sha256"), key, "left")
    chosen = plan.withColumn("sha", F.when(F.col("kinds") == 1, F.col("only")).otherwise(F.col("keep_sha256")))
    one = hashed.dropDuplicates([*key, "sha"])
    found = chosen.join(one.select(*key, "sha", *values), [*key, "sha"], "left")
    there = F.col(values[0]).isNotNull()
    outcome = F.when((F.col("kinds") == 1) & (F.col("n") == 1), "single").when(F.col("kinds") == 1, "collapsed").when(there, "replaced").otherwise("blocked")
    return found.select(*key, "n", outcome.alias("outcome"), *values)


def unused_rules(rules: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return rules.join(rows.select(*key).distinct(), key, "left_anti")


def claims(rows: DataFrame, registered: DataFrame, ends: DataFrame, ts: str = "open_time") -> DataFrame:
    """What a lifecycle registry says of each row: registered, after_end (past the symbol's end), or free. registered: symbol, ts; ends: symbol, end_ms."""
    tagged = rows.join(registered.select("symbol", ts, F.lit(True).alias("known")), ["symbol", ts], "left").join(ends, "symbol", "left")
    claim = F.when(F.col("known"), "registered").when(F.col("end_ms").isNotNull() & (F.col(ts) >= F.col("end_ms")), "after_end").otherwise("free")
    return tagged.withColumn("claim", claim).drop("known", "end_ms")


def availability(members: DataFrame, slots: DataFrame, quarantined: DataFrame, ends: DataFrame, ts: str = "open_time") -> DataFrame:
    """State of every member at every slot of its month; quarantine comes before missing, missing before the end of life.

    members: month, symbol; slots: month, ts; quarantined: symbol, ts; ends: symbol, start_ms, end_ms."""
    every = slots.join(members, "month")
    made = every.join(quarantined.select("symbol", ts, F.lit(True).alias("bad")), ["symbol", ts], "left").join(ends, "symbol", "left")
    state = F.when(F.col("bad"), "quarantined").when(F.col(ts) < F.col("start_ms"), "not_yet").when(F.col(ts) >= F.col("end_ms"), "terminated").otherwise("active")
    return made.groupBy("month", ts).agg(*(F.count_if(state == s).alias(s) for s in ("active", "not_yet", "terminated", "quarantined")))


def confirmations(rows: DataFrame, others: list[DataFrame], size: float = 0.3) -> DataFrame:
    """How many other series moved the same way and as far at the same time. All: symbol, open_time, open, high, low, close."""
    amplitude = (F.col("high") - F.col("low")) / F.greatest(F.abs("open"), F.lit(1e-18))
    base = rows.withColumn("way", F.signum(F.col("close") - F.col("open"))).filter(amplitude >= size).select("symbol", "open_time", "way")
    votes = None
    for other in others:
        one = other.withColumn("o", F.signum(F.col("close") - F.col("open"))).filter(amplitude >= size).select("symbol", "open_time", "o")
        votes = one if votes is None else votes.unionByName(one)
    hits = base.join(votes, ["symbol", "open_time"]).filter("o = way").groupBy("symbol", "open_time").agg(F.count("*").alias("confirmed"))
    joined = base.join(hits, ["symbol", "open_time"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(0)))
    return joined.withColumn("finding", F.when(F.col("confirmed") >= 2, "explained_market_move").otherwise("unresolved")).drop("way")


def best_reports(reports: DataFrame, key: str, ranks: list[str], order: str) -> DataFrame:
    """The report with the most rows and the longest span of each key; the first one wins ties."""
    w = Window.partitionBy(key).orderBy(*(F.col(r).desc() for r in ranks), order)
    return reports.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merged_plans(plans: DataFrame, key: list[str]) -> DataFrame:
    """Plans of a key as one: all reasons, sorted and distinct."""
    return plans.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.bool_or("passed").alias("passed"))


def select_scopes(months: DataFrame) -> DataFrame:
    """Months worth a second look, with why: first, middle, last, largest move, or missing slots. months: symbol, month_index, amplitude, missing."""
    w, back, count = (Window.partitionBy("symbol").orderBy("month_index"), Window.partitionBy("symbol").orderBy(F.col("month_index").desc()), Window.partitionBy("symbol"))
    n, total = F.row_number().over(w), F.count("*").over(count)
    stress = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("amplitude").desc(), "month_index"))
    made = months.select("symbol", "month_index", "missing", n.alias("n"), total.alias("total"), F.row_number().over(back).alias("b"), stress.alias("s"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n") == 1, F.lit("first")),
            F.when(F.col("b") == 1, F.lit("last")),
            F.when(F.col("n") == F.floor((F.col("total") + 1) / 2), F.lit("middle")),
            F.when(F.col("missing") > 0, F.lit("missing")),
            F.when(F.col("s") == 1, F.lit("stress")),
        )
    )
    return made.select("symbol", "month_index", F.array_join(F.array_sort(reasons), ",").alias("reasons")).filter("reasons <> ''")


def eligible_ceiling(bars: DataFrame, step: int, history: int, future: int) -> DataFrame:
    """Slots with every slot of their history and future: the most decisions that can be made."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    before = F.count("*").over(w.rangeBetween(-history * step, 0))
    after = F.count("*").over(w.rangeBetween(0, future * step))
    return bars.select("symbol", "open_time", before.alias("b"), after.alias("a")).filter((F.col("b") == history + 1) & (F.col("a") == future + 1)).select("symbol", "open_time")


def step_window(curve: DataFrame, start: int, end: int, key: str = "pair", ts: str = "day") -> DataFrame:
    """A step function within [start, end]: what held at the start stands there, what held at the end stands there too."""
    inside = curve.filter(F.col(ts).between(start, end)).select(key, ts, "equity")
    at = lambda t: curve.filter(F.col(ts) <= t).groupBy(key).agg(F.max_by("equity", ts).alias("equity")).select(key, F.lit(t).cast("long").alias(ts), "equity")
    return inside.unionByName(at(start)).unionByName(at(end)).groupBy(key, ts).agg(F.max("equity").alias("equity"))


def split(rows: DataFrame, order: list[str], later: float = 0.3, key: str = "symbol") -> DataFrame:
    """rows with sample: the first part of each key is in_sample, at least one row on either side."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    first = F.greatest(F.lit(1), F.least(F.floor(n * (1 - later)), n - 1))
    return rows.withColumn("sample", F.when(F.row_number().over(w.orderBy(*order)) <= first, "in_sample").otherwise("out_of_sample"))


def contiguous_prefix(path: DataFrame) -> DataFrame:
    """Per event how many slots follow one another from the first on. path: symbol, event_ms, slot."""
    w = Window.partitionBy("symbol", "event_ms").orderBy("slot")
    return path.withColumn("n", F.row_number().over(w)).groupBy("symbol", "event_ms").agg(F.count_if(F.col("slot") == F.col("n")).alias("prefix"), F.count("*").alias("seen"))


def cooldown(entries: DataFrame, closes: DataFrame, span: int) -> DataFrame:
    """Entries without a close of any trade within the span before. Both are cut into bins of the span, so that only two bins can matter."""
    bins = closes.select(F.col("close_ms"), F.floor(F.col("close_ms") / span).alias("bin"))
    last = bins.groupBy("bin").agg(F.collect_set("close_ms").alias("times"))
    wanted = entries.withColumn("bin", F.explode(F.array(F.floor(F.col("open_ms") / span), F.floor(F.col("open_ms") / span) - 1)))
    near = wanted.join(last, "bin").filter(F.exists("times", lambda t: (t <= F.col("open_ms")) & (t > F.col("open_ms") - span)))
    return entries.join(near.select("trade_id").distinct(), "trade_id", "left_anti")
