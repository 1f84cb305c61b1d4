"""Quality rules: a threshold table compiled into one Spark projection.

Native: split, higher-order functions and regular expressions of Spark SQL only; no shuffle.

Defined results: a null text counts as the empty one (all measures 0, base_failed); a null id stays null; repeated
rows are judged one by one; very long texts are measured whole; a measure exactly at a bound passes; an empty table
gives an empty result; other columns are left out by judge() and kept by keep_good(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import BLANK_RUN, blank_words, let, plain

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from or an "
    "le la les de des du et un une que qui dans pour par sur est en au avec ce "
    "der die das und ist den dem ein eine von mit zu nicht auf für als auch sich im "
    "el los las una y del por con para su se no lo al como"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high, or if it has fewer words than from_words."""

    measure: str
    low: float
    high: float
    from_words: int = 0


#: The threshold table.
RULES = (
    Rule("n_words", 10, float("inf")),
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", 0.0, 0.25),
    Rule("stop_word_ratio", 0.02, 1.0, from_words=80),
    Rule("dup_line_ratio", 0.0, 0.6),
    Rule("repeat_ratio", 0.0, 0.2),
    Rule("bang_ratio", 0.0, 0.3),
    Rule("long_word_ratio", 0.0, 0.05, from_words=20),
    Rule("echo_ratio", 0.0, 0.25),
)


def _repeat_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more: equal windows stand side by side in sorted order."""

    def spread(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return let(F.sort_array(F.filter(at, lambda i: i.isNotNull())), covered)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p) + 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g.cast("long"))

    ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ranked, spread))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and every measure of the threshold table."""
    wordy = r"[^ \t\n\x0B\f\r]"
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
        *keep,
        "__text",
        blank_words(F.col("__text")).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: line.rlike(wordy)).alias("__lines"),
    )
    hashed = split.select("*", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"))
    at = lambda i, k: F.get(F.col("__hash"), i + k)
    grams = hashed.select(
        "*",
        F.when(
            F.size("__hash") < WINDOW,
            F.array().cast("array<bigint>"),
        )
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("__hash") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
        .alias("__grams"),
    )
    stops = F.array(*(F.xxhash64(F.lit(w)) for w in STOP_WORDS))
    stop_hash = F.transform("__words", lambda w: F.when(F.length(w) <= 5, F.xxhash64(F.lower(F.rtrim(w, F.lit(".,;:"))))))
    counted = grams.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__grams")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter(stop_hash, lambda h: F.array_contains(stops, h))).cast("long").alias("n_stop_words"),
        F.size(F.filter("__words", lambda w: w.endswith("!!"))).cast("long").alias("n_bangs"),
        F.size(F.filter("__words", lambda w: F.length(w) > 40)).cast("long").alias("n_long_words"),
        F.size(F.filter(F.transform("__hash", lambda h, i: F.coalesce(at(i, -1) == h, F.lit(False))), lambda same: same)).cast("long").alias("n_echoes"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("n_bangs", "n_words").alias("bang_ratio"),
        share("n_long_words", "n_words").alias("long_word_ratio"),
        share("n_echoes", "n_words").alias("echo_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    passed = F.lit(True)
    for r in rules:
        within = F.col(r.measure).between(F.lit(r.low), F.lit(r.high))
        passed &= within | (F.col("n_words") < r.from_words) if r.from_words else within
    return passed


def broken_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the measures that are out of bounds, comma-joined."""
    bad = lambda r: ~F.col(r.measure).between(F.lit(r.low), F.lit(r.high)) & (F.col("n_words") >= r.from_words)
    return F.concat_ws(",", *(F.when(bad(r), F.lit(r.measure)) for r in rules))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document its measures, base_failed, kept and the rules that it breaks."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text, keep).select("*", base_failed.alias("base_failed"), (~base_failed & verdict(rules)).alias("kept"), broken_rules(rules).alias("broken"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    A row passes through a generator that gives one row or none: a filter on the verdict would be pushed below the
    projections, and every measure copied into it again and again."""
    rows, names, (at,) = plain(docs, "text")
    packed = rows.select(F.struct(*rows.columns).alias("__row"), F.col(at).alias("__in"))
    judged = judge(packed, "__in", ("__row",), rules).select(F.explode_outer(F.when(F.col("kept"), F.array("__row"))).alias("__out"))
    return judged.filter("__out IS NOT NULL").select(*(F.col("__out").getField(f"c{i}") for i in range(len(names)))).toDF(*names)


#: The same verdict in DuckDB SQL.
def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = " AND ".join(
        f"({r.measure} BETWEEN {r.low} AND {'1e308' if r.high == float('inf') else r.high}" + (f" OR n_words < {r.from_words}" if r.from_words else "") + ")" for r in rules
    )
    share = lambda a, b, c: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0) AS {c}"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM base, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) ELSE [] END) AS u(i)),
hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM hit) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: length(x) <= 5 AND lower(rtrim(x, '.,;:')) IN ({stops}))) AS n_stop_words,
         len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_bangs,
         len(list_filter(w, lambda x: length(x) > 40)) AS n_long_words,
         len(list_filter(range(2, len(w) + 1), lambda x: w[x] = w[x - 1])) AS n_echoes
  FROM base LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, {share("word_chars", "n_words", "mean_word_length")}, {share("n_symbols", "n_words", "symbol_ratio")},
         {share("n_stop_words", "n_words", "stop_word_ratio")}, {share("n_dup_lines", "n_lines", "dup_line_ratio")},
         {share("n_repeat_words", "n_words", "repeat_ratio")}, {share("n_bangs", "n_words", "bang_ratio")},
         {share("n_long_words", "n_words", "long_word_ratio")}, {share("n_echoes", "n_words", "echo_ratio")},
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept
FROM r"""
