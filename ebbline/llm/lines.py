"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it divided by the host's
pages; a line above the ratio is boilerplate and goes, whatever the host's size, if it stands on ``LEAST_HITS`` pages:
on fewer, a share says nothing. Pages with the same text count once: copies of a page, however many, don't turn its
own lines into boilerplate.

Plan: lines are counted by a 64-bit hash with map-side combine, two levels deep (page, then line), so that a line or a
host with a third of all rows spreads. A host's boilerplate lines (at most the lines of a page by the ratio) are one
row of ``BUCKETS`` short lists, so a line is looked up in one of them; the table is broadcast if its lines were counted
and are few, else joined by host with Spark's skew split. Texts are cut in place.

Defined results: a null text stays null and isn't a page; a null host is a host of its own; blank lines always stay;
repeated rows are cleaned one by one and count as one page; very long texts are split and counted whole; a line exactly
at the ratio stays; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import BLANKS, cut, let, maybe_broadcast, plain

#: Above this share of a host's pages a line is boilerplate, if it stands on so many of them.
RATIO, LEAST_HITS = 0.1, 3
#: Lists that a host's boilerplate lines are dealt to.
BUCKETS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_hits: int = LEAST_HITS) -> DataFrame:
    """host, line (hash), hits and pages of every boilerplate line."""
    pages = docs.filter(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    totals = cut(pages.groupBy("host").agg(F.count_distinct("page").alias("pages")))
    wordy = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = pages.select("host", "page", F.explode(F.array_distinct(F.transform(wordy, _hash))).alias("line"))
    hits = rows.groupBy("host", "line").agg(F.count_distinct("page").alias("hits")).filter(F.col("hits") >= least_hits)
    small = maybe_broadcast(totals.withColumnRenamed("host", "of"), totals.count())
    return hits.join(small, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("hits") > ratio * F.col("pages")).select("host", "line", "hits", "pages")


def _bucket(line: Column) -> Column:
    return F.pmod(line, F.lit(BUCKETS)).cast("int")


def clean(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> tuple[DataFrame, str]:
    """docs with a column more, the number of lines that went, whose name is returned too; texts have no boilerplate lines."""
    rows, names, (at_host, at_text) = plain(docs, host, text)
    lists = boilerplate(rows, at_host, at_text, **limits).groupBy("host", _bucket(F.col("line")).alias("bucket")).agg(F.collect_list("line").alias("lines"))
    by_host = lists.groupBy("host").agg(F.sum(F.size("lines")).alias("n"), F.map_from_entries(F.collect_list(F.struct("bucket", "lines"))).alias("lists"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("lists", b), F.array().cast("array<bigint>")))
    found = cut(by_host.select(F.col("host").alias("of"), "n", every.alias("bad")))
    # what a broadcast holds is counted in lines, and a list for each bucket
    size = found.agg(F.coalesce(F.sum(F.col("n") + BUCKETS), F.lit(0))).first()[0]
    joined = rows.join(maybe_broadcast(found, size), F.col(at_host).eqNullSafe(F.col("of")), "left")
    lines = _lines(F.col(at_text))
    gone = lambda x: let(_hash(x), lambda h: F.array_contains(F.get("bad", _bucket(h)), h))
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~gone(x))
    cleaned = F.when(F.col("bad").isNull(), F.col(at_text)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("bad").isNotNull() & F.col(at_text).isNotNull(), F.size(lines) - F.size(kept)).otherwise(0)
    own = [cleaned.alias(f"c{i}") if f"c{i}" == at_text else F.col(f"c{i}") for i in range(len(names))]
    more = next(c for c in ("n_dropped", *(f"n_dropped_{i}" for i in range(len(names) + 1))) if c not in names)
    return joined.select(*own, dropped.cast("long").alias("dropped")).toDF(*names, more), more


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the cleaned text, its length and the number of dropped lines."""
    out, dropped = clean(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col(dropped).alias("n_dropped"))


def stage(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts; n_chars, where there is one, follows the text."""
    out, _ = clean(docs)
    rows, names, (at_text,) = plain(out, "text")
    names.pop()
    length = F.coalesce(F.length(at_text), F.lit(0))
    cols = [length.cast(docs.schema[i].dataType).alias(f"c{i}") if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(names)]
    return rows.select(*cols).toDF(*names)


#: The same in DuckDB SQL.
ORACLE = f"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT source, count(DISTINCT text) AS pages FROM p GROUP BY source),
x AS (SELECT DISTINCT source, text, trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM p, unnest(l) AS u(line)),
b AS (
  SELECT source, line FROM x JOIN t USING (source) WHERE line <> ''
  GROUP BY source, line, pages HAVING count(*) >= {LEAST_HITS} AND count(*) > {RATIO} * pages),
h AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
c AS (
  SELECT doc_id, text, l,
         list_filter(l, lambda y: NOT coalesce(list_contains(bad, trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS k
  FROM p LEFT JOIN h USING (source))
SELECT doc_id, array_to_string(k, chr(10)) AS text, CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS n_chars, CAST(len(l) - len(k) AS BIGINT) AS n_dropped FROM c"""
