"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Native: regular expressions and higher-order functions of Spark SQL only; no shuffle. A pattern's matches come from
regexp_extract_all, their places from the lengths of the pieces that split() leaves between them.

Defined results: a null text counts as the empty one (no spans, the hash of the empty string); a null id stays null;
repeated rows are searched one by one; very long texts are searched whole; spans of equal start are ordered by kind; an
empty table gives an empty result; other columns, whatever their names, are left out by ``digest`` and kept by
``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import let, plain

#: One part of an address, leading zeros allowed, at most 255.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """pattern: possessive, and begun only where a run begins, so that no text takes quadratic time. needs: a character without which nothing matches."""

    name: str
    pattern: str
    needs: str
    score: float
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6),
    # from where a run of digits begins to its end: a shorter or longer run is no card, whatever follows
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "", 0.6),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.5, base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.3, base=False),
)
#: Context words in lower case that raise a kind's score.
CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social security", "tax id"],
}
#: What a passed checksum and a context word add, and what a span of the method's own kinds needs.
CHECKED, NEAR, ENOUGH, REACH = 0.4, 0.3, 0.6, 40
#: What a letter of an account number stands for.
_LETTERS = {chr(65 + i): str(10 + i) for i in range(26)}


def characters(text: Column) -> Column:
    """The code points of a text that isn't empty."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def before(sizes: Column, block: int = 1024) -> Column:
    """The sum of the sizes before each element, by blocks: appending to one array would take quadratic time."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all"))
    cuts = F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
    sums = F.transform(cuts, lambda c: F.aggregate(c, start, step))
    shift = lambda s: F.zip_with(s, F.aggregate(s, start, lambda a, x: step(a, x["sum"]), lambda a: a["all"]), lambda x, o: F.transform(x["all"], lambda v: v + o))
    return let(sums, lambda s: F.flatten(shift(s)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(characters(F.reverse(digits)), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, twice(d)).otherwise(d)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 after its country and check digits have moved to the end."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    letters = F.create_map(*(F.lit(x) for pair in _LETTERS.items() for x in pair))
    parts = F.transform(characters(moved), lambda c: F.coalesce(F.try_element_at(letters, c), c))
    step = lambda a, x: (a * F.when(F.length(x) == 2, 100).otherwise(10) + x.cast("int")) % 97
    return F.aggregate(parts, F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda a: F.when(F.length(a).between(15, 34), mod97(a)).otherwise(F.lit(False)))
    return F.lit(True)


def _spans(kind: Kind, rank: int, text: Column) -> Column:
    """Array of {start, rank, end, score}, code points, end exclusive; those that fail the check are gone."""

    def placed(found: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda pieces: spans(found, pieces))

    def spans(found: Column, pieces: Column) -> Column:
        # a match starts after all earlier matches and the pieces up to it; the last piece has no match
        parts = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("g"), F.length(m).alias("s")))
        starts = let(parts, lambda z: F.zip_with(before(F.transform(z, lambda x: x["g"] + x["s"])), z, lambda p, x: p + x["g"]))
        around = lambda i: F.lower(F.concat(F.right(F.get(pieces, i), F.lit(REACH)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(REACH))))
        return let(starts, lambda at: F.filter(F.transform(found, lambda m, i: span(m, F.get(at, i), around(i))), lambda x: x.isNotNull()))

    def span(match: Column, start: Column, around: Column) -> Column:
        end = start + F.length(match)
        near = around.rlike(r"(?<![a-z])(?:" + "|".join(CONTEXT[kind.name]) + r")(?![a-z])")
        checked = CHECKED if kind.name in ("card", "iban") else 0.0
        score = F.least(F.lit(1.0), F.lit(kind.score + checked) + F.when(near, NEAR).otherwise(0.0))
        made = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), score.alias("score"))
        ok = valid(kind.name, match)
        return F.when(ok if kind.base else ok & (score >= ENOUGH), made)

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,score:double>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    hit = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")
    return F.when(hit, let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))).otherwise(none)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the spans of every kind as arrays, and the highest score."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return source.select(*keep, *(_spans(k, i, F.col("__text")).alias(f"{k.name}_spans") for i, k in enumerate(KINDS)))


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts by kind, the hash of the base spans, all spans and the highest score."""
    found = find(docs, text)
    base = F.concat(*(F.col(f"{k.name}_spans") for k in KINDS if k.base))
    more = F.concat(*(F.col(f"{k.name}_spans") for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(more).alias("spans"),
        F.coalesce(F.array_max(F.transform(more, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def furthest(ends: Column, block: int = 1024) -> Column:
    """The largest value up to each element, by blocks as in ``before``."""
    start = F.struct(F.lit(0).cast("long").alias("top"), F.array().cast("array<bigint>").alias("all"))
    step = lambda a, x: let(F.greatest(a["top"], x), lambda m: F.struct(m.alias("top"), F.array_append(a["all"], m).alias("all")))
    cuts = F.transform(F.sequence(F.lit(0), ((F.size(ends) - 1) / block).cast("int")), lambda b: F.slice(ends, b * block + 1, block))
    tops = F.transform(cuts, lambda c: F.aggregate(c, start, step))
    earlier = lambda t: F.aggregate(t, start, lambda a, x: F.struct(F.greatest(a["top"], x["top"]).alias("top"), F.array_append(a["all"], a["top"]).alias("all")), lambda a: a["all"])
    return let(tops, lambda t: F.flatten(F.zip_with(t, earlier(t), lambda x, o: F.transform(x["all"], lambda v: F.greatest(v, o)))))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by <KIND>; a span that begins inside earlier ones is covered with them and has no mark of its own."""
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))

    def cut_at(s: Column, tops: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(tops, i - 1))
            kept = F.substr(text, (done + 1).cast("int"), (x["start"] - done).cast("int"))
            return F.when(x["start"] >= done, F.concat(kept, F.get(names, x["rank"]))).otherwise("")

        tail = F.substr(text, (F.array_max(tops) + 1).cast("int"))
        return F.concat(F.array_join(F.transform(s, piece), ""), tail)

    ordered = F.sort_array(spans)
    body = let(ordered, lambda s: let(furthest(F.transform(s, lambda x: x["end"])), lambda tops: cut_at(s, tops)))
    return F.when(F.size(spans) == 0, text).otherwise(body)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the spans of ``find``, of every kind, replaced by <KIND>; other columns stay."""
    rows, names, (at,) = plain(docs, text)
    full = F.coalesce(F.col(at), F.lit(""))
    spans = F.concat(*(_spans(k, i, full) for i, k in enumerate(KINDS)))
    return rows.withColumn(at, redacted(full, spans)).toDF(*names)
