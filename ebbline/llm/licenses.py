"""License scans: a positional index of rare license words.

Native: Spark SQL functions only. Every template has a mandatory key phrase. The index holds postings for its rarest
words (highest inverse document frequency over the whole corpus, ``RARE`` at most): the word and its place in the
phrase. A file looks its own words up; each hit gives a start of the template, by relative position, and the starts of
all postings of a template are intersected. Where they agree the key phrase is verified word by word. A key phrase
holds all its postings' words at their places, so no place is lost.

Defined results: a null text counts as the empty one (no words, no places, null first_word and last_word, empty
labels, score 0); a null id stays null; repeated rows are scanned one by one; very long texts are scanned whole; of
equally rare words the first in the alphabet counts; an empty table gives an empty result; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import ascii_lower, let

#: Between words: ASCII that is neither a digit nor a lower-case letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words: the passage; key: its mandatory phrase, a part of it."""

    label: str
    key: str
    words: str = ""
    base: bool = False

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def all_words(self) -> list[str]:
        return (self.words or self.key).split()

    @property
    def offset(self) -> int:
        """Where the key phrase starts in the passage."""
        every, key = self.all_words, self.key_words
        return next(i for i in range(len(every)) if every[i : i + len(key)] == key)


#: The base phrases and their labels, then the method's own.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl", "gnu gpl"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
    Template("reserved", "all rights reserved"),
)


def words(text: Column) -> Column:
    """Words of a text in ASCII lower case."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def frequencies(split: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates stands, and under "" the number of documents: one row for all, whatever the input's size."""
    counts = split.agg(F.count("*"), *(F.count_if(F.array_contains("__words", w)).alias(f"c{i}") for i, w in enumerate(vocabulary))).first()
    return dict(zip(["", *vocabulary], counts, strict=True))


#: Postings of a template at most, and the share of documents beyond which a word has none, unless it is the template's rarest.
RARE, COMMON = 3, 0.2


def index(templates: tuple[Template, ...], df: dict[str, int], documents: int) -> list[list[tuple[str, int]]]:
    """For each template its postings: a rare word of the key phrase and the word's place from the phrase's start, rarest first."""
    found = []
    for t in templates:
        ranked = sorted(enumerate(t.key_words), key=lambda x: (df.get(x[1], 0), x[1], x[0]))
        found.append([(w, at) for k, (at, w) in enumerate(ranked[:RARE]) if not k or df.get(w, 0) <= COMMON * documents])
    return found


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words and places: an array of {at, template, score} with the start of each verified key phrase."""
    split = docs.select(*keep, words(F.col(text)).alias("__words"))
    vocabulary = sorted({w for t in templates for w in t.key_words})
    # the same words in a lighter form: only those of the vocabulary are looked up
    light = docs.select(F.array_distinct(F.filter(words(F.col(text)), lambda w: w.isin(vocabulary))).alias("__words"))
    counts = frequencies(light, vocabulary)
    postings = index(templates, counts, counts.pop(""))
    anchors = sorted({w for p in postings for w, _ in p})

    hit = F.transform("__words", lambda x, i: F.when(x.isin(anchors), F.struct(x.alias("w"), i.alias("i"))))
    looked = split.withColumn("__hits", F.filter(hit, lambda h: h.isNotNull()))
    w = F.col("__words")
    keys = F.array(*(F.array(*map(F.lit, t.key_words)) for t in templates))
    every = F.array(*(F.array(*map(F.lit, t.all_words)) for t in templates))
    offsets = F.array(*(F.lit(t.offset) for t in templates))

    def starts(n: int) -> Column:
        """Where all postings of a template say that it starts."""
        of = lambda word, at: F.transform(F.filter("__hits", lambda h: h["w"] == word), lambda h: h["i"] - at)
        first, *more = (of(word, at) for word, at in postings[n])
        for other in more:
            first = F.array_intersect(first, other)
        return F.transform(first, lambda at: F.struct(at.alias("at"), F.lit(n).alias("t")))

    def place(p: Column) -> Column:
        at = p["at"]
        key = F.get(keys, p["t"])
        same = (at >= 0) & (F.slice(w, F.greatest(at, F.lit(0)) + 1, F.size(key)) == key)

        def coverage(passage: Column) -> Column:
            first = at - F.get(offsets, p["t"])
            agree = F.filter(F.transform(passage, lambda x, j: F.coalesce(F.get(w, F.when(first + j >= 0, first + j)) == x, F.lit(False))), lambda b: b)
            return F.size(agree) / F.size(passage)

        return F.when(same, F.struct(at.cast("long").alias("at"), p["t"].alias("template"), let(F.get(every, p["t"]), coverage).alias("score")))

    none = F.array().cast("array<struct<at:bigint,template:int,score:double>>")
    tried = F.concat(*(starts(n) for n in range(len(templates))))
    found = F.when(F.size("__hits") == 0, none).otherwise(F.filter(F.transform(tried, place), lambda h: h.isNotNull()))
    return looked.select(*keep, F.size(w).cast("long").alias("n_words"), found.alias("places"))


def digest(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Counts and ends of the base places, labels and score."""
    found = scan(docs, text, templates)
    base_ids = [i for i, t in enumerate(templates) if t.base]
    names = F.array(*(F.lit(t.label) for t in templates))
    base = found.select("*", F.filter("places", lambda p: p["template"].isin(base_ids)).alias("__base"))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: F.get(names, p["template"])))), ",")
    at = F.transform("__base", lambda p: p["at"])
    return base.select(
        "doc_id",
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        label("__base").alias("base_labels"),
        label("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The digest in DuckDB SQL: every word of every document is tried as a start."""
    rows = ",\n".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.key_words}, {t.all_words}, {t.offset})" for i, t in enumerate(templates))
    return f"""
WITH t(id, label, base, k, p, o) AS (VALUES {rows}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
h AS (
  SELECT doc_id, i, id, label, base,
         len(list_filter(range(len(p)), lambda j: i - o + j >= 0 AND coalesce(w[i - o + j + 1] = p[j + 1], false))) / CAST(len(p) AS DOUBLE) AS score
  FROM s JOIN t ON w[i + 1] = k[1] AND w[i + 1:i + len(k)] = k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (base) AS n_base, CAST(min(i) FILTER (base) AS BIGINT) AS first_word, CAST(max(i) FILTER (base) AS BIGINT) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM h GROUP BY doc_id) USING (doc_id)"""
