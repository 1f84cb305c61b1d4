"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Native: features, rules and the trees' scores are Spark SQL expressions. The trees are fitted on a bounded sample of
labelled urls (``SAMPLE`` of each class, those with the smallest hash) and compiled into one expression. Statistics of
a suffix are counted over all labelled urls, each different one once, and joined back: broadcast if they are few.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of the
model for its features (of the empty url if null); very long urls are read whole; repeated rows are judged one by one
and count once for the model; of rules that fit the longest wins; a score of exactly one half blocks; without labelled
urls of both classes every url that no rule fits is allowed; an empty table gives an empty result; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import ascii_lower, cut, let, maybe_broadcast

#: Host, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words whose presence in a host labels a url as unwanted for training.
UNWANTED = ("casino", "pills", "bets", "spam", "ads", "poker", "porn", "viagra", "loans", "replica")
#: Labelled urls of each class that the trees are fitted on at most.
SAMPLE = 4096
ROUNDS, DEPTH, RATE, LEAF, CUTS = 24, 3, 0.3, 8, 16
#: Urls of the overall rate that smooth each suffix's own.
SMOOTHING = 10

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "hyphens", "longest_label", "digit_ratio", "entropy", "host_entropy", "parameters", "fragment", "secure", "suffix_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    full = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(full, pattern, 1)), F.regexp_extract(full, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def over(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) == 0, 0.0).otherwise(let(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1))), over))


def features(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, url, host, path, suffix and the lexical features but for suffix_rate."""
    host, path = parts(F.col(url))
    split = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url"), host.alias("host"), path.alias("path"))
    u, h = F.col("__url"), F.col("host")
    names = F.split(h, r"\.")
    return split.select(
        "*",
        F.element_at(names, -1).alias("__suffix"),
        *(
            value.cast("double").alias(name)
            for name, value in {
                "length": F.length(u),
                "host_length": F.length(h),
                "path_length": F.length("path"),
                "depth": F.regexp_count("path", F.lit("/[^/]")),
                "labels": F.size(names),
                "hyphens": F.regexp_count(h, F.lit("-")),
                "longest_label": F.array_max(F.transform(names, lambda n: F.length(n))),
                "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(u, F.lit("[0-9]")), F.length(u)), F.lit(0.0)),
                "entropy": _entropy(u),
                "host_entropy": _entropy(h),
                "parameters": F.regexp_count(u, F.lit("[?&][^=&#]+=")),
                "fragment": F.contains(u, F.lit("#")).cast("int"),
                "secure": F.startswith(ascii_lower(u), F.lit("https://")).cast("int"),
            }.items()
        ),
    )


def weak_label(host: Column) -> Column:
    """1 for a host with an unwanted word between its hyphens and dots, else 0."""
    return F.when(host.rlike(r"(?:^|[.-])(?:" + "|".join(UNWANTED) + r")(?:$|[.-])"), 1).otherwise(0)


@dataclass(frozen=True)
class Model:
    """rate: share of unwanted urls, also of an unknown suffix; trees: nested (feature, cut, left, right) or a leaf's value."""

    prior: float = -5.0
    rate: float = 0.0
    trees: tuple = ()

    def score(self) -> Column:
        """Probability that a url is unwanted."""

        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, left, right = node
            return F.when(F.col(name) <= cut, of(left)).otherwise(of(right))

        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int):
    """One regression tree by exact gains over the cuts."""
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None)
    if depth and len(grad) >= 2 * LEAF:
        for j, cut in enumerate(cuts):
            for c in cut:
                left = x[:, j] <= c
                n = int(left.sum())
                if n < LEAF or len(grad) - n < LEAF:
                    continue
                gl, hl = grad[left].sum(), hess[left].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0]:
                    best = (gain, (j, float(c), left))
    if best[1] is None:
        return float(RATE * g / (h + 1))
    j, c, left = best[1]
    return (FEATURES[j], c, _grow(x[left], grad[left], hess[left], cuts, depth - 1), _grow(x[~left], grad[~left], hess[~left], cuts, depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    name, cut, left, right = tree
    return np.where(x[:, FEATURES.index(name)] <= cut, _apply(left, x), _apply(right, x))


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """__of and suffix_rate: the smoothed share of unwanted urls of each suffix, over all different labelled urls."""
    counts = labelled.groupBy("__suffix", "label", F.xxhash64("__url")).agg(F.lit(1)).groupBy("__suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    counts = cut(counts)
    rate = overall_rate(counts)
    return counts.select(F.col("__suffix").alias("__of"), ((F.col("bad") + SMOOTHING * rate) / (F.col("n") + SMOOTHING)).alias("suffix_rate"))


def overall_rate(counts: DataFrame) -> float:
    """The share of unwanted urls over all suffixes."""
    return counts.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0))).first()[0]


def with_rates(made: DataFrame, rates: DataFrame, size: int, rate: float) -> DataFrame:
    """features() and suffix_rate."""
    joined = made.join(maybe_broadcast(rates, size), F.col("__suffix") == F.col("__of"), "left")
    return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(rate))).drop("__of")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: features(), suffix_rate and label (0 or 1). The sample of each class is its urls with the smallest hash.

    Only urls below a hash that leaves about twice the sample of different urls are sorted, each once: what tasks send
    doesn't grow with their number, and how often they are repeated changes nothing."""
    rows = []
    hashed = labelled.select("label", F.xxhash64("__url").alias("__h"), "__url", *FEATURES)
    # the estimate may be wrong by half before the sample is
    counts = dict(hashed.groupBy("label").agg(F.approx_count_distinct("__h", 0.02)).collect())
    for label in (0, 1):
        share = min(1.0, 2 * sample / max(1, counts.get(label, 0)))
        few = hashed.filter((F.col("label") == label) & (F.col("__h") / 2.0**64 + 0.5 <= share)).dropDuplicates(["__url"])
        rows += [(label, [r[n] for n in FEATURES]) for r in few.orderBy("__h", "__url").limit(sample).collect()]
    y = np.array([r[0] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Model()
    rate = float(y.mean())
    x = np.array([r[1] for r in rows])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    prior = float(np.log(rate / (1 - rate)))
    total, trees = np.full(len(y), prior), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, y - p, p * (1 - p), cuts, DEPTH)
        trees.append(tree)
        total += _apply(tree, x)
    return Model(prior, rate, tuple(trees))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame, int]:
    """The model of features() with label, its suffix rates, and how many suffixes they have."""
    rates = cut(suffix_rates(labelled))
    size = rates.count()
    return fit(with_rates(labelled, rates, size, 0.0), sample), rates, size


def judge(pages: DataFrame, learnt: tuple[Model, DataFrame, int] | None = None, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per page host, path, rule, verdict and the model's score. Without something learnt, weakly labelled urls of the same pages are learnt from."""
    made = features(pages, url, keep)
    model, rates, size = learnt or learn(made.withColumn("label", weak_label(F.col("host"))))
    scored = with_rates(made, rates, size, model.rate).withColumn("score", model.score())
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(*keep, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
