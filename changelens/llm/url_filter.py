"""URL filter: explicit rules, then gradient-boosted trees on lexical features. DataFrame functions only.

The trees are fitted on a bounded sample of labelled URLs (binned features, at most `sample` rows, which is all that
reaches the driver) and become one column expression, so that every URL is judged inside whole-stage code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rule and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

FEATURES = ("length", "host_length", "depth", "labels", "digit_share", "hyphens", "parameters", "entropy", "suffix_rate")


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict. Of equal length, the first as text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=False):
        of, _, start = name.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character over letters, digits and the usual signs of a URL; the rest counts as one more sign."""
    total = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = [F.length(text) - F.length(F.regexp_replace(text, f"(?i)[{c}]" if c.isalnum() else f"\\{c}", "")) for c in "abcdefghijklmnopqrstuvwxyz0123456789-./?=&%_"]
    term = F.transform(F.array(*counts), lambda n: F.when(n > 0, -n / total * F.log2(n / total)).otherwise(0.0))
    return F.aggregate(term, F.lit(0.0), lambda a, x: a + x)


def suffix(host: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def features(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host, path, suffix and the lexical features but suffix_rate."""
    u = F.coalesce(F.col(url), F.lit(""))
    out = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    return out.withColumns(
        {
            "suffix": suffix(F.col("host")),
            "length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_share": (F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))) / F.greatest(F.length(u), F.lit(1)),
            "hyphens": (F.length("host") - F.length(F.regexp_replace("host", "-", ""))).cast("double"),
            "parameters": F.size(F.array_remove(F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&"), "")).cast("double"),
            "entropy": F.round(_entropy(u), 3),
        }
    )


def _fit(rows: list[tuple[list[float], int]], rounds: int, depth: int, rate: float, bins: int = 16) -> tuple[float, list]:
    """Boosted trees of the logistic loss on the bounded sample: (prior, trees); a tree is (feature, cut, low, high) or a
    number; a value under the cut goes low."""
    if not rows:
        return 0.0, []
    labels = [y for _, y in rows]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    prior = math.log(share / (1 - share))
    cuts = []
    for j in range(len(FEATURES)):
        values = sorted(x[j] for x, _ in rows)
        cuts.append(sorted({values[len(values) * k // bins] for k in range(1, bins)}))
    margin = [prior] * len(rows)

    def grow(members: list[int], g: list[float], h: list[float], left: int):
        gain, best = 1e-6, None
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        if left:
            for j, own in enumerate(cuts):
                for cut in own:
                    low_g = low_h = 0.0
                    for i in members:
                        if rows[i][0][j] < cut:
                            low_g, low_h = low_g + g[i], low_h + h[i]
                    up_g, up_h = total_g - low_g, total_h - low_h
                    if min(low_h, up_h) >= 1:
                        now = low_g**2 / (low_h + 1) + up_g**2 / (up_h + 1) - total_g**2 / (total_h + 1)
                        if now > gain:
                            gain, best = now, (j, cut)
        if best is None:
            return rate * total_g / (total_h + 1)
        j, cut = best
        return j, cut, grow([i for i in members if rows[i][0][j] < cut], g, h, left - 1), grow([i for i in members if rows[i][0][j] >= cut], g, h, left - 1)

    def of(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        return tree

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        trees.append(grow(list(range(len(rows))), [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p], depth))
        margin = [m + of(trees[-1], x) for m, (x, _) in zip(margin, rows)]
    return prior, trees


def _column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(FEATURES[tree[0]]) < F.lit(float(tree[1])), _column(tree[2])).otherwise(_column(tree[3]))


class UrlModel:
    """Trees and suffix statistics of a fit; score() adds a column. At most `sample` suffixes, by construction."""

    def __init__(self, prior: float, trees: list, rates: dict[str, float], base: float):
        self.prior, self.trees, self.rates, self.base = prior, trees, rates, base

    def score(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """urls with host, path and block_score, the probability of `block`. A null URL has features of an empty one."""
        spark, kept = urls.sparkSession, urls.columns
        rates = F.broadcast(spark.createDataFrame(list(self.rates.items()) or [("", self.base)], "suffix string, suffix_rate double"))
        rows = features(urls.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(url).alias("_url")), "_url")
        rows = rows.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.base)))
        margin = F.lit(self.prior)
        for tree in self.trees:
            margin = margin + _column(tree)
        return rows.select("_row", F.col("host").alias("_host"), F.col("path").alias("_path"), (1 / (1 + F.exp(-margin))).alias("_score"))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = 2000, rounds: int = 12, depth: int = 3, rate: float = 0.4) -> UrlModel:
    """labelled: URLs with label 1 (block) or 0. At most `sample` rows of smallest xxhash64(url) reach the driver; suffix
    rates are smoothed shares of blocked URLs in that sample. Rows without URL or label are left out; without any row
    the model answers 0.5."""
    chosen = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("_url"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_url"), "_url", "_label").limit(sample)
    got = features(chosen, "_url").select("_label", "suffix", *FEATURES[:-1]).collect()
    base = (sum(r["_label"] for r in got) + 0.5) / (len(got) + 1)
    seen: dict[str, list[int]] = {}
    for r in got:
        seen.setdefault(r["suffix"], []).append(r["_label"])
    rates = {s: (sum(v) + 10 * base) / (len(v) + 10) for s, v in seen.items()}
    prior, trees = _fit([([float(r[f]) for f in FEATURES[:-1]] + [rates[r["suffix"]]], r["_label"]) for r in got], rounds, depth, rate)
    return UrlModel(prior, trees, rates, base)


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None, **options) -> DataFrame:
    """pages with host, path, rule, verdict and block_score. The rule's verdict, else `block` where the trees give 0.5 or
    more. Without labelled URLs, those that a rule fits are the labelled ones. Columns of pages with those names are
    replaced. Null URLs: empty host and path, no rule."""
    ruled = lambda h, p: rule_of(h, p, rules)
    if labelled is None:
        own = pages.select(F.col(url).alias("url"), ruled(host(F.col(url)), path(F.col(url)))[1].alias("says"))
        labelled = own.where("says is not null").select("url", (F.col("says") == "block").cast("int").alias("label"))
        scored = fit(labelled, **options).score(pages, url)
    else:
        scored = fit(labelled, **options).score(pages, url)
    rule, verdict = ruled(F.col("_host"), F.col("_path"))
    new = ("host", "path", "rule", "verdict", "block_score")
    return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in new], F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("_score", 6).alias("block_score"))
