"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

Everything is column expressions. The model is fitted by damped diagonal Newton steps, each one aggregation over
the labelled table; that table is bounded by LABELLED_ROWS, the weights by BUCKETS. Scoring sums weights inside the
row, without a shuffle.

Nulls and ties: a null url, or one without `://`, has empty host and path and gets the model's bias; equal urls get
equal verdicts; of rules that fit, the longest wins (of equals, the first listed); extra columns pass through, but
those named like an output are replaced.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.llm.tables import stored

BUCKETS = 4096
GRAM = 4
LABELLED_ROWS = 4000
STEPS = 12
RIDGE = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Rules are a short list."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and of path."""
    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(framed) - GRAM + 1, F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(framed, i, F.lit(GRAM))),
                                                F.lit(BUCKETS)).cast("int"))
    return F.array_distinct(F.concat(of(host, "host"), of(path, "path")))


def _score(features: Column, weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(features, F.lit(weights[-1]), lambda s, f: s + F.get(table, f))


def fit(labelled: DataFrame, rows: int = LABELLED_ROWS) -> list[float]:
    """Weights of the buckets and, last, the bias, from labelled (host, path, blocked double). At most `rows`
    distinct labelled urls are used, chosen by hash."""
    chosen = (labelled.select("host", "path", "blocked").distinct()
              .orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(rows))
    data = stored(chosen.select(grams(F.col("host"), F.col("path")).alias("f"), "blocked"), "url-sample")
    weights = [0.0] * (BUCKETS + 1)
    widest = data.agg(F.max(F.size("f"))).first()[0]
    if widest is None:
        return weights
    for _ in range(STEPS):
        chance = F.lit(1.0) / (1 + F.exp(-_score(F.col("f"), weights)))
        step = (data.select(F.explode(F.concat("f", F.array(F.lit(BUCKETS)))).alias("bucket"), "blocked", chance.alias("p"))
                .groupBy("bucket").agg(F.sum(F.col("p") - F.col("blocked")).alias("g"),
                                       F.sum(F.col("p") * (1 - F.col("p"))).alias("h"), F.count("*").alias("n")))
        for r in step.collect():  # at most BUCKETS + 1 rows
            k = r["bucket"]
            weights[k] -= (r["g"] + RIDGE * weights[k]) / (8 * r["h"] + 0.2 * r["n"] + RIDGE)
            weights[k] = round(max(-20.0, min(20.0, weights[k])), 12)
    return weights if all(map(math.isfinite, weights)) else [0.0] * (BUCKETS + 1)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               labelled: DataFrame | None = None) -> DataFrame:
    """pages (url) with _host, _path, _rule, _p_block and _verdict. Without a labelled table the urls that a rule
    decides are the labelled ones."""
    base = pages.withColumns({"_host": host_of(F.col("url").cast("string")), "_path": path_of(F.col("url").cast("string"))})
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    if labelled is None:
        labelled = base.select(F.col("_host").alias("host"), F.col("_path").alias("path"),
                               (verdict == "block").cast("double").alias("blocked")).filter("blocked is not null")
    weights = fit(labelled)
    chance = F.lit(1.0) / (1 + F.exp(-_score(grams(F.col("_host"), F.col("_path")), weights)))
    out = base.withColumns({"_rule": rule, "_p_block": F.round(chance, 9)})
    return out.withColumn("_verdict", F.coalesce(verdict, F.when(F.col("_p_block") >= 0.5, "block").otherwise("allow")))
