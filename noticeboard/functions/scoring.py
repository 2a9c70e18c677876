"""Relevance terms."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeboard.fixed_values import (KEYWORD_BONUS, LENGTH_PENALTY_CHARS, RANK_SERIES_LIMIT,
                                      RANK_WEIGHT)

# Cosines are compared at this precision so that the order of additions cannot reorder ties.
COSINE_DIGITS = 9


def phrase_rank(occurrences: Column, n_tokens: Column) -> Column:
    """Each further occurrence counts 1/j^2; the sum is damped by the log of the text's length."""
    series = F.aggregate(F.sequence(F.lit(1), occurrences), F.lit(0.0).cast("double"),
                         lambda acc, j: acc + F.lit(1.0) / (j * j).cast("double"))
    rank = F.lit(RANK_WEIGHT) * series / F.lit(RANK_SERIES_LIMIT) / F.log2(n_tokens + F.lit(1))
    return F.when(occurrences > 0, rank).otherwise(F.lit(0.0))


def significance_boost(score: Column) -> Column:
    return F.coalesce(score, F.lit(0)) / F.lit(100.0)


def length_penalty(n_chars: Column) -> Column:
    return F.least(F.coalesce(n_chars, F.lit(0)) / F.lit(LENGTH_PENALTY_CHARS), F.lit(1.0))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine distance; null for a zero vector. Norms taken once per vector may be given."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.round(_dot(a, b) / F.nullif(norms, F.lit(0.0)), COSINE_DIGITS)


def keyword_bonus(hit: Column) -> Column:
    return F.when(hit, F.lit(KEYWORD_BONUS)).otherwise(F.lit(0.0))
