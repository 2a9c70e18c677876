"""Hard filters, for one request (literals, pushed into the scan) or a table of requests."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Filters:
    """Optional predicates of one request; empty text means no filter, a significance of 0 is one."""
    event_category: str | None = None
    action_taken: str | None = None
    code: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    min_significance: int | None = None

    def column(self) -> Column:
        parts = [F.col(name) == value for name, value in
                 (("event_category", self.event_category), ("action_taken", self.action_taken),
                  ("code", self.code)) if value]
        if self.date_from or self.date_to:
            parts.append(date_range(self.date_from, self.date_to))
        if self.min_significance is not None:
            parts.append(min_significance(self.min_significance))
        return reduce(and_, parts, F.lit(True))


def date_range(first: date | None, last: date | None) -> Column:
    """Inclusive on both ends; undated rows drop."""
    bounds = []
    if first:
        bounds.append(F.col("date") >= F.lit(first))
    if last:
        bounds.append(F.col("date") <= F.lit(last))
    return reduce(and_, bounds, F.lit(True))


def min_significance(k: int) -> Column:
    return F.col("significance_score") >= k


def request_filter(prefix: str = "want_") -> Column:
    """Filters held in columns of a joined request row (`want_code`, ...)."""
    def equal(name: str) -> Column:
        want = F.col(prefix + name)
        return F.nullif(want, F.lit("")).isNull() | (F.col(name) == want)

    since, until, least = (F.col(prefix + n) for n in ("date_from", "date_to", "min_significance"))
    return (equal("event_category") & equal("action_taken") & equal("code")
            & (since.isNull() | (F.col("date") >= since))
            & (until.isNull() | (F.col("date") <= until))
            & (least.isNull() | (F.col("significance_score") >= least)))


def name_like(title: Column, name: Column) -> Column:
    """Case-insensitive substring in which % and _ of the name stay wildcards. A backslash before
    any other character stands for that character."""
    pattern = F.concat(F.lit("%"), F.regexp_replace(name, r"(\\[%_\\])|\\(?=[^%_\\])", "$1"), F.lit("%"))
    return F.ilike(title, pattern)


def pending_annotation(df: DataFrame, limit: int | None = None) -> DataFrame:
    pending = df.filter(F.col("enriched_at").isNull())
    return pending.limit(limit) if limit else pending


def pending_embedding(df: DataFrame, limit: int | None = None) -> DataFrame:
    pending = df.filter(F.col("plain_english").isNotNull() & F.col("embedding").isNull())
    return pending.orderBy("id").limit(limit) if limit else pending


def has_vector(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull())


def dated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date").isNotNull())


def parties_overlap(parties: Column, names: Column) -> Column:
    """Any shared name, exact and case-sensitive; null names match nothing."""
    return F.coalesce(F.arrays_overlap(F.array_compact(parties), F.array_compact(names)), F.lit(False))


def type_filter(types: DataFrame, tier: int | None = None, active: bool | None = None,
                insolvency: bool | None = None) -> DataFrame:
    """Notice types of a tier, a publication state or the insolvency cluster."""
    for name, value in (("tier", tier), ("active", active), ("insolvency", insolvency)):
        if value is not None:
            types = types.filter(F.col(name) == value)
    return types


def present(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def absent(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")
