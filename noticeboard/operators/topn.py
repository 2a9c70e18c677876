"""First rows per group and ordered takes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALT_BUCKETS = 64


def newest_first() -> list[Column]:
    """Date order of every result page: newest first, undated before dated, ties by id."""
    return [F.col("date").desc_nulls_first(), F.col("id").asc()]


def best_first() -> list[Column]:
    return [F.col("score").desc_nulls_last(), *newest_first()]


def oldest_first() -> list[Column]:
    return [F.col("date").asc_nulls_last(), F.col("id").asc()]


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
            spread_on: str = "id", rank: str = "rank") -> DataFrame:
    """First n rows of every key group, whole and exact whatever a group's size.

    Up to Spark's group-limit threshold, `row_number() <= n` is cut to n rows per key in every map
    task before the shuffle, so a hot key sends n rows per task and no more. A larger n loses that
    cut, so it is taken twice: first within salted slices of the group, then over their survivors.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(SALT_BUCKETS)))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n)
              .drop("_salt", rank))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_then_newest(df: DataFrame, k: int) -> DataFrame:
    """Relevance selects k rows, date arranges them (one query)."""
    return df.orderBy(*best_first()).limit(k).orderBy(*newest_first())


def rank_then_newest_per(df: DataFrame, keys: Sequence[str], max_k: int,
                         k: Column | None = None) -> DataFrame:
    """The same for every key group: `rank` by relevance, `position` on the page by date. `k` may
    be a per-group column of at most max_k."""
    best = first_n(df, keys, best_first(), max_k)
    if k is not None:
        best = best.filter(F.col("rank") <= k)
    page = Window.partitionBy(*keys).orderBy(*newest_first())
    return best.withColumn("position", F.row_number().over(page))


def take_by_id(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("id").limit(n)


def capped(k: Column, low: int, high: int, default: int) -> Column:
    """A requested limit held within the backend's bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(k, F.lit(default))))
