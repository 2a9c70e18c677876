"""Corpus statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeboard.operators.filters import dated, pending_embedding


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("notice_count"), F.min("date").alias("oldest"),
                  F.max("date").alias("newest"))


def per_year(df: DataFrame) -> DataFrame:
    return (dated(df).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("count"))
            .orderBy("year"))


def corpus_stats(df: DataFrame) -> DataFrame:
    """Totals and the yearly series in one scan: a row per year (at most a few thousand, whatever
    the corpus) and one for undated notices is all that reaches the final aggregate."""
    by_year = df.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("count"), F.min("date").alias("oldest"), F.max("date").alias("newest"))
    year_row = F.when(F.col("year").isNotNull(), F.struct("year", "count"))
    return by_year.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("notice_count"),
                       F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
                       F.sort_array(F.collect_list(year_row)).alias("yearly"))


def stats_document(df: DataFrame) -> DataFrame:
    """The statistics as one JSON text; missing days stay visible as null."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return corpus_stats(df).select(F.to_json(
        F.struct("notice_count", day("oldest"), day("newest"), "yearly"),
        {"ignoreNullFields": "false"}).alias("document"))


def count_pending(df: DataFrame, limit: int | None = None) -> DataFrame:
    n = F.count("*")
    if limit:
        n = F.least(n, F.lit(limit))
    return pending_embedding(df).agg(n.alias("n_pending"))
