"""Request log analysis: window counts, rate-limit decisions, run summaries, retention."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeboard.fixed_values import (GLOBAL_DAY_LIMIT, LOG_RETENTION_DAYS, PER_DAY_LIMIT,
                                      PER_MINUTE_LIMIT)
from noticeboard.functions.clients import utc_day, utc_minute
from noticeboard.operators.topn import first_n


def window_hits(log: DataFrame) -> DataFrame:
    """Hits per fixed window: address and minute, address and day, everyone and day."""
    by_minute = (log.groupBy("ip", utc_minute(F.col("ts")).alias("window"))
                 .agg(F.count("*").alias("hits")))
    by_day = (by_minute.groupBy("ip", F.substring("window", 1, 10).alias("window"))
              .agg(F.sum("hits").alias("hits")))
    everyone = (by_day.groupBy("window").agg(F.sum("hits").alias("hits"))
                .withColumn("ip", F.lit("*")))
    kinds = (("ip_minute", by_minute), ("ip_day", by_day), ("day", everyone))
    tagged = [df.select(F.lit(kind).alias("kind"), "ip", "window", "hits") for kind, df in kinds]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def rate_decisions(log: DataFrame, per_minute: int = PER_MINUTE_LIMIT, per_day: int = PER_DAY_LIMIT,
                   day_cap: int | None = GLOBAL_DAY_LIMIT, minute: Column | None = None) -> DataFrame:
    """Outcome of every request under chained fixed-window limits; a rejected request does not
    advance the later counters.

    Each stage keeps the first n of a window, so it is a first-n per group: hot addresses and hot
    days are cut in the map tasks and never meet in one task. The verdicts then return to the whole
    log over the unique event id, which has no hot key.

    log: event_id, ip, ts. Adds `status` and `reason`.
    """
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    minute = utc_minute(F.col("ts")) if minute is None else minute
    hits = log.select("event_id", "ip", "ts", minute.alias("minute"), utc_day(F.col("ts")).alias("day"))
    within_minute = first_n(hits, ["ip", "minute"], order, per_minute, "event_id").drop("rank")
    # A day holds at most per_minute survivors of each of its minutes, so this group is bounded.
    day_window = Window.partitionBy("ip", "day").orderBy(*order)
    ranked = within_minute.withColumn("day_rank", F.row_number().over(day_window))
    verdicts = ranked.withColumn("reason", F.when(F.col("day_rank") > per_day, F.lit("ip_day")))
    if day_cap is not None:
        admitted = first_n(ranked.filter(F.col("day_rank") <= per_day), ["day"], order, day_cap,
                           "event_id")
        last_admitted = (admitted.groupBy("day").agg(
            F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n_admitted")))
        over = ((F.col("n_admitted") >= day_cap)
                & (F.struct("ts", "event_id") > F.col("last")))
        verdicts = (verdicts.join(last_admitted, "day", "left")
                    .withColumn("reason", F.coalesce("reason", F.when(over, F.lit("day")))))
    verdicts = verdicts.select("event_id", F.coalesce("reason", F.lit("ok")).alias("reason"))
    reason = F.coalesce("reason", F.lit("ip_minute"))
    return (log.join(verdicts, "event_id", "left").withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason") == "ok", F.lit(200))
                        .when(F.col("reason") == "day", F.lit(503)).otherwise(F.lit(429))))


def first_citations(citations: DataFrame) -> DataFrame:
    """Each notice a run read, once, with the step of its first reading. One row per citation, so
    no run is gathered into one value.

    citations: run_id, step, id."""
    return citations.groupBy("run_id", "id").agg(F.min("step").alias("first_step"))


def run_summary(steps: DataFrame, citations: DataFrame) -> DataFrame:
    """Per run: non-blank steps, distinct sources and results read; the cited ids themselves are
    the rows of first_citations.

    steps: run_id, text. citations: run_id, step, id."""
    told = steps.groupBy("run_id").agg(
        F.count(F.when(F.trim("text") != "", F.lit(1))).alias("n_steps"))
    read = (citations.groupBy("run_id", "id").agg(F.count("*").alias("n"))
            .groupBy("run_id").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_reads")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.join(read, "run_id", "full_outer").select(
        "run_id", zero("n_steps"), zero("n_sources"), zero("n_reads"))


def retain(log: DataFrame, as_of: date, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    """Log rows within the retention window; `day` is the partition column, so old days are never
    read."""
    return log.filter(F.col("day") >= F.lit((as_of - timedelta(days=days)).isoformat()))


def retention_report(log: DataFrame, as_of: date, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    """Days kept and pruned."""
    cutoff = F.lit((as_of - timedelta(days=days)).isoformat())
    outcome = F.when(F.col("day") >= cutoff, F.lit("kept")).otherwise(F.lit("pruned"))
    return (log.groupBy("day").agg(F.count("*").alias("n"))
            .groupBy(outcome.alias("outcome"))
            .agg(F.count("*").alias("n_days"), F.sum("n").alias("n_rows")))
