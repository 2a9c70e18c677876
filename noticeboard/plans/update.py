"""Nightly update: land -> upsert -> annotate -> embed -> publish statistics -> prune the log."""
from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from noticeboard.operators.annotate import annotate, embed, rule_annotator
from noticeboard.sources.notices import NoticeTable
from noticeboard.sources.sinks import prune_log, publish_stats
from noticeboard.streaming.ingest import stream_ingest


@dataclass(frozen=True)
class Paths:
    pages: str
    table: str
    checkpoint: str
    stats: str
    log: str


def observe_stage(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts rows as a stage runs, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("done")), seen


def rate(done: int, started: float) -> float:
    """Rows per second since a stage started (a monotonic time); 0 where it did none."""
    return done / max(time.monotonic() - started, 1e-9)


def update(spark: SparkSession, paths: Paths, as_of: date, annotator=rule_annotator,
           embedder=None) -> dict[str, int | float]:
    """Runs the stages in order; an exception stops the rest, so nothing annotates a half-loaded
    table. Every stage touches only what is new. Returns rows done per stage, and per second for
    the stages that run outside functions."""
    done: dict[str, int | float] = {}
    done["batches"] = stream_ingest(spark, paths.pages, paths.table, paths.checkpoint)
    table = NoticeTable(spark, paths.table)

    started = time.monotonic()
    answers, seen = observe_stage(annotate(table.read(), annotator), "annotate")
    table.annotate(answers)
    done["annotated"] = seen.get["done"]
    done["annotated_per_second"] = rate(done["annotated"], started)

    started = time.monotonic()
    vectors, seen = observe_stage(embed(table.read(), embedder), "embed")
    table.embed(vectors)
    done["embedded"] = seen.get["done"]
    done["embedded_per_second"] = rate(done["embedded"], started)

    publish_stats(table.read(), paths.stats)
    done["log_days_kept"], done["log_days_pruned"] = prune_log(spark, paths.log, as_of)
    return done
