"""A journal of answers from outside functions: paid calls are asked once, kept through failures, retried within a
budget.

Each attempt is a row (key, input_hash, attempt, answer, error). A run reads the journal, skips every (key,
input_hash) that has an answer or has used up its attempts, and asks the rest in slices; each slice is appended
to the journal as its own write, so a run that fails half way keeps the slices that were written, and the next
run asks only what is still open. A changed input (another hash) is a new question. A row that fails
`attempts` times stops being asked and is reported by `exhausted`.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.session import settled, spread, work_dir

JOURNAL = "key string, input_hash string, attempt int, answer string, error string"
SLICE_ROWS = 10_000


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal's rows; an empty journal where nothing was written yet."""
    try:
        return spark.read.schema(JOURNAL).parquet(path)
    except Exception as error:     # nothing at the path yet
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        return spark.createDataFrame([], JOURNAL)


def state(journal: DataFrame, attempts: int) -> DataFrame:
    """Per (key, input_hash): tries, the latest answer (null if none) and whether the budget is used up."""
    return journal.groupBy("key", "input_hash").agg(
        F.max("attempt").alias("tries"),
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("attempt"))).alias("answer"),
        F.max_by("error", "attempt").alias("last_error")).withColumn(
        "spent", F.col("answer").isNull() & (F.col("tries") >= attempts))


def _sliced(open_: DataFrame, slices: int) -> list[DataFrame]:
    """The open questions dealt once into a folder per slice, so that a slice reads its own rows and no others."""
    path = work_dir(open_.sparkSession, "journal-slices")
    (open_.withColumn("_part", F.pmod(F.xxhash64("key", "input_hash"), F.lit(slices)).cast("int"))
     .repartition("_part").write.partitionBy("_part").parquet(path))
    read = open_.sparkSession.read
    held = sorted(r["_part"] for r in read.parquet(path).select("_part").distinct().collect())
    return [read.schema(open_.schema).parquet(f"{path}/_part={part}") for part in held]


def ask_journaled(rows: DataFrame, ask: Callable[[str], str], path: str, attempts: int = 3,
                  slice_rows: int = SLICE_ROWS, limit: int | None = None) -> DataFrame:
    """(key, answer) of rows(key, input) whose question has an answer, old or new. Open questions (no answer,
    budget left) are asked, at most `limit` of them in this run, slice by slice; every slice is committed to
    the journal at `path` before the next one starts. A failing call is an attempt with its error."""
    spark = rows.sparkSession
    questions = rows.select(F.col("key").cast("string"), F.col("input").cast("string"),
                            F.sha2(F.coalesce(F.col("input").cast("string"), F.lit("")), 256).alias("input_hash"))
    known = state(read_journal(spark, path), attempts)
    open_ = (questions.join(known.filter(F.col("answer").isNotNull() | F.col("spent")), ["key", "input_hash"], "left_anti")
             .join(known.select("key", "input_hash", "tries"), ["key", "input_hash"], "left")
             .withColumn("attempt", (F.coalesce("tries", F.lit(0)) + 1).cast("int")).drop("tries"))
    if limit is not None:
        open_ = open_.orderBy("key", "input_hash").limit(limit)
    open_ = settled(open_, "journal-open")          # one snapshot of the open questions for all slices
    n_open = open_.count()
    slices = max(1, -(-n_open // slice_rows))
    parts = [open_] if slices == 1 else _sliced(open_, slices)

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got, errors = [], []
            for text in frame["input"]:
                try:
                    got.append(ask(text))
                    errors.append(None)
                except Exception as error:          # an attempt that failed: kept with its error
                    got.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pd.DataFrame({"key": frame["key"], "input_hash": frame["input_hash"],
                                "attempt": frame["attempt"].astype("int32"), "answer": got, "error": errors})

    for chosen in parts:
        spread(chosen).mapInPandas(answers, JOURNAL).write.mode("append").parquet(path)
    final = state(read_journal(spark, path), attempts).filter(F.col("answer").isNotNull())
    return questions.join(final, ["key", "input_hash"]).select("key", "answer")


def exhausted(spark: SparkSession, path: str, attempts: int = 3) -> DataFrame:
    """(key, input_hash, tries, last_error) of questions that used up their attempts without an answer."""
    return state(read_journal(spark, path), attempts).filter("spent").select("key", "input_hash", "tries", "last_error")
