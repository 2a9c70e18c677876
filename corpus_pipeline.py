"""A corpus from raw documents to token ids: five stages, each a decision of one operator that takes effect."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.llm.op2_minhash import near_duplicates
from noticeboard.llm.op3_sentencepiece import encode
from noticeboard.llm.op5_spans import drop_repeated_spans
from noticeboard.llm.op8_decontaminate import contaminated
from noticeboard.llm.op9_quality import judged
from noticeboard.llm.tables import spared, stored

# A classifier, an LSH search, bounded alignment and a tokeniser: beyond SQL, so tested against brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, restored = spared(docs, {"doc_id", "text", "source", "lang"})
    return restored(judged(plain, labels).filter("_keep"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, with all rows of that id. Null ids count
    as one id, which stays where one of its rows has no group with an id."""
    keep = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    plain, restored = spared(docs, {"doc_id", "text"})
    return restored(plain.join(keep, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; documents that were nothing else go."""
    plain, restored = spared(docs, {"doc_id", "text", "n_chars"})
    return restored(drop_repeated_spans(plain).filter("_n_removed = 0 or _n_removed < _n_sentences"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    plain, restored = spared(docs, {"text"})
    found = contaminated(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(found.filter("size(_items) = 0"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the token ids of their texts."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicate_groups), ("repeated_spans", repeated_spans),
    ("decontamination", decontaminated), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
