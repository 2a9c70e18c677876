"""The registered queries of this package: thin digests of what its operators return."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.llm.op1_chat import format_chats, loss_text, read_back, text_part
from noticeboard.llm.op2_minhash import near_duplicates
from noticeboard.llm.op3_sentencepiece import decode, encode
from noticeboard.llm.op4_lm import lm_scores
from noticeboard.llm.op5_spans import drop_repeated_spans
from noticeboard.llm.op6_licenses import scan_licenses
from noticeboard.llm.op7_urls import judge_urls
from noticeboard.llm.op8_decontaminate import contaminated
from noticeboard.llm.op9_quality import judged
from noticeboard.llm.op10_fertility import COUNTS, quality_rules
from noticeboard.llm.op11_search import search
from noticeboard.llm.op12_mixing import mix
from noticeboard.llm.op13_alignment import align


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    chats = format_chats(turns.union(planted).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    seen = read_back(F.col("formatted"))
    lines = F.concat_ws("", F.transform("seen", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return chats.withColumns({"seen": seen, "loss": loss_text(F.col("formatted"), F.col("loss_spans"))}).select(
        "conv_id", F.size("seen").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (near_duplicates(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(ids).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_sentences").alias("n_sentences"),
                      F.col("_n_removed").alias("n_removed"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; texts of at most 12 words stand as licence files of their
    directory."""
    short = F.size(F.split(F.trim("text"), r"\s+")) <= 12
    name = F.when(short, F.lit("LICENSE.txt")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    return scan_licenses(files).select("doc_id", "path", F.col("_license").alias("license"),
                                       F.col("_cosine").alias("cosine"), F.col("_how").alias("how"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_p_block").alias("p_block"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                         _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_items").alias("item_ids"), (F.size("_items") == 0).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("_p_good", 6).alias("p_good"), F.col("_keep").alias("kept"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "n_tokens", "n_bytes", "entropy",
                      "odd_fertility", "odd_bytes", "odd_entropy")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents: its ten best."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return search(_table(spark, sf_dir, "documents"), items).withColumnRenamed("query", "item_id")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both vocabularies, aligned."""
    return align(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat, op2_minhash, op3_sentencepiece, op4_lm, op5_spans, op6_licenses, op7_urls, op8_decontaminate, op9_quality, op10_fertility,
    op11_search, op12_mixing, op13_alignment)}
