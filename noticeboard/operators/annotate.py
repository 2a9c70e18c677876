"""Pluggable text functions over pending rows: annotate, embed, parse queries."""
from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from noticeboard.fixed_values import EMBED_ATTEMPTS, EMBED_BATCH
from noticeboard.functions.annotations import annotator_input, parse_annotation, shape_parsed
from noticeboard.operators.filters import pending_annotation, pending_embedding
from noticeboard.operators.journal import ask_journaled
from noticeboard.schema import ANNOTATION_COLUMNS
from noticeboard.session import settled, spread

TextFunction = Callable[[str], str]
EmbedFunction = Callable[[list[str]], np.ndarray]

# --- fixed values: event category and action of a notice type, for the rule annotator ---
RULES = {
    "aw": ("liquidation", "application_filed"), "al": ("liquidation", "liquidator_appointed"),
    "vw": ("liquidation", "other"), "ar": ("receivership", "receiver_appointed"),
    "aa": ("administration", "administrator_appointed"), "ba": ("bankruptcy", "bankruptcy_declared"),
    "cb": ("cessation", "business_ceased"), "ds": ("company_removal", "company_struck_off"),
    "md": ("creditor_meeting", "meeting_called"), "sl": ("legislation", "rule_made"),
    "dl": ("legislation", "rule_made"), "ln": ("land", "land_action"), "lt": ("land", "land_action"),
    "ct": ("charity_or_society", "status_changed"), "is": ("charity_or_society", "status_changed"),
    "fs": ("charity_or_society", "status_changed"), "vr": ("appointment", "other"),
}


def rule_annotator(code: str | None, title: str | None, prompt: str) -> str:
    """Deterministic stand-in for a language model: category and action follow the type code."""
    category, action = RULES.get(code or "", ("other", "other"))
    return json.dumps({
        "headline": title or "", "plain_english": f"{title or ''}: {category}, {action}",
        "event_category": category, "action_taken": action,
        "affected_parties": [title] if title else [],
        "significance_score": min(100, len(prompt) // 100), "significance_reason": "by notice type"})


def annotate(notices: DataFrame, fn: Callable[[str | None, str | None, str], str] = rule_annotator,
             limit: int | None = None, journal: str | None = None, attempts: int = 3) -> DataFrame:
    """Annotations (id + annotation columns) of pending rows. A row whose call fails or whose answer
    is unusable is left out, so it stays pending for the next run. With a journal folder, answers are
    committed there slice by slice and asked once: a run that fails keeps what was answered, a failing row
    is asked again in later runs until `attempts` are spent (see operators/journal.py); `limit` bounds the
    questions asked in one run."""
    if journal is not None:
        pending = pending_annotation(notices).select("id", F.to_json(F.struct(
            "code", "title", annotator_input(F.col("type"), F.col("title"), F.col("fulltext")).alias("prompt")))
            .alias("input"))

        def ask(text: str) -> str:
            asked = json.loads(text)
            return fn(asked.get("code"), asked.get("title"), asked["prompt"])
        raw = ask_journaled(pending.withColumnRenamed("id", "key"), ask, journal, attempts, limit=limit)
        parsed = raw.select(F.col("key").alias("id"), parse_annotation(F.col("answer")).alias("a")).filter("a is not null")
        return parsed.select("id", *[F.col(f"a.{c}").alias(c) for c in ANNOTATION_COLUMNS
                                     if c != "enriched_at"], F.current_timestamp().alias("enriched_at"))
    pending = pending_annotation(notices, limit).select(
        "id", "code", "title", annotator_input(F.col("type"), F.col("title"), F.col("fulltext"))
        .alias("prompt"))

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(code, title, prompt):
            try:
                return fn(code, title, prompt)
            except Exception:
                return None
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "raw": [
                ask(*row) for row in zip(frame["code"], frame["title"], frame["prompt"])]})

    raw = spread(pending).mapInPandas(answers, "id string, raw string")
    parsed = raw.select("id", parse_annotation(F.col("raw")).alias("a")).filter("a is not null")
    return parsed.select("id", *[F.col(f"a.{c}").alias(c) for c in ANNOTATION_COLUMNS
                                 if c != "enriched_at"], F.current_timestamp().alias("enriched_at"))


class WordHashEmbedder:
    """Default embedding: word counts hashed into `dim` places, scaled to length 1. Documents and
    queries share the space."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        place = self._places.get(word)
        if place is None:
            place = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
            self._places[word] = place
        return place

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                row[self._place(word)] += 1.0
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def _with_retries(fn: EmbedFunction, texts: list[str], attempts: int, wait: float) -> np.ndarray:
    for attempt in range(1, attempts + 1):
        try:
            return fn(texts)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(wait * 2 ** attempt)


def embed_texts(df: DataFrame, text: str, out: str, fn: EmbedFunction | None = None,
                batch: int = EMBED_BATCH, attempts: int = EMBED_ATTEMPTS,
                wait: float = 1.0) -> DataFrame:
    """(key, text) rows -> (key, vector) rows, in batches, order kept, with back-off on failure.
    df: its first column is the key."""
    key = df.columns[0]
    embedder = fn or WordHashEmbedder()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors = _with_retries(embedder, part[text].tolist(), attempts, wait)
                yield pd.DataFrame({key: part[key].to_numpy(), out: list(vectors)})

    key_type = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {key_type}, `{out}` array<float>")


def embed(notices: DataFrame, fn: EmbedFunction | None = None, **options) -> DataFrame:
    """Vectors (id, embedding) of annotated rows that have none; embeds the plain text."""
    return embed_texts(pending_embedding(notices).select("id", "plain_english"), "plain_english",
                       "embedding", fn, **options)


def parse_queries(queries: DataFrame, fn: TextFunction | None = None) -> DataFrame:
    """Adds `parsed` to a query table (column q). The parser sees each distinct text once; without
    one, or where it fails, the search runs without inferred filters."""
    if fn is None:
        return queries.withColumn("parsed", shape_parsed(F.lit(None).cast("string"), F.col("q")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(text):
            try:
                return fn(text)
            except Exception:
                return None
        for frame in frames:
            yield pd.DataFrame({"q": frame["q"], "raw": [ask(t) for t in frame["q"]]})

    raw = settled(queries.select("q").distinct().mapInPandas(run, "q string, raw string"), "parses")
    return (queries.join(raw, "q", "left")
            .withColumn("parsed", shape_parsed(F.col("raw"), F.col("q"))).drop("raw"))
