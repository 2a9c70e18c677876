"""Substring dedup by sliding sentence spans.

A text is cut into sentences (line breaks; `.`, `!`, `?` before white space). From every sentence runs the
shortest span forwards, and to every sentence the shortest span, that has at least MIN_WORDS words and two
sentences (or LONG_WORDS words, so that one very long sentence counts by itself). Spans are hashed over
lower-cased words. Any repeated passage of MIN_WORDS words in whole sentences is covered by such spans. All
spans meet in one aggregation by hash; the first occurrence (smallest doc_id, then position) stays and every
sentence that another occurrence covers goes.

Nulls and ties: null text stays null; rows of one doc_id count as one document, and so do rows of null id, which
come last; a passage repeated inside one text keeps its first place; every other column passes through, and
n_chars, where there is one, follows the new text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.blocks import mixed, text_blocks
from noticeboard.llm.tables import spared, stored

MIN_WORDS = 25
LONG_WORDS = 50
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?](?!\s)[^\n.!?]*)*(?:[.!?]+\s+|\n\s*|[.!?]*$)")
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
LAST_ID = 2 ** 63 - 1


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    return [s for s in SENTENCE.findall(text) if s]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Spans:
    """Spans of a block of texts: `row`, `start`, `stop` (sentence numbers in the block) and `hash` per span;
    `pieces` are all sentences, `first` tells where each row's sentences begin."""

    def __init__(self, texts: list[str | None]):
        import xxhash
        digest = xxhash.xxh3_64_intdigest
        self.pieces: list[str] = []
        counts, hashes, words = [], [], []
        for text in texts:
            own = sentences(text or "")
            counts.append(len(own))
            self.pieces += own
            for sentence in own:
                parts = sentence.lower().split()
                words.append(len(parts))
                hashes.append(digest(" ".join(parts)))
        n = len(words)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        size = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
        value = mixed(np.array(hashes, np.uint64)) if n else np.zeros(0, np.uint64)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(STEP, n))])
        at = np.arange(n)
        stop = np.minimum(np.maximum(np.searchsorted(size, size[:-1] + MIN_WORDS), at + 2),
                          np.searchsorted(size, size[:-1] + LONG_WORDS))
        start = np.maximum(np.minimum(np.searchsorted(size, size[1:] - MIN_WORDS, side="right") - 1, at - 1),
                           np.searchsorted(size, size[1:] - LONG_WORDS, side="right") - 1)
        starts, stops = np.concatenate([at, start]), np.concatenate([stop, at + 1])
        rows = np.concatenate([row, row])
        inside = (starts >= self.first[rows]) & (stops <= self.first[rows + 1])
        # A span found both ways counts once.
        key = np.unique(starts[inside] * (n + 1) + stops[inside])
        self.start, self.stop = key // (n + 1), key % (n + 1)
        self.row = row[self.start] if n else row
        self.hash = mixed((prefix[self.stop] - prefix[self.start]) * _powers(BACK, n)[self.start]
                          + (self.stop - self.start).astype(np.uint64)).view(np.int64)


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        spans = Spans(block.column("text").to_pylist())
        ids = block.column("_id").to_numpy()[spans.row]
        order = np.lexsort((ids, spans.hash))
        ids, value = ids[order], spans.hash[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (value[1:] != value[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(value[fresh]), pa.array(ids[fresh])], ["span", "_id"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        texts = block.column("text").to_pylist()
        spans = Spans(texts)
        covered = np.zeros(len(spans.pieces) + 1, np.int64)
        elsewhere = block.column("_elsewhere")
        lengths = np.diff(np.searchsorted(spans.row, np.arange(block.num_rows + 1)))
        ends = np.cumsum(lengths)
        for i in range(block.num_rows):
            own = slice(ends[i] - lengths[i], ends[i])
            value = spans.hash[own]
            gone = np.ones(len(value), bool)
            gone[np.unique(value, return_index=True)[1]] = False
            if elsewhere[i].is_valid:
                gone |= np.isin(value, elsewhere[i].values.to_numpy())
            np.add.at(covered, spans.start[own][gone], 1)
            np.add.at(covered, spans.stop[own][gone], -1)
        hit = np.cumsum(covered)[:-1] > 0
        new, removed, total = [], [], []
        for i, text in enumerate(texts):
            a, b = spans.first[i], spans.first[i + 1]
            lost = int(hit[a:b].sum())
            new.append(text if not lost else "".join(
                s for s, h in zip(spans.pieces[a:b], hit[a:b], strict=True) if not h))
            removed.append(lost)
            total.append(int(b - a))
        keep = [c for c in block.schema.names if c not in ("text", "_elsewhere", "_id")]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(c) for c in keep), pa.array(new, pa.string()), pa.array(total, pa.int64()),
             pa.array(removed, pa.int64())], [*keep, "text", "_n_sentences", "_n_removed"])


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with repeated passages cut out of text, and two more columns:
    _n_sentences before the cut and _n_removed (columns of these two names are replaced)."""
    plain, restored = spared(docs, {"doc_id", "text", "n_chars"})
    source = plain.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
                               "text": F.col("text").cast("string")})
    rows = source.select("_id", "text").mapInArrow(_span_rows, "span long, _id long")
    owners = stored(rows, "spans")
    shared = (owners.groupBy("span").agg(F.count("*").alias("n"), F.min("_id").alias("owner"))
              .filter("n > 1").select("span", "owner"))
    lost = (owners.join(shared, "span").filter("_id <> owner")
            .groupBy("_id").agg(F.collect_set("span").alias("_elsewhere")))
    marked = source.join(lost, "_id", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_id", "text").schema)
    out = marked.mapInArrow(_cut, f"{schema}, text string, _n_sentences long, _n_removed long")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return restored(out, "_n_sentences", "_n_removed")
