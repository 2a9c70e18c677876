"""Quality rules from tokeniser fertility.

The distinct words of a block are encoded once with a public SentencePiece vocabulary; from them come, per text,
characters per token, the share of byte-fallback tokens and the entropy of the tokens. Bands are measured over the
distinct texts of a language, so a copy weighs nothing: the median and the median distance from it. The entropy grows
with length, so its bands are by length octave; the median of an octave of few distinct texts is drawn towards the line
through the other octaves of the language, and that, where the language has few, towards the line through the octaves
of all languages, so that no sparse octave judges itself. A text outside a band is rejected. Plain counts of symbols, repeated lines and repeated words stand
beside them and fail a text by themselves.

Nulls and ties: null text has no words; a null language is a language of its own; measures of a text without
words are null and never reject it (the word count does); repeated rows are judged alike; extra columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.llm.blocks import Words, segment_sums, text_blocks, texts_of
from noticeboard.llm.tables import small_side, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
SPREADS = 8.0                 # median distances from the median
LEAST_FERTILITY = 0.2         # of the median, as the half width of the band at least
LEAST_BYTES = 0.05
ENTROPY_SPREADS = 6.0
LEAST_ENTROPY = 0.3           # bits
SMALL_TEXT = 2.0              # the fertility band widens by this over the root of the token count
SHRINK_TEXTS = 20.0           # distinct texts that an octave's own median needs to weigh as much as the line beside it
OCTAVE_TEXTS = 200.0          # distinct texts as which an octave counts at most for that line
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_tokens", "n_bytes"]


@lru_cache(maxsize=2)
def _processor(model: str):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words that lie in a window of WINDOW words found twice or more in it."""
    n = len(words.codes)
    out = np.zeros(n, bool)
    if n >= WINDOW:
        value = words.codes.astype(np.int64)
        key = value[:n - WINDOW + 1]
        for j in range(1, WINDOW):
            key = np.unique(key * (len(words.names) + 1) + value[j:n - WINDOW + 1 + j], return_inverse=True)[1]
        row = words.rows
        inside = row[:n - WINDOW + 1] == row[WINDOW - 1:]
        at = np.flatnonzero(inside)
        pair = row[at] * (n + 1) + key[at]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = at[count[inverse] > 1]
        for j in range(WINDOW):
            out[hit + j] = True
    return segment_sums(out.astype(np.int64), words.starts)


def repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def token_measures(words: Words, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, byte-fallback tokens, entropy in bits) per text."""
    sp, is_byte = _processor(model)
    ids = sp.encode(words.names.to_pylist(), num_threads=1) if len(words.names) else []
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    per_word = sizes[words.codes] if len(ids) else np.zeros(0, np.int64)
    bytes_of = segment_sums(is_byte[flat].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
    tokens = segment_sums(per_word, words.starts)
    n_bytes = segment_sums(bytes_of[words.codes] if len(ids) else per_word, words.starts)
    ends = np.cumsum(per_word)
    pick = np.arange(int(per_word.sum())) - np.repeat(ends - per_word, per_word)
    token = flat[pick + np.repeat(first[words.codes], per_word)] if len(ids) else flat
    row = np.repeat(words.rows, per_word)
    key, count = np.unique(row * len(is_byte) + token, return_counts=True)
    weighted = np.bincount(key // len(is_byte), count * np.log2(count), len(tokens)) if len(key) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - weighted / np.maximum(tokens, 1), np.nan)
    return tokens, n_bytes, np.round(entropy, 9)


def measured(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, lang, text_hash, counts, n_tokens, n_bytes, entropy) of every row of docs (doc_id, text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = texts_of(block)
            words = Words(texts, lower=False)
            lengths = pc.utf8_length(words.names).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, n_bytes, entropy = token_measures(words, model)
            columns = [words.counts, segment_sums(lengths[words.codes] if len(lengths) else words.codes, words.starts),
                       pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
                       np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64), repeated_words(words),
                       tokens, n_bytes]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("lang"), block.column("text_hash"), *(pa.array(c) for c in columns),
                 pa.array(entropy, from_pandas=True)], ["doc_id", "lang", "text_hash", *COUNTS, *MEASURES, "entropy"])
    source = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("lang", "text")),
                         F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, text_hash long, " + ", ".join(
        f"{c} long" for c in (*COUNTS, *MEASURES)) + ", entropy double"
    return source.mapInArrow(run, schema)


def with_ratios(measures: DataFrame) -> DataFrame:
    some = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    return measures.withColumns({"chars_per_token": F.col("word_chars") / some, "byte_share": F.col("n_bytes") / some,
                                 "octave": F.floor(F.log2(some.cast("double"))).cast("int")})


def _beside(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of a row per group, where null keys meet."""
    right = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(small_side(stored(right, "bands")), on, "left").drop(*(f"_{k}" for k in keys))


def _band(measures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median distance from it, per group of keys."""
    middle = measures.groupBy(*keys).agg(F.percentile_approx(value, 0.5, 10000).alias(f"{value}_mid"))
    away = _beside(measures, middle, keys).withColumn("away", F.abs(F.col(value) - F.col(f"{value}_mid")))
    return away.groupBy(*keys, f"{value}_mid").agg(F.percentile_approx("away", 0.5, 10000).alias(f"{value}_away"))


def _lines(cells: DataFrame) -> DataFrame:
    """cells (lang, octave, mid, away, n) with `line` and `spread`, the median and the distance expected from the
    language's other octaves (straight lines, nearer octaves weighing more; level beyond the longest, as entropy
    flattens), and `weight`, the texts that these stand for."""
    other = cells.select(F.col("lang").alias("_lang"), F.col("octave").alias("at"), F.col("mid").alias("m"),
                         F.col("away").alias("a"), F.col("n").alias("k"))
    # A language has at most as many octaves as lengths have bits.
    near = cells.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("at") != F.col("octave")), "left")
    x = F.col("at") - F.col("octave")
    w = F.least("k", F.lit(OCTAVE_TEXTS)) * F.exp(-F.abs(x))
    sums = near.groupBy("lang", "octave", "mid", "away", "n").agg(
        F.max(x).alias("last"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"),
        *(F.sum(w * F.col(y)).alias(f"w{y}") for y in "ma"), *(F.sum(w * x * F.col(y)).alias(f"wx{y}") for y in "ma"))

    def line(y: str) -> Column:
        var = F.col("wxx") * F.col("w") - F.col("wx") * F.col("wx")
        slope = F.coalesce(F.when(var > 1e-9, (F.col(f"wx{y}") * F.col("w") - F.col("wx") * F.col(f"w{y}")) / var), F.lit(0.0))
        # Entropy grows by one bit at most where the length doubles.
        slope = F.least(F.greatest(slope, F.lit(-1.0 if y == "a" else 0.0)), F.lit(1.0))
        return F.greatest((F.col(f"w{y}") - slope * F.col("wx")) / F.col("w") + slope * F.least("last", F.lit(0)),
                          F.when(F.col("w") > 0, 0.0))
    return sums.select("lang", "octave", "mid", "away", "n", F.coalesce("w", F.lit(0.0)).alias("weight"),
                       line("m").alias("line"), line("a").alias("spread"))


def _drawn(own: Column, weight: Column, towards: Column) -> Column:
    """own, of so many texts, drawn towards another value; whichever is there alone stands."""
    return F.coalesce((weight * own + SHRINK_TEXTS * towards) / (weight + SHRINK_TEXTS), own, towards)


def entropy_bands(distinct: DataFrame) -> DataFrame:
    """(lang, octave, entropy_mid, entropy_away) of distinct texts (lang, octave, entropy)."""
    keys = ["lang", "octave"]

    def cells(texts: DataFrame) -> DataFrame:
        number = texts.groupBy(*keys).agg(F.count("*").alias("n"))
        return _beside(_band(texts, keys, "entropy"), number, keys).select(
            *keys, F.col("entropy_mid").alias("mid"), F.col("entropy_away").alias("away"), "n")
    own = stored(_lines(stored(cells(distinct), "entropy-cells")), "entropy-lines")
    pooled = _lines(stored(cells(distinct.withColumn("lang", F.lit("all"))), "entropy-octaves"))
    pooled = pooled.select("octave", _drawn(F.col("mid"), F.col("n"), F.col("line")).alias("all_mid"),
                           _drawn(F.col("away"), F.col("n"), F.col("spread")).alias("all_away"))
    both = _beside(own, pooled, ["octave"])
    middle = _drawn(F.col("mid"), F.col("n"), _drawn(F.col("line"), F.col("weight"), F.col("all_mid")))
    away = _drawn(F.col("away"), F.col("n"), _drawn(F.col("spread"), F.col("weight"), F.col("all_away")))
    return both.select(*keys, F.round(middle, 9).alias("entropy_mid"), F.round(away, 9).alias("entropy_away"))


def judged(measures: DataFrame) -> DataFrame:
    """Stored measures with ratios, bands, base_failed and kept. Bands are a row per language (and length octave),
    so they are few as long as the
    language column holds languages; where it doesn't, their counted number makes the join shuffle."""
    m = with_ratios(measures)
    # The measures follow from the text, so distinct rows are distinct texts.
    distinct = stored(m.filter("n_tokens > 0").select("lang", "octave", "text_hash", "chars_per_token", "byte_share", "entropy")
                      .distinct(), "distinct-texts")
    out = m
    for value in ("chars_per_token", "byte_share"):
        out = _beside(out, _band(distinct, ["lang"], value), ["lang"])
    out = _beside(out, entropy_bands(distinct), ["lang", "octave"])
    widest: Column = F.greatest(SPREADS * F.col("chars_per_token_away"), LEAST_FERTILITY * F.col("chars_per_token_mid"))
    widest = widest + F.col("chars_per_token_mid") * SMALL_TEXT / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    odd = {
        "odd_fertility": F.abs(F.col("chars_per_token") - F.col("chars_per_token_mid")) > widest,
        "odd_bytes": F.col("byte_share") - F.col("byte_share_mid")
        > F.greatest(SPREADS * F.col("byte_share_away"), F.lit(LEAST_BYTES)),
        "odd_entropy": F.col("entropy_mid") - F.col("entropy")
        > F.greatest(ENTROPY_SPREADS * F.col("entropy_away"), F.lit(LEAST_ENTROPY))}
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in odd.items()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~(failed | F.col("odd_fertility") | F.col("odd_bytes") | F.col("odd_entropy")))


def quality_rules(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return judged(stored(measured(docs, model), "fertility"))
