"""Quality classifier by hierarchical empirical Bayes.

Document evidence is a naive Bayes model of three classes (good, junk, toxic), fitted on a bounded sample of
labelled rows: a word carries weight for junk or toxic where a likelihood ratio test over all words tried finds it
clearly over-represented there, and a few coarse shape marks (capitals, symbols, repetition) carry weight both
ways. Site evidence is a Dirichlet posterior over
the classes for the host (source) and, below it, the path (source and language), from all labelled rows by grouped
aggregation: a path shrinks towards its host, a host towards the global shares, by strengths that come from the
spread between sites. The posterior of a document multiplies both; it is kept if good has at least half.

Nulls and ties: a row without toxic = 1, quality = 0 or quality = 1 is unlabelled; a document labelled twice
counts twice; null text has no evidence and follows its site; null source or language is a site of its own; an
empty label table gives an even prior and keeps everything; extra columns pass through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.llm.blocks import Words, segment_sums, text_blocks, texts_of
from noticeboard.llm.shingles import shingle_sets
from noticeboard.llm.tables import small_side, spared, stored

CLASSES = ["good", "junk", "toxic"]
SAMPLE_ROWS = 20_000         # labelled rows that the document model is fitted on, at most
SURE = 6.0                   # added to the test's threshold, twice the log of the number of words tried
EDGE = ".,;:\"'()"
SYMBOLS = "#*$%&|<>"
SHAPES = ["upper", "symbol", "bang", "again", "distinct"]
LEVELS = 16


def _shape_table() -> np.ndarray:
    """The feature of each level of each shape mark."""
    import xxhash
    return np.array([[xxhash.xxh3_64_intdigest(f"shape {s} {b}") for b in range(LEVELS)] for s in SHAPES],
                    np.uint64).view(np.int64)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word feature by distinct word, code of each word, starts, shape features [rows, shapes])."""
    import xxhash
    words = Words(texts, lower=False)
    names = words.names.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    feature = np.fromiter((digest(w.lower().strip(EDGE) or w) for w in names), np.uint64, len(names)).view(np.int64)
    marks = np.array([(len(w) > 1 and w.isupper(), any(c in SYMBOLS for c in w), "!!" in w) for w in names],
                     np.int64).reshape(-1, 3)
    n = np.maximum(words.counts, 1)
    shares = [segment_sums(marks[words.codes, k], words.starts) / n for k in range(3)]
    again = np.zeros(len(words.codes), np.int64)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (words.rows[1:] == words.rows[:-1])
    shares.append(segment_sums(again, words.starts) / n)
    pair = np.unique(words.rows * (len(names) + 1) + words.codes) // (len(names) + 1)
    shares.append(np.bincount(pair, minlength=len(n))[:len(n)] / np.sqrt(n) / 4)
    level = np.minimum((np.stack(shares, axis=1) * 8).astype(int), LEVELS - 1)
    shapes = np.where(words.counts[:, None] > 0, _shape_table()[np.arange(len(SHAPES)), level], 0)
    return feature, words.codes, words.starts, shapes


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a block."""
    feature, codes, starts, shapes = _features(texts)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    row = np.concatenate([rows, np.repeat(np.arange(len(shapes)), shapes.shape[1])])
    value = np.concatenate([feature[codes] if len(feature) else codes, shapes.ravel()])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    fresh &= value != 0
    return row[fresh], value[fresh]


def label_class() -> Column:
    return (F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        row, value = _present(texts_of(block))
        kind = block.column("class").to_numpy()[row]
        names, at = np.unique(value, return_inverse=True)
        counts = np.bincount(at * 3 + kind, minlength=3 * len(names)).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(counts[:, k].astype(np.int64)) for k in range(3))],
                                         ["feature", *CLASSES])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, family): family is one minhash of a text's three-word shingles, mostly shared by near
    copies."""
    for block in text_blocks(batches):
        values, starts = shingle_sets(texts_of(block), 3)
        least = np.zeros(block.num_rows, np.uint64)
        full = np.flatnonzero(np.diff(starts))
        least[full] = values[starts[full]]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("class"), pa.array(least.view(np.int64))],
                                         ["doc_id", "class", "family"])


def fit_words(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, tuple[float, ...]]:
    """Log weights by class (good is the reference: 0) of the features that tell. docs (doc_id, text); labelled
    (doc_id, class). At most sample_rows labelled rows are used, chosen by a hash of their id."""
    drawn = stored(labelled.orderBy(F.xxhash64("doc_id", "class")).limit(sample_rows), "label-sample")
    # Copies are no independent evidence: one row of each family and class stays.
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
                    .mapInArrow(_families, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, class int, family long")
                    .groupBy("class", "family").agg(F.min("doc_id").alias("doc_id")), "families")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "class")), "doc_id").select("text", "class")
    sizes = {r["class"]: r["n"] for r in sample.groupBy("class").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    counts = stored(rows.mapInArrow(_counted, "feature long, good long, junk long, toxic long").groupBy("feature")
                    .agg(*(F.sum(c).alias(c) for c in CLASSES)), "word-counts")
    threshold = 2 * float(np.log(max(1, counts.count()))) + SURE
    everywhere = sum((F.col(c) for c in CLASSES), F.lit(0))
    shape = F.col("feature").isin(_shape_table().ravel().tolist())
    weights, total = [], sum(sizes.values())
    for k, c in enumerate(CLASSES[1:], 1):
        n, rest = sizes.get(k, 0), everywhere - F.col(c)
        part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (everywhere * share))).otherwise(0.0)
        test = 2 * (part(F.col(c), n / total) + part(rest, 1 - n / total))
        clear = (test >= threshold) & (F.col(c) * total > everywhere * n)
        ratio = F.log((F.col(c) + 0.5) / (n + 1)) - F.log((rest + 0.5) / (total - n + 1))
        weights.append(F.when(F.lit(n > 0) & (clear | shape), ratio).otherwise(0.0).alias(c))
    # The words of a bounded sample, and of them the few that pass the test.
    chosen = counts.select("feature", *weights).filter("junk <> 0 or toxic <> 0")
    return {r["feature"]: (0.0, r["junk"], r["toxic"]) for r in chosen.collect()}


def _strength(level: DataFrame) -> float:
    """Pseudo rows by which a site shrinks, from how far good shares spread beyond chance (moments)."""
    n = sum((F.col(c) for c in CLASSES), F.lit(0))
    r = level.select(n.alias("n"), F.col("good")).filter("n > 0").agg(
        F.sum("good") / F.sum("n"), F.sum(F.pow(F.col("good") / F.col("n"), 2) * F.col("n")) / F.sum("n"),
        F.count("*") / F.sum("n")).first()
    if r[0] is None:
        return 1.0
    chance = r[0] * (1 - r[0])
    between = r[1] - r[0] ** 2 - chance * r[2]
    return float(min(1000.0, max(1.0, chance / between - 1))) if between > 0 else 1000.0


def site_priors(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[float]]:
    """(source, lang, good, junk, toxic): class shares by path, and the global shares."""
    rows = docs.select("doc_id", "source", "lang").join(labelled, "doc_id")
    ones = [F.sum(F.when(F.col("class") == k, 1).otherwise(0)).alias(c) for k, c in enumerate(CLASSES)]
    paths = stored(rows.groupBy("source", "lang").agg(*ones), "paths")
    hosts = stored(paths.groupBy("source").agg(*(F.sum(c).alias(c) for c in CLASSES)), "hosts")
    sums = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES)).first()
    overall = [(s + 1) / (sum(sums) + 3) for s in sums]
    k_host, k_path = _strength(hosts), _strength(paths)
    n = sum((F.col(c) for c in CLASSES), F.lit(0))
    host = hosts.select(F.col("source").alias("_host"), *(((F.col(c) + k_host * p) / (n + k_host)).alias(f"host_{c}")
                                                         for c, p in zip(CLASSES, overall, strict=True)))
    out = paths.join(host, F.col("source").eqNullSafe(F.col("_host")))
    return stored(out.select("source", "lang", *(((F.col(c) + k_path * F.col(f"host_{c}")) / (n + k_path)).alias(c)
                                                 for c in CLASSES)), "priors"), overall


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with _evidence (log weights by class of the text), _p_good and _keep; columns of these names are
    replaced."""
    plain, restored = spared(docs, {"doc_id", "text", "source", "lang"})
    labelled = labels.select("doc_id", label_class().alias("class")).filter("class is not null and doc_id is not null")
    source = plain.withColumn("text", F.col("text").cast("string"))
    weights = fit_words(source, labelled, sample_rows)
    priors, overall = site_priors(source, labelled)
    features = np.array(sorted(weights), np.int64)
    table = np.array([weights[f] for f in features.tolist()], np.float64).reshape(-1, 3)
    shared = docs.sparkSession.sparkContext.broadcast((features, table))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = shared.value
        for block in text_blocks(batches):
            evidence = np.zeros((block.num_rows, 3))
            if len(features):
                word, codes, starts, shapes = _features(texts_of(block))

                def place(value: np.ndarray) -> np.ndarray:
                    at = np.minimum(np.searchsorted(features, value), len(features) - 1)
                    return np.where(features[at] == value, at, -1)
                row = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(starts)),
                                      np.repeat(np.arange(len(shapes)), shapes.shape[1])])
                at = np.concatenate([place(word)[codes] if len(word) else codes, place(shapes.ravel())])
                key = np.unique((row * len(features) + at)[at >= 0])
                for k in range(3):
                    evidence[:, k] = np.bincount(key // len(features), table[key % len(features), k], block.num_rows)
            flat = pa.array(np.round(evidence, 9).ravel())
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 3, dtype=np.int32), flat)],
                [*block.schema.names, "_evidence"])

    scored = source.mapInArrow(score, source.withColumn("_evidence", F.array().cast("array<double>")).schema)
    side = small_side(priors.select(F.col("source").alias("_s"), F.col("lang").alias("_l"),
                                    *(F.col(c).alias(f"_{c}") for c in CLASSES)))
    out = scored.join(side, F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")), "left")
    logs = [F.log(F.coalesce(F.col(f"_{c}"), F.lit(p))) + F.get("_evidence", F.lit(k))
            for k, (c, p) in enumerate(zip(CLASSES, overall, strict=True))]
    good = F.lit(1.0) / (1 + F.exp(F.least(F.lit(700.0), logs[1] - logs[0])) + F.exp(F.least(F.lit(700.0), logs[2] - logs[0])))
    kept = F.lit(True) if priors.isEmpty() else good >= 0.5
    return restored(out.withColumns({"_p_good": good, "_keep": kept}), "_evidence", "_p_good", "_keep")

