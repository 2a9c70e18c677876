"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Counts come first: every training token of the corpus is counted. The most frequent words (CLASSES of them) are
the neural model's output words; all others share one class `rare`, inside which a word's probability follows its
count: p(w) = p(rare | context) * (c + 1) / (N_rare + V_rare + 1), where the one spare unit is an unseen word. The
model predicts the next class from the two before it: the sum of position-wise products of their vectors, times the
output vectors, plus a bias. Each task trains it in numpy on its own share of the training texts, against noise
from the unigram distribution, and the copies are averaged over all tasks. Scoring normalises the logits of the
distinct contexts of a block in one matrix product, so every log-probability is exact.

Counts of the COMMON most frequent words travel with the tasks. All rarer words meet their counts in a cogroup by
hash bucket: a block of texts sends, per bucket, packed arrays of (row, word hash, times), and gets sums per row
back. Buckets follow the corpus, so none grows. Words are named by 64-bit hashes.

Nulls and ties: null text is one end token; rows of the same id are scored one by one (training or not goes by the
id, null by the text 'null'); without training rows every count is 0 and the model is uniform; extra columns are
ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.blocks import Words, name_hashes, segment_sums, text_blocks, texts_of
from noticeboard.llm.tables import stored

HELD_OUT = 2                 # of crc32(doc_id) mod 7
COMMON = 20_000              # words whose counts every task holds
CLASSES = 400                # of them output words of the neural model
WIDTH = 24
NOISE = 32                   # noise words shared by a minibatch
BATCH = 1024
RATE = 0.07
BUCKET_WORDS = 1_000_000     # corpus tokens per bucket of rare words
BLOCK_BYTES = 4 << 20
END_HASH = 0x656E64          # no word: words are named by hashes of their bytes


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == HELD_OUT for i in ids.to_pylist()],
                    bool)


def _named(words: Words) -> np.ndarray:
    return name_hashes(words.names).view(np.int64) if len(words.names) else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, max_bytes=BLOCK_BYTES):
        block = block.filter(pa.array(~held_out(block.column("doc_id"))))
        if not block.num_rows:
            continue
        words = Words(texts_of(block))
        times = np.bincount(words.codes, minlength=len(words.names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(_named(words)[times > 0], END_HASH)), pa.array(np.append(times[times > 0], block.num_rows))],
            ["word", "n"])


class Model:
    """Parameters: context vectors per position, output vectors, bias."""

    def __init__(self, log_unigram: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = len(log_unigram)
        self.context = rng.normal(0, 0.1, (2, k, WIDTH)).astype(np.float32)
        self.output = np.zeros((k, WIDTH), np.float32)   # starts as the unigram model
        self.mix = np.ones((2, WIDTH), np.float32)
        self.bias = log_unigram.astype(np.float32)
        self.past = [np.full_like(x, 1e-5) for x in self.arrays()]  # sums of squared steps (AdaGrad)

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.output, self.mix, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for a in self.arrays():
            a[...] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        return self

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.context[0, first] * self.mix[0] + self.context[1, second] * self.mix[1]

    def train(self, triples: np.ndarray, weight: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of NCE over distinct (first, second, next) rows with their counts."""
        order = rng.permutation(len(triples))
        log_noise = np.log(noise * NOISE).astype(np.float32)
        for start in range(0, len(order), BATCH):
            pick = order[start:start + BATCH]
            a, b, c = triples[pick].T
            w = weight[pick].astype(np.float32)
            w = w / w.sum()
            drawn = rng.choice(len(noise), NOISE, p=noise)
            p = self.predicted(a, b)
            good = np.einsum("ij,ij->i", p, self.output[c]) + self.bias[c] - log_noise[c]
            bad = p @ self.output[drawn].T + self.bias[drawn] - log_noise[drawn]
            g = w * (1 / (1 + np.exp(good)))                       # towards the true word
            h = -w[:, None] * (1 / (1 + np.exp(-bad)))             # away from the noise
            grad_p = g[:, None] * self.output[c] + h @ self.output[drawn]
            step = [np.zeros_like(x) for x in self.arrays()]
            context, output, mix, bias = step
            np.add.at(output, c, g[:, None] * p)
            np.add.at(output, drawn, h.T @ p)
            np.add.at(bias, c, g)
            np.add.at(bias, drawn, h.sum(axis=0))
            for position, word in ((0, a), (1, b)):
                np.add.at(context[position], word, grad_p * self.mix[position])
                mix[position] = np.einsum("ij,ij->j", grad_p, self.context[position, word])
            for x, dx, past in zip(self.arrays(), step, self.past, strict=True):
                past += dx * dx
                x += np.float32(RATE) * dx / np.sqrt(past)

    def log10(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """[contexts, words] normalised log10 probabilities."""
        logits = (self.predicted(first, second) @ self.output.T + self.bias).astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)


def _sequence(words: Words, classes: np.ndarray, rare: int, end: int):
    """(class of every token with its end, first context, second context, row, where each row begins)."""
    n = len(words.starts) - 1
    starts = words.starts + np.arange(n + 1)
    token = np.full(starts[-1], end, np.int64)
    inner = np.arange(len(words.codes)) + words.rows
    token[inner] = classes[words.codes] if len(classes) else rare
    row = np.repeat(np.arange(n), np.diff(starts))
    second = np.full(len(token), end, np.int64)
    second[1:] = token[:-1]
    first = np.full(len(token), end, np.int64)
    first[2:] = token[:-2]
    at = np.arange(len(token)) - starts[row]
    second[at < 1] = end
    first[at < 2] = end
    return token, first, second, row, starts


class Vocabulary:
    """The common words, by hash, with counts; the first ones of them are output words of the model."""

    def __init__(self, hashes: list[int], counts: list[int], total: int, distinct: int, end: int):
        order = np.argsort(np.array(hashes, np.int64), kind="stable")
        self.hash = np.array(hashes, np.int64)[order]
        self.count = np.array(counts, np.int64)[order]
        classes = np.array([k if k < CLASSES else -1 for k in range(len(hashes))], np.int64)[order]
        self.n_classes = min(CLASSES, len(hashes))
        self.rare, self.end = self.n_classes, self.n_classes + 1
        self.classes = np.where(classes < 0, self.rare, classes)
        self.total, self.distinct, self.end_count = total, distinct, end
        own = np.zeros(self.n_classes + 2)
        own[self.classes] += np.where(classes >= 0, self.count, 0)
        own[self.end] = end
        own[self.rare] = max(0, total - own.sum())
        self.rare_tokens = int(own[self.rare])
        self.rare_words = max(0, distinct - self.n_classes - (end > 0))
        # The spare count of every rare word counts for its class, in the prior and in training.
        self.rare_weight = 1 + self.rare_words / max(1, self.rare_tokens)
        own[self.rare] += self.rare_words
        self.unigram = (own + 1) / (own + 1).sum()

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether common, count, class) of hashes."""
        if not len(self.hash):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.full(len(names), self.rare)
        at = np.minimum(np.searchsorted(self.hash, names), len(self.hash) - 1)
        common = self.hash[at] == names
        return common, np.where(common, self.count[at], 0), np.where(common, self.classes[at], self.rare)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = stored(source.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("word") == END_HASH).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    top = counts.filter(F.col("word") != END_HASH).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    vocabulary = Vocabulary([r["word"] for r in top], [r["n"] for r in top], total, distinct, ends)
    shared = spark.sparkContext.broadcast(vocabulary)
    buckets = max(64, -(-total // BUCKET_WORDS))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        model, rng, seen = Model(np.log(v.unigram)), np.random.default_rng(11), 0
        for block in text_blocks(batches, max_bytes=BLOCK_BYTES):
            block = block.filter(pa.array(~held_out(block.column("doc_id"))))
            if not block.num_rows:
                continue
            words = Words(texts_of(block))
            token, first, second, _, _ = _sequence(words, v.find(_named(words))[2], v.rare, v.end)
            k = len(v.unigram)
            key, times = np.unique((first * k + second) * k + token, return_counts=True)
            times = np.where(key % k == v.rare, times * v.rare_weight, times)
            model.train(np.stack([key // (k * k), key // k % k, key % k], axis=1), times, v.unigram, rng)
            seen += len(token)
        if seen:
            flat = model.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen),
                                              pa.array(np.full(len(flat), float(seen)))], ["at", "value", "weight"])

    averaged = (source.mapInArrow(train, "at long, value double, weight double").groupBy("at")
                .agg((F.sum("value") / F.sum("weight")).alias("value")))
    model = Model(np.log(vocabulary.unigram))
    learnt = averaged.collect()  # the parameters: their number is fixed
    if learnt:
        flat = np.empty(len(learnt))
        for r in learnt:
            flat[r["at"]] = r["value"]
        model.load(flat)
    trained = spark.sparkContext.broadcast(model.flat())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        model = Model(np.log(v.unigram)).load(trained.value)
        for block in text_blocks(batches, max_bytes=BLOCK_BYTES):
            words = Words(texts_of(block))
            names = _named(words)
            common, count, classes = v.find(names)
            token, first, second, row, starts = _sequence(words, classes, v.rare, v.end)
            k = len(v.unigram)
            context, where = np.unique(first * k + second, return_inverse=True)
            gained = np.empty(len(token))
            for at in range(0, len(context), 4096):
                table = model.log10(context[at:at + 4096] // k, context[at:at + 4096] % k)
                inside = (where >= at) & (where < at + 4096)
                gained[inside] = table[where[inside] - at, token[inside]]
            neural = segment_sums(gained, starts)
            log_count = np.log10(count + 1.0)
            plain = segment_sums(log_count[words.codes] if len(names) else np.zeros(0), words.starts)
            plain = plain + np.log10(v.end_count + 1.0)
            in_rare = classes == v.rare
            n_rare = segment_sums(in_rare[words.codes].astype(np.int64) if len(names) else np.zeros(0, np.int64), words.starts)
            rare_sum = segment_sums(np.where(in_rare, log_count, 0)[words.codes] if len(names) else np.zeros(0), words.starts)
            n_known = segment_sums((count > 0)[words.codes].astype(np.int64) if len(names) else np.zeros(0, np.int64), words.starts)
            n_known = n_known + (v.end_count > 0)
            neural = neural + rare_sum - n_rare * np.log10(v.rare_tokens + v.rare_words + 1.0)
            # What is left to ask: rarer words, per row and hash bucket.
            ask = np.flatnonzero(~common[words.codes]) if len(names) else np.zeros(0, np.int64)
            key, times = np.unique(words.rows[ask] * max(len(names), 1) + words.codes[ask], return_counts=True)
            ask_row, ask_word = key // max(len(names), 1), names[key % max(len(names), 1)] if len(names) else key
            bucket = np.mod(ask_word, buckets)
            order = np.argsort(bucket, kind="stable")
            # Only buckets that the block asks: their number is bounded by its words, all buckets' is not.
            filled, cut = np.unique(bucket[order], return_index=True)
            packed = np.split(order, cut[1:]) if len(filled) else []
            name = int(np.random.default_rng().integers(0, 2 ** 63 - 1))
            apart = pa.array(held_out(block.column("doc_id")))
            rows = block.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows), pa.array(np.arange(rows)), block.column("doc_id"), apart,
                 pa.array(np.diff(starts)), pa.array(n_known), pa.array(plain), pa.array(neural),
                 pa.nulls(rows, pa.int64()), *(pa.nulls(rows, pa.binary()) for _ in range(3))], PACKED)
            if len(filled):
                n = len(filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, block.column("doc_id").type),
                     pa.nulls(n, pa.bool_()), *(pa.nulls(n, pa.int64()) for _ in range(2)),
                     *(pa.nulls(n, pa.float64()) for _ in range(2)), pa.array(filled.astype(np.int64)),
                     *(pa.array([part[p].astype(kind).tobytes() for p in packed], pa.binary())
                       for part, kind in ((ask_row, np.int32), (ask_word, np.int64), (times, np.int32)))], PACKED)

    packed = stored(source.mapInArrow(score, f"block long, row long, doc_id {kind}, held_out boolean, n_tokens long, "
                                      "n_known long, plain double, neural double, bucket long, rows binary, "
                                      "words binary, times binary"), "lm-blocks")
    asked = packed.filter("bucket is not null").select("bucket", "block", "rows", "words", "times")
    known = counts.select(F.pmod("word", F.lit(buckets)).cast("long").alias("bucket"), "word", "n")

    def answer(key, left, right):
        word = right.column("word").to_numpy()
        order = np.argsort(word)
        word, n = word[order], right.column("n").to_numpy()[order]
        out_rows, found, logs = [], [], []
        for rows, words, times in zip(*(left.column(c).to_pylist() for c in ("rows", "words", "times")), strict=True):
            row, ask, time = np.frombuffer(rows, np.int32), np.frombuffer(words, np.int64), np.frombuffer(times, np.int32)
            count = np.zeros(len(ask), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, ask), len(word) - 1)
                count = np.where(word[at] == ask, n[at], 0)
            names, first = np.unique(row, return_inverse=True)
            out_rows.append(names.astype(np.int32).tobytes())
            found.append(np.bincount(first, time * (count > 0)).astype(np.int32).tobytes())
            logs.append(np.bincount(first, time * np.log10(count + 1.0)).tobytes())
        return pa.table([left.column("block"), pa.array(out_rows, pa.binary()), pa.array(found, pa.binary()),
                         pa.array(logs, pa.binary())], ["block", "rows", "found", "logs"])

    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        answer, "block long, rows binary, found binary, logs binary")

    def together(key, table):
        size = 1 + max((int(np.frombuffer(r, np.int32).max()) for r in table.column("rows").to_pylist() if r), default=0)
        found, logs = np.zeros(size, np.int64), np.zeros(size)
        ordered = table.sort_by([("rows", "ascending"), ("logs", "ascending")])
        for rows, f, g in zip(*(ordered.column(c).to_pylist() for c in ("rows", "found", "logs")), strict=True):
            at = np.frombuffer(rows, np.int32)
            found[at] += np.frombuffer(f, np.int32)
            logs[at] += np.frombuffer(g)
        return pa.table([pa.array([key[0].as_py()] * size), pa.array(np.arange(size)), pa.array(found), pa.array(logs)],
                        ["block", "row", "found", "logs"])

    # A block has a bounded number of rows and of buckets that it asked.
    sums = answers.groupBy("block").applyInArrow(together, "block long, row long, found long, logs double")
    out = packed.filter("bucket is null").drop("bucket", "rows", "words", "times").join(sums, ["block", "row"], "left")
    extra = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.round(F.col("plain") + extra - F.col("n_tokens") * float(np.log10(total + distinct + 1.0)), 6).alias("base_score"),
        F.round(F.col("neural") + extra, 6).alias("score"))


PACKED = ["block", "row", "doc_id", "held_out", "n_tokens", "n_known", "plain", "neural", "bucket", "rows", "words", "times"]
