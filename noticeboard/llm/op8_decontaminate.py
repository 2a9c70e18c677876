"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased (A-Z) and runs of white space become one space; all positions below are bytes of that.
Benchmark items are cut into overlapping windows of at most WINDOW bytes, each allowed EDIT_PERCENT of its
length in edits. By the q-gram lemma a region within e edits of a window of m bytes shares at least
m + 1 - q - q * e of its q-grams, all on diagonals at most e apart. Shared q-grams are counted in overlapping
diagonal bands; bands that meet the bound are verified by banded alignment of the window inside the region.

Items of less than MIN_ITEM bytes allow no edits: they are found as they are, from word border to word border (the
scripts of UNSPACED set no borders). So a short item that is a common word marks every text that holds the word.

The windows of the benchmark are held by every task, BLOCK_BYTES of item text at a time; a larger benchmark is
passed over in blocks.

Nulls and ties: null and blank texts or items match nothing, nor do items without an id; a text with several items lists each once, in
order; rows of the same id are judged one by one; extra columns are untouched.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.blocks import text_blocks, texts_of
from noticeboard.llm.tables import spared

Q = 10
WINDOW = 100
EDIT_PERCENT = 7
MIN_ITEM = 30
# Han, kana and scripts of south-east Asia, which are written without spaces.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                      "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22


def normal(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", data).strip()


def normal_texts(texts: pa.Array) -> list[bytes]:
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), r"[\x20\x09-\x0D]+", " ")
    return spaced.cast(pa.binary()).to_pylist()


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes at each position."""
    n = len(data) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    raw = data.tobytes()
    for shift in range(8):
        count = len(range(shift, n, 8))
        if count > 0:
            lo = np.frombuffer(raw, np.uint64, count, shift)
            out[shift::8] = lo * np.uint64(0x9E3779B97F4A7C15)
    tail = (data[8:8 + n].astype(np.uint64) << np.uint64(8)) | data[9:9 + n]
    return (out ^ (out >> np.uint64(29))) + tail * np.uint64(0xBF58476D1CE4E5B9)


def in_word(c: str) -> bool:
    return c == "_" or (unicodedata.category(c)[0] in "LMN" and not UNSPACED.match(c)) if c else False


ASCII_WORD = np.array([k < 128 and in_word(chr(k)) for k in range(256)])


class ShortItems:
    """Items of less than MIN_ITEM bytes, by length of the first bytes that are looked up: 1 to Q."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items: dict[bytes, list[int]] = {}
        for item, data in items:
            self.items.setdefault(data, []).append(item)
        self.groups = []
        for n in sorted({min(len(t), Q) for t in self.items}):
            texts = sorted(t for t in self.items if min(len(t), Q) == n)
            code = np.concatenate([self.codes(np.frombuffer(t[:n], np.uint8), n) for t in texts])
            order = np.argsort(code, kind="stable")
            code, begin, count = np.unique(code[order], return_index=True, return_counts=True)
            known = np.zeros(1 << TABLE_BITS, bool)
            known[Windows._slot(code)] = True
            self.groups.append((n, known, code, [[texts[k] for k in order[b:b + c]] for b, c in zip(begin, count, strict=True)]))

    @staticmethod
    def codes(data: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit code of the n bytes at each position."""
        if n == Q:
            return grams(data)
        size = max(0, len(data) - n + 1)
        out = np.zeros(size, np.uint64)
        for k in range(n):
            out = out * np.uint64(257) + data[k:k + size] + np.uint64(1)
        return out

    def matches(self, raw: bytes, code: np.ndarray) -> set[int]:
        """Numbers of the items that raw holds between word borders; code is grams(raw)."""
        data, found = np.frombuffer(raw, np.uint8), set()
        for n, known, names, texts in self.groups:
            here = code if n == Q else self.codes(data, n)
            at = np.flatnonzero(known[Windows._slot(here)])
            name = np.minimum(np.searchsorted(names, here[at]), len(names) - 1)
            same = names[name] == here[at]
            at, name = at[same], name[same]
            order = np.argsort(name, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(name[order])) + 1) if len(order) else []:
                for text in texts[name[group[0]]]:
                    if any(self.bordered(text, raw, k) for k in self.open(text, data, at[group]).tolist()):
                        found.update(self.items[text])
        return found

    @staticmethod
    def open(text: bytes, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The positions where text may stand: within data, and no ASCII word goes on beyond it."""
        end = at + len(text)
        at, end = at[end <= len(data)], end[end <= len(data)]
        good = np.ones(len(at), bool)
        if ASCII_WORD[text[0]]:
            good &= (at == 0) | ~ASCII_WORD[data[at - 1]]
        if ASCII_WORD[text[-1]]:
            good &= (end == len(data)) | ~ASCII_WORD[data[np.minimum(end, len(data) - 1)]]
        return at[good]

    @staticmethod
    def bordered(text: bytes, raw: bytes, at: int) -> bool:
        end = at + len(text)
        if raw[at:end] != text:
            return False
        own = text.decode("utf-8", "replace")
        before, after = raw[max(0, at - 4):at].decode("utf-8", "ignore")[-1:], raw[end:end + 4].decode("utf-8", "ignore")[:1]
        return not (in_word(own[0]) and in_word(before)) and not (in_word(own[-1]) and in_word(after))


class Windows:
    """Windows of a block of benchmark items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.item: list[int] = []
        self.text: list[bytes] = []
        short: list[tuple[int, bytes]] = []
        for item, text in items:
            data = normal(text)
            if len(data) < MIN_ITEM:
                short += [(item, data)] if data else []
                continue
            count = max(1, -(-(len(data) - WINDOW) // (WINDOW // 2)) + 1)
            for k in range(count):
                start = min(k * (WINDOW // 2), max(0, len(data) - WINDOW))
                self.item.append(item)
                self.text.append(data[start:start + WINDOW])
        self.short = ShortItems(short)
        self.budget = np.array([len(t) * EDIT_PERCENT // 100 for t in self.text], np.int64)
        size = np.array([len(t) for t in self.text], np.int64)
        self.bound = np.maximum(1, size + 1 - Q - Q * self.budget)
        codes = [grams(np.frombuffer(t, np.uint8)) for t in self.text]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else window
        order = np.argsort(code, kind="stable")
        self.window, self.offset = window[order], offset[order]
        self.code, begin, count = np.unique(code[order], return_index=True, return_counts=True)
        self.begin, self.count = begin, count
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def regions(self, data: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(window, lowest diagonal, highest diagonal) rows of the bands of data, whose q-grams are code, that meet
        the bound."""
        at = np.flatnonzero(self.known[self._slot(code)])
        found = np.minimum(np.searchsorted(self.code, code[at]), max(len(self.code) - 1, 0))
        same = self.code[found] == code[at]
        at, found = at[same], found[same]
        count = self.count[found]
        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.begin[found], count)
        window = self.window[pick]
        diagonal = np.repeat(at, count) - self.offset[pick] + WINDOW
        # Bands of twice the spread, each shifted by the spread: any spread lies whole in one of them.
        spread = 2 * self.budget[window] + 1
        out = []
        base = len(data) + 3 * WINDOW
        for shift in (0, 1):
            band = (diagonal + shift * spread) // (2 * spread)
            # A q-gram of the window counts once per band, however often the band's text repeats it.
            key = (window * base + band) * WINDOW + self.offset[pick]
            key = np.unique(key) // WINDOW
            keys, hits = np.unique(key, return_counts=True)
            w, b = keys // base, keys % base
            good = hits >= self.bound[w]
            w, b = w[good], b[good]
            low = b * 2 * (2 * self.budget[w] + 1) - shift * (2 * self.budget[w] + 1) - WINDOW
            out.append(np.stack([w, low, low + 4 * self.budget[w] + 1], axis=1))
        return np.concatenate(out)

    def matches(self, raw: bytes) -> set[int]:
        """Numbers of the items of which a window aligns with a region of raw within its budget, and of the short
        items that raw holds."""
        data = np.frombuffer(raw, np.uint8)
        code = grams(data)
        found = self.short.matches(raw, code)
        if len(raw) < Q or not self.text:
            return found
        for w, low, high in self.regions(data, code).tolist():
            if self.item[w] in found:
                continue
            pattern, budget = self.text[w], int(self.budget[w])
            region = raw[max(0, low - budget):max(0, high + len(pattern) + budget)]
            if aligned(pattern, region, budget):
                found.add(self.item[w])
        return found


def aligned(pattern: bytes, region: bytes, budget: int) -> bool:
    """Whether some substring of region is within `budget` edits of pattern: banded alignment row by row, where
    cells beyond the budget are cut."""
    if pattern in region:
        return True
    text = np.frombuffer(region, np.uint8)
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for c in pattern:
        nxt = np.empty_like(row)
        nxt[0] = row[0] + 1
        nxt[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(nxt - steps) + steps
        if row.min() > budget:
            return False
    return bool(row.min() <= budget)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with `_items`, the sorted item_ids of the benchmark items found in each text (empty: clean);
    a column of that name is replaced."""
    plain, restored = spared(docs, {"text"})
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-(total[0] + 64 * total[1]) // BLOCK_BYTES))
    name = "_items"
    out = plain.withColumns({"text": F.col("text").cast("string"), name: F.array().cast("array<long>")})
    for block in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r[0], r[1]) for r in part.filter("item_id is not null").select(
            F.col("item_id").cast("long"), F.col("text").cast("string")).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value)
            for batch in text_blocks(batches):
                before = batch.column(name).to_pylist()
                found = [sorted({*old, *windows.matches(raw)})
                         for raw, old in zip(normal_texts(texts_of(batch)), before, strict=True)]
                yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(found, pa.list_(pa.int64())))
        out = out.mapInArrow(scan, out.schema)
    return restored(out, name)
