"""Blocks of texts inside a task: bounded slices of Arrow batches, split into words without a Python loop over
words. A word is a run of characters other than space and the five ASCII controls of [\\x09-\\x0D]."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
                max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about max_bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a block, null as empty."""
    return pc.fill_null(batch.column(column), "")


class Words:
    """Words of a block: `names` (distinct words), `codes` (one index into names per word, rows one after the
    other) and `starts` (where each row's words begin; one more entry than rows)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten().dictionary_encode()
        starts = np.asarray(lists.offsets).astype(np.int64)
        codes = np.asarray(flat.indices).astype(np.int64)
        starts -= starts[0]
        names = flat.dictionary
        blank = pc.index(names, "").as_py()
        if blank >= 0:  # blank space at either end of a text
            real = codes != blank
            starts = np.concatenate([[0], np.cumsum(real)])[starts]
            codes = codes[real]
        self.names, self.codes, self.starts = names, codes, starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finalizer of a 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def name_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in names.to_pylist()), np.uint64, len(names))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over the rows that starts delimits; rows may be empty."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
