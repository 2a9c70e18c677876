"""Sets of distinct five-word shingles, as 64-bit hashes, for a block of texts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from noticeboard.llm.blocks import Words, mixed, name_hashes

SHINGLE_WORDS = 5


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the set of row i is hashes[starts[i]:starts[i + 1]], ascending and distinct. A text of
    fewer than `width` words has its whole sequence as one shingle, a text without words the empty set."""
    words = Words(texts)
    return sets_of(name_hashes(words.names)[words.codes] if len(words.codes) else np.zeros(0, np.uint64),
                   words.counts, width)


def sets_of(word_hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS):
    n = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = np.maximum(counts - width + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(n), full)
    at = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + first[rows]
    value = np.zeros(len(rows), np.uint64)
    for j in range(width):
        inside = counts[rows] > j
        step = word_hashes[np.minimum(at + j, max(len(word_hashes) - 1, 0))] if len(word_hashes) else value
        value = np.where(inside, mixed(value * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(j + 1)), value)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[fresh], rows[fresh]
    return value, np.searchsorted(rows, np.arange(n + 1))
