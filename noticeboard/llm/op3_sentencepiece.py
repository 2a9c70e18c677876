"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Spaces become the mark U+2581 and a text gets one in front; a marked word is a run of marks with what follows up
to the next mark. No piece of the vocabulary crosses from a word into the next mark, so the best segmentation of
a text is that of its words. The distinct marked words of a block are sorted, which lists the paths of their trie
depth first: forward scores stay on a stack, and a word goes on from the prefix it shares with the one before.
Piece scores are the model's own, added up; equal scores prefer the longer last piece. Characters without a piece
fall back to their bytes. A mark character that the text itself holds is encoded by its bytes, so every text
decodes to itself.

Nulls and ties: null text has null ids, an empty text no ids; extra columns and repeated rows pass through, but a
column named like an output is replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from noticeboard.llm.blocks import text_blocks
from noticeboard.llm.tables import spared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OWN_MARK = "\udc81"       # stands for a mark that is part of a text; no text can hold a lone surrogate
UNKNOWN_PENALTY = 10.0
BLOCK_BYTES = 6 << 20
KNOWN_WORDS = 300_000
MARKED = re.compile(r" +[^ ]*")


class Pieces:
    """A vocabulary as lookup tables."""

    def __init__(self, model: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [-1] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses a word's end")
                self.pieces[piece] = (i, sp.get_score(i))
                self.bytes.append(piece.replace(MARK, " ").encode())
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary has no byte fallback")
        self.fallback = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        # Every ending of a piece, with the piece's id and score where the ending is a piece itself.
        self.endings: dict[str, tuple[int, float] | None] = dict(self.pieces)
        for piece in self.pieces:
            for k in range(1, len(piece)):
                self.endings.setdefault(piece[k:])
        self.table = pa.array(self.bytes, pa.binary())
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of distinct words (spaces as in the text), in the order given. Words met before are
        remembered, up to KNOWN_WORDS of them."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        segmented = self.known if len(fresh) < KNOWN_WORDS else dict(self.known)
        segmented.update(self._segment(fresh))
        found = [segmented[w] for w in words]
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int32, starts[-1])
        return flat, starts

    def _segment(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each word with its ids, in the order of the sorted trie."""
        marked = sorted((MARK + w[1:].replace(MARK, OWN_MARK).replace(" ", MARK), w) for w in words)
        endings, fallback, nothing = self.endings, self.fallback, ()
        best, back, last = [0.0], [(0, -1)], ""
        for word, plain in marked:
            shared, most = 0, min(len(last), len(word))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                score, step = best[end - 1] + fallback, (end - 1, -1)
                begin = end - 1
                while begin >= 0:
                    hit = endings.get(word[begin:end], nothing)
                    if hit is nothing:
                        break
                    if hit is not None and best[begin] + hit[1] >= score:
                        score, step = best[begin] + hit[1], (begin, hit[0])
                    begin -= 1
                best.append(score)
                back.append(step)
            last = word
            ids, end = [], len(word)
            while end:
                begin, piece = back[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    char = word[begin]
                    raw = (MARK if char == OWN_MARK else " " if char == MARK else char).encode()
                    ids += [self.byte_ids[b] for b in reversed(raw)]
                end = begin
            ids.reverse()
            yield plain, tuple(ids)


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    return Pieces(model)


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct marked words, code of each word, starts per text); each word begins with its space."""
    odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    if odd.any():  # several spaces in a row belong to one word
        rows = lists.to_pylist()
        for i in np.flatnonzero(odd):
            rows[i] = [u[1:] for u in MARKED.findall(" " + texts[i].as_py())]
        lists = pa.array(rows, pa.list_(pa.string()))
    flat = lists.flatten().dictionary_encode()
    starts = np.asarray(lists.offsets).astype(np.int64)
    return flat.dictionary, np.asarray(flat.indices).astype(np.int64), starts - starts[0]


def encode_texts(texts: pa.Array, model: str = MODEL) -> pa.ListArray:
    """Token ids of each text; null stays null."""
    filled = pc.fill_null(texts, "")
    names, codes, starts = _units(filled)
    empty = pc.equal(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False)
    ids, at = pieces_of(model).encode_words([" " + w for w in names.to_pylist()])
    sizes = np.diff(at)[codes]
    sizes[starts[:-1][empty]] = 0          # an empty text splits into one empty word
    ends = np.cumsum(sizes)
    pick = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(at[codes], sizes)
    offsets = np.concatenate([[0], ends])[starts].astype(np.int32)
    out = pa.ListArray.from_arrays(offsets, pa.array(ids[pick]))
    return out if not texts.null_count else pc.if_else(texts.is_valid(), out, pa.scalar(None, out.type))


def decode_ids(ids: pa.ListArray, model: str = MODEL) -> pa.Array:
    """The texts of lists of token ids."""
    flat = np.asarray(ids.flatten())
    spans = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    table = pieces_of(model).table
    taken = pc.take(table, pa.array(flat))
    lengths = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False), dtype=np.int64)])
    data = memoryview(taken.buffers()[2] or b"")
    ends = np.cumsum(spans)
    cuts, stops = lengths[ends - spans], lengths[ends]
    return pa.array([None if not ok else str(data[a + (a < b):b], "utf-8") for a, b, ok in
                     zip(cuts, stops, ids.is_valid().to_pylist(), strict=True)], pa.string())


def encode(docs: DataFrame, column: str = "text", model: str = MODEL, out: str = "ids") -> DataFrame:
    """docs with the token ids of a text column; a column that is called `out` already is replaced."""
    plain, restored = spared(docs, {column})
    source = plain.withColumn(column, plain[column].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, column, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*block.columns, encode_texts(block.column(column), model)],
                                             [*block.schema.names, out])
    return restored(source.mapInArrow(run, source.withColumn(out, _ids()).schema), out)


def decode(docs: DataFrame, column: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """docs with the text that a column of token ids stands for; a column that is called `out` already is
    replaced."""
    plain, restored = spared(docs, {column})
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_ids(part.column(column), model)],
                                                 [*part.schema.names, out])
    return restored(plain.mapInArrow(run, plain.withColumn(out, F.lit(None).cast("string")).schema), out)


def _ids():
    from pyspark.sql import functions as F
    return F.lit(None).cast("array<int>")
