"""Cross-tokenizer alignment by galloping intersection of token end offsets.

Two public vocabularies encode each text, without special tokens (their strings inside a text are plain text):
A, a byte-level BPE, encodes " " + text; B, a SentencePiece BPE with byte fallback, encodes text and adds the
space itself. A token's bytes: A's entry through the byte-level alphabet; B's piece in UTF-8 with U+2581 as a
space and <0xHH> as the byte HH. A text whose joined A or B bytes differ from " " + text in UTF-8 (or a null or
empty text) has no tokens and zeros everywhere.

Encoding: a chunk's texts are cut in front of spaces that follow a character which is neither white space nor
U+2581. No token of either vocabulary crosses such a cut (checked when the vocabularies are loaded; where it does
not hold, a unit is a whole text), so a text's ids are those of its units, and each distinct unit is encoded once
and remembered, until there are KNOWN_UNITS of them or they hold KNOWN_LETTERS characters.

Per document (in Python, inside Arrow batches of Spark tasks):
1. End offsets: running sums of the token byte lengths, one sorted list per vocabulary.
2. Galloping intersection: the shorter list drives. From where the last search stopped, the search doubles its
   step through the longer list until it passes the value, then a binary search inside the last step finds it.
   Values are taken GALLOP at a time: one gallop brackets a run of the shorter list, and the binary searches
   of that run go through numpy in the bracket only.
3. The common offsets cut both token lists into groups; their ranks in each list give the groups' index ranges,
   and rank differences the group sizes. Links are all A-B token pairs of a group: per distinct (A id, B id)
   pair of a document its number of links, from per-group id counts.
Across the corpus (Spark): an id pair's count is the number of documents that link it (one aggregation with
map-side partial counts); an A id's highest count over its pairs; each document's links are joined with those
counts (broadcast under a proven row bound, else on salted keys, so that a pair present in every document
does not load one task).

Output per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is their A id's
highest, ties included), count_sum (pair counts over links), groups_sha256 (hex sha256 of "a1,a2|b1;a3|b2,b3",
decimal ids in order; '' without tokens).

Nulls and ties: null or empty texts, and texts that do not decode to themselves, have zeros and ''; null or
repeated doc_ids are documents of their own (rows are keyed by a number written with the alignment); an empty
table gives no rows. Extra columns are not read. A text is never cut between chunks.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.tables import BROADCAST_ROWS, stored

A_VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
B_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GALLOP = 1024        # values of the shorter list bracketed by one gallop
FEW_LINKS = 4        # links a token of a document, up to which they are listed before they are counted
SALTS = 32           # salts of the pair-count join beyond the broadcast bound
CHUNK_BYTES = 1 << 20   # text encoded at once in a task
KNOWN_UNITS = 500_000   # distinct units a task remembers before it begins anew
KNOWN_LETTERS = 8 << 20     # and their characters
ENCODED_UNITS = 256    # units encoded at once

MARK = "▁"
SPACES = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
CUT = re.compile(f"(?<=[^{SPACES}{MARK}])(?= .)", re.S)     # where " " + text falls into units
UNEVEN = f"^ |[{SPACES}{MARK}] | $"                          # texts with a space that does not begin a unit

ALIGNED = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                     ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("mult", pa.int64())])))])


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the other bytes, in
    order, for the code points from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: b for b in kept}
    extra = 0
    for b in range(256):
        if b not in shown:
            shown[b] = 256 + extra
            extra += 1
    return {chr(c): b for b, c in shown.items()}


class Vocabularies:
    """Both encoders with byte tables of their ids."""

    def __init__(self, a_vocab: str, b_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_vocab)
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.names = Names([f"{i}{end}" for end in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.cuts = self._cuts_hold()
        self._forget()

    def _cuts_hold(self) -> bool:
        """Whether no token can cross a cut: A matches words of the plain text by the byte-level pattern, which
        takes a space only at a word's begin; B reads the text as it is, and no piece has a mark behind another
        character."""
        from sentencepiece import sentencepiece_model_pb2
        a, b = json.loads(self.a.to_str()), sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        words, plain = a["pre_tokenizer"] or {}, b.normalizer_spec
        return (a["normalizer"] is None and words.get("type") == "ByteLevel" and bool(words.get("use_regex"))
                and not words.get("add_prefix_space") and all(t["special"] for t in a["added_tokens"])
                and b.trainer_spec.model_type == b.trainer_spec.BPE
                and plain.name == "identity" and not plain.precompiled_charsmap and plain.add_dummy_prefix
                and not plain.remove_extra_whitespaces and not b.trainer_spec.treat_whitespace_as_suffix
                and all(p.type != p.USER_DEFINED and MARK not in p.piece.lstrip(MARK) for p in b.pieces))

    def _units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units without their first space, code of each unit, starts per text) of texts with characters."""
        if not self.cuts:
            flat = texts.dictionary_encode()
            return flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64), np.arange(len(texts) + 1)
        lists = pc.split_pattern(texts, " ")
        uneven = np.flatnonzero(pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False))
        if len(uneven):
            rows = lists.to_pylist()
            for i in uneven:
                rows[i] = [u[1:] for u in CUT.split(" " + texts[i].as_py())]
            lists = pa.array(rows, pa.list_(pa.string()))
        flat, starts = lists.flatten().dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
        return flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64), starts - starts[0]

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}         # unit -> place in the lists below
        self.letters = 0
        self.ids = array("i"), array("i")       # A and B ids of the units, one after another
        self.sizes = array("q"), array("q")
        self.same = array("b")                  # whether the joined bytes of both are the unit's

    def _remember(self, units: list[str]) -> None:
        """Encodes distinct units that have no place yet: those between whose neighbours cuts fall as one text."""
        alone = [u for u in units if not self.cuts or MARK in u or u[-1] in SPACES]
        if len(alone) < len(units):
            apart = set(alone)
            joined = [u for u in units if u not in apart]
            if not self._encode_joined(joined):
                alone = units
        if alone:
            self._encode_alone(alone)

    def _encode_joined(self, units: list[str]) -> bool:
        """Encodes units as one text; false, and nothing kept, unless its tokens end where the units end."""
        text = " ".join(units)
        plain = (" " + text).encode()
        bounds = np.cumsum([len(u) for u in map(str.encode, units)]) + np.arange(1, len(units) + 1)
        lists = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        sizes = []
        for ids, tokens, lengths in zip(lists, (self.a_bytes, self.b_bytes), (self.a_len, self.b_len)):
            ends = np.cumsum(lengths[ids])
            last = np.searchsorted(ends, bounds)
            if b"".join(map(tokens.__getitem__, ids)) != plain or (ends[last] != bounds).any():
                return False
            sizes.append(np.diff(last, prepend=-1).tolist())
        self._keep(units, lists, sizes, [True] * len(units))
        return True

    def _encode_alone(self, units: list[str]) -> None:
        """Encodes each unit as a text."""
        plain = [(" " + u).encode() for u in units]
        lists = ([e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)],
                 self.b.encode(units, num_threads=1))
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == z
                for x, y, z in zip(*lists, plain)]
        self._keep(units, [chain.from_iterable(x) for x in lists], [map(len, x) for x in lists], same)

    def _keep(self, units: list[str], lists, sizes, same: list[bool]) -> None:
        for k in (0, 1):
            self.ids[k].extend(lists[k])
            self.sizes[k].extend(sizes[k])
        self.same.extend(same)
        self.slots.update(zip(units, range(len(self.slots), len(self.slots) + len(units))))
        self.letters += sum(map(len, units))

    def _joined(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of vocabulary k of the units at these places, one after another; where each begins, and the end)."""
        sizes = np.array(self.sizes[k], np.int64)
        at, taken = (np.cumsum(sizes) - sizes)[places], sizes[places]
        ends = np.concatenate([[0], np.cumsum(taken)])
        return np.array(self.ids[k], np.int64)[np.arange(ends[-1]) + np.repeat(at - ends[:-1], taken)], ends

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A ids of " " + text, B ids) of each text with characters; empty where the joined bytes of either
        differ from " " + text."""
        units, codes, starts = self._units(texts)
        if len(self.slots) > KNOWN_UNITS or self.letters > KNOWN_LETTERS:
            self._forget()
        found = list(map(self.slots.get, units))
        fresh = [i for i, place in enumerate(found) if place is None]
        for start in range(0, len(fresh), ENCODED_UNITS):
            part = fresh[start:start + ENCODED_UNITS]
            self._remember([units[i] for i in part])
            for i in part:
                found[i] = self.slots[units[i]]
        places = np.array(found, np.int64)[codes]
        same = np.array(self.same, bool)[places]
        (a, ends_a), (b, ends_b) = self._joined(0, places), self._joined(1, places)
        none = np.zeros(0, np.int64)
        for i, (lo, hi) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            of_a, of_b = a[ends_a[lo]:ends_a[hi]], b[ends_b[lo]:ends_b[hi]]
            if not same[lo:hi].all():       # a unit differs: the text decides, as differences may join to nothing
                text = (" " + texts[i].as_py()).encode()
                if (b"".join(map(self.a_bytes.__getitem__, of_a.tolist())) != text
                        or b"".join(map(self.b_bytes.__getitem__, of_b.tolist())) != text):
                    of_a = of_b = none
            yield of_a, of_b


@lru_cache(maxsize=2)
def vocabularies(a_vocab: str, b_model: str) -> Vocabularies:
    return Vocabularies(a_vocab, b_model)


def gallop_intersect(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into short, indices into long) of the values both sorted lists hold, in order."""
    hits_s, hits_l = [], []
    at, n = 0, len(long)
    for start in range(0, len(short), GALLOP):
        run = short[start:start + GALLOP]
        top = run[-1]
        step, hi = 1, at
        while hi < n and long[hi] < top:      # exponential: double the step until the run's last value is passed
            hi = at + step
            step <<= 1
        hi = min(hi + 1, n)
        where = at + np.searchsorted(long[at:hi], run)   # binary search inside the bracket [at, hi)
        found = where < hi
        found[found] = long[where[found]] == run[found]
        hits_s.append(start + np.flatnonzero(found))
        hits_l.append(where[found])
        at = int(where[-1]) if len(where) and where[-1] < n else n
    if not hits_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hits_s), np.concatenate(hits_l)


def align_ids(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
    """Groups of two token lists of the same bytes: (group sizes in A, group sizes in B)."""
    ends_a, ends_b = np.cumsum(a_len[a_ids]), np.cumsum(b_len[b_ids])
    if len(ends_a) <= len(ends_b):
        ia, ib = gallop_intersect(ends_a, ends_b)
    else:
        ib, ia = gallop_intersect(ends_b, ends_a)
    return np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)


def links_of(a_ids: np.ndarray, b_ids: np.ndarray, ga: np.ndarray, gb: np.ndarray):
    """Distinct (A id, B id) pairs linked in one document with their numbers of links: (a, b, mult)."""
    groups = len(ga)
    if int((ga * gb).sum()) <= FEW_LINKS * (len(a_ids) + len(b_ids)):      # few enough to be listed one by one
        reps, first = np.repeat(gb, ga), np.repeat(np.cumsum(gb) - gb, ga)
        at = np.arange(reps.sum()) + np.repeat(first - (np.cumsum(reps) - reps), reps)
        pair = np.repeat(a_ids.astype(np.int64) << 32, reps) | b_ids.astype(np.int64)[at]
        keys, mult = np.unique(pair, return_counts=True)
        return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), mult.astype(np.int64)
    ka = np.repeat(np.arange(groups, dtype=np.int64), ga) << 32 | a_ids.astype(np.int64)
    kb = np.repeat(np.arange(groups, dtype=np.int64), gb) << 32 | b_ids.astype(np.int64)
    ua, ca = np.unique(ka, return_counts=True)
    ub, cb = np.unique(kb, return_counts=True)
    ga_of, gb_of = ua >> 32, ub >> 32
    # distinct ids of a group against distinct ids of the same group
    starts_b = np.searchsorted(gb_of, np.arange(groups))
    per_b = np.bincount(gb_of, minlength=groups)
    reps = per_b[ga_of]
    left = np.repeat(np.arange(len(ua)), reps)
    offsets = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    right = np.repeat(starts_b[ga_of], reps) + offsets
    pair = (ua[left] & 0xFFFFFFFF) << 32 | (ub[right] & 0xFFFFFFFF)
    keys, inverse = np.unique(pair, return_inverse=True)
    mult = np.bincount(inverse, weights=(ca[left] * cb[right]).astype(np.float64)).astype(np.int64)
    return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), mult


class Names:
    """Strings laid out one after another, to be joined by their numbers."""

    def __init__(self, names: list[str]):
        self.count = len(names)
        self.flat = np.frombuffer("".join(names).encode("ascii"), np.uint8)
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def joined(self, order: np.ndarray) -> str:
        sizes = self.sizes[order]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(sizes.sum()) + np.repeat(self.begins[order] - ends + sizes, sizes)].tobytes().decode()


def groups_text(a_ids, b_ids, ga, gb, names: Names | list[str]) -> str:
    """'a1,a2|b1;a3|b2,b3' of the groups; names: every id's text followed by ',', then by '|', then by ';'."""
    names = names if isinstance(names, Names) else Names(names)
    ends_a, ends_b = np.cumsum(ga), np.cumsum(gb)
    size = names.count // 3
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    # A token stands behind the B tokens of the groups before its own, a B token behind the A tokens up to its own.
    order[np.arange(len(a_ids)) + np.repeat(ends_b - gb, ga)] = a_ids
    order[np.arange(len(b_ids)) + np.repeat(ends_a, gb)] = b_ids
    order[ends_a + ends_b - gb - 1] += size
    order[ends_a + ends_b - 1] += 2 * size
    return names.joined(order)[:-1]


def _chunk(v: Vocabularies, texts: list, batch: pa.RecordBatch) -> pa.RecordBatch:
    todo = [i for i, t in enumerate(texts) if t]
    ids = v.encoded(pa.array([texts[i] for i in todo], pa.string()))
    out = {k: [0] * len(texts) for k in ("n_a", "n_b", "n_groups", "n_links")}
    sha, links = [""] * len(texts), [[] for _ in texts]
    for i, (a_ids, b_ids) in zip(todo, ids):
        if not len(a_ids):
            continue
        ga, gb = align_ids(a_ids, b_ids, v.a_len, v.b_len)
        a, b, mult = links_of(a_ids, b_ids, ga, gb)
        out["n_a"][i], out["n_b"][i], out["n_groups"][i] = len(a_ids), len(b_ids), len(ga)
        out["n_links"][i] = int((ga * gb).sum())
        sha[i] = hashlib.sha256(groups_text(a_ids, b_ids, ga, gb, v.names).encode()).hexdigest()
        links[i] = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                               pa.array(mult, pa.int64())], names=["a", "b", "mult"])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype(np.int32)
    parts = [x for x in links if len(x)]
    values = pa.concat_arrays(parts) if parts else pa.array([], ALIGNED.field("links").type.value_type)
    return pa.RecordBatch.from_pydict({
        "_row": batch.column("_row"), "doc_id": batch.column("doc_id"),
        **{k: pa.array(x, pa.int64()) for k, x in out.items()},
        "groups_sha256": pa.array(sha, pa.string()),
        "links": pa.ListArray.from_arrays(pa.array(offsets), values)}, schema=ALIGNED)


def _aligned(a_vocab: str, b_model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a_vocab, b_model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # Chunks of at most CHUNK_BYTES of text (one text at least) are encoded and sent on one by one,
            # so that tokens of a whole Arrow batch never sit in memory at once.
            size = np.array([len(t) if t else 0 for t in texts], np.int64)
            cuts, held = [0], 0
            for i, n in enumerate(size):
                if held and held + n > CHUNK_BYTES:
                    cuts.append(i)
                    held = 0
                held += n
            cuts.append(len(texts))
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield _chunk(v, texts[lo:hi], batch.slice(lo, hi - lo))
    return run


def align(docs: DataFrame, a_vocab: str = A_VOCAB, b_model: str = B_MODEL) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (long counts);
    see the module's notes."""
    from pyspark.sql.pandas.types import from_arrow_schema
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"),
                       F.col("text").cast("string"))
    aligned = stored(rows.mapInArrow(_aligned(a_vocab, b_model), from_arrow_schema(ALIGNED)), "op13-aligned")
    pairs = aligned.select("_row", F.inline("links"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("_count"))
    highest = counts.groupBy("a").agg(F.max("_count").alias("_highest"))
    stats = stored(counts.join(highest, "a").select(
        "a", "b", "_count", (F.col("_count") == F.col("_highest")).alias("_best")), "op13-pair-counts")
    if stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = pairs.join(F.broadcast(stats), ["a", "b"])
    else:
        salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pairs.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "_salt"])
    per_doc = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("_best"), F.col("mult")).otherwise(0)).alias("n_best"),
        F.sum(F.col("mult") * F.col("_count")).alias("count_sum"))
    return (aligned.drop("links").join(per_doc, "_row", "left").fillna(0, ["n_best", "count_sum"])
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("n_best").cast("long"),
                    F.col("count_sum").cast("long"), "groups_sha256"))
