"""Query vectors x notice vectors: exact cosine ranking in matrix blocks.

A block of query vectors is scored against an Arrow batch of notice vectors with one matrix
product, and only each query's best k rows leave the task; pairs are never emitted. Beyond one
block, blocks are broadcast in turn and passed over the notices where they lie: vectors are never
shuffled. A batch's pivot and widest angle bound its cosines, so queries whose k-th best is
already above that bound skip it (counted in BOUNDS).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeboard.functions.scoring import COSINE_DIGITS
from noticeboard.operators.sizing import is_small
from noticeboard.schema import FILTER_COLUMNS
from noticeboard.session import settled, spread

QUERY_BLOCK_ROWS = 4096
QUERY_BLOCK_BYTES = 32 * 1024 * 1024
NOTICE_SLICE_ROWS = 4096
QUERY_TILE_ROWS = 256       # queries scored at once in a task: NOTICE_SLICE_ROWS times this many cosines in memory

SCORED = "request_key string, k int, id string, date date, score double"
_SCORED_ARROW = pa.schema([("request_key", pa.string()), ("k", pa.int32()), ("id", pa.string()),
                           ("date", pa.date32()), ("score", pa.float64())])
_NO_DATE = np.iinfo(np.int64).max      # undated notices come before the newest


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 and a mask of the zero rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(column), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    zero = norms == 0
    return matrix / np.where(zero, 1.0, norms)[:, None], zero


def _days(column: pa.Array) -> np.ndarray:
    days = column.cast(pa.int32()).cast(pa.int64())
    return days.fill_null(_NO_DATE).to_numpy(zero_copy_only=False)


class QueryBlock:
    """Query vectors with their filters and limits, as arrays."""

    def __init__(self, table: pa.Table):
        self.ids = table["request_key"].to_pylist()
        self.k = np.array(table["k"].to_pylist(), dtype=np.int64)
        self.unit, self.zero = _unit_rows(table["vector"])
        filters = zip(*(table[f"want_{c}"].to_pylist() for c in FILTER_COLUMNS))
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(filters):
            groups.setdefault(tuple(x if x != "" else None for x in row), []).append(i)
        self.filter_groups = [(key, np.array(rows)) for key, rows in groups.items()]


def _passing(batch: pa.Table, wanted: tuple) -> np.ndarray | None:
    """Row mask of one filter combination; None when it filters nothing."""
    mask = None
    for name, value in zip(FILTER_COLUMNS, wanted):
        if value is None:
            continue
        column = {"date_from": "date", "date_to": "date",
                  "min_significance": "significance_score"}.get(name, name)
        values = batch[column].to_pandas(date_as_object=True)
        if name in ("date_from", "min_significance"):
            ok = np.array([v is not None and v == v and v >= value for v in values], dtype=bool)
        elif name == "date_to":
            ok = np.array([v is not None and v <= value for v in values], dtype=bool)
        else:
            ok = (values == value).to_numpy(dtype=bool)
        mask = ok if mask is None else mask & ok
    return mask


class BestRows:
    """Running best k of each query: score, then newest, then id."""

    def __init__(self, queries: QueryBlock):
        self.queries = queries
        self.rows: list[tuple | None] = [None] * len(queries.ids)
        self.floor = np.full(len(queries.ids), -np.inf)
        self.skipped = 0                # (query, batch) pairs that a bound spared
        self.pairs = 0                  # (query, batch) pairs met

    def _reachable(self, unit: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Queries that some row of the batch may serve: a pivot (the rows' mean direction) and the widest
        angle of a row from it bound every row's cosine with a query by cos(max(0, angle to pivot - widest))."""
        q = self.queries
        everyone = np.ones(len(q.ids), dtype=bool)
        if not np.isfinite(self.floor).any() or zero.all():
            return everyone
        rows = unit[~zero]
        pivot = rows.sum(axis=0)
        norm = np.sqrt(pivot @ pivot)
        if norm == 0:
            return everyone
        pivot /= norm
        widest = np.arccos(np.clip((rows @ pivot).min(), -1.0, 1.0))
        gap = np.arccos(np.clip(q.unit @ pivot, -1.0, 1.0)) - widest
        bound = np.where(gap <= 0, 1.0, np.cos(np.clip(gap, 0.0, np.pi))) + 1e-9
        return (bound >= self.floor) | q.zero

    def add(self, batch: pa.Table) -> None:
        q = self.queries
        unit, zero = _unit_rows(batch["embedding"])
        if not len(unit):
            return
        live = self._reachable(unit, zero)
        self.pairs += len(live)
        self.skipped += int((~live).sum())
        if not live.any():
            return
        days = _days(batch["date"].combine_chunks())
        ids = np.array(batch["id"].to_pylist(), dtype=str)
        for wanted, members in q.filter_groups:
            members = members[live[members]]
            if not len(members):
                continue
            mask = _passing(batch, wanted)
            rows = np.arange(len(ids)) if mask is None else np.flatnonzero(mask)
            if not len(rows):
                continue
            passed = (unit[rows], zero[rows], days[rows], ids[rows]) if mask is not None else (unit, zero, days, ids)
            for at in range(0, len(members), QUERY_TILE_ROWS):
                self._score(members[at:at + QUERY_TILE_ROWS], *passed)

    def _score(self, members: np.ndarray, unit: np.ndarray, zero: np.ndarray, days: np.ndarray,
               ids: np.ndarray) -> None:
        """One tile of queries against the rows; the cosines are rounded in place."""
        q = self.queries
        block = unit @ q.unit[members].T
        np.round(block, COSINE_DIGITS, out=block)
        block += 0.0
        block[zero, :] = -2.0       # below every cosine: unscored rows rank last
        block[:, q.zero[members]] = -2.0
        for j in np.flatnonzero(block.max(axis=0) >= self.floor[members]):
            self._merge(members[j], block[:, j], days, ids)

    def _merge(self, i: int, score: np.ndarray, days: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[i]
        score, days, ids = score[keep], days[keep], ids[keep]
        if self.rows[i] is not None:
            old = self.rows[i]
            score, days, ids = (np.concatenate(p) for p in zip(old, (score, days, ids)))
        k = self.queries.k[i]
        if len(score) > k:
            bound = np.partition(score, len(score) - k)[len(score) - k]
            sure = np.flatnonzero(score > bound)
            tied = np.flatnonzero(score == bound)
            tied = tied[np.lexsort((ids[tied], -days[tied]))][:k - len(sure)]
            pick = np.concatenate([sure, tied])
            score, days, ids = score[pick], days[pick], ids[pick]
            self.floor[i] = bound
        self.rows[i] = (score, days, ids)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for key, k, rows in zip(self.queries.ids, self.queries.k, self.rows):
            if rows is None:
                continue
            score, days, ids = rows
            undated = days == _NO_DATE
            day = pa.array(np.where(undated, 0, days).astype(np.int32), mask=undated).cast(pa.date32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(ids)), pa.array(np.full(len(ids), k, dtype=np.int32)),
                 pa.array(ids.tolist(), pa.string()), day, pa.array(score, mask=score < -1.5)],
                schema=_SCORED_ARROW)


# Accumulators of the last search: (query, batch) pairs met and pairs that a cosine bound spared.
BOUNDS: dict = {}


def _nearest_broadcast(notices: DataFrame, queries: DataFrame) -> DataFrame:
    """The query block is within its bound: one pass over the notices, no shuffle of vectors."""
    context = notices.sparkSession.sparkContext
    block = context.broadcast(queries.toArrow())
    met, spared = BOUNDS.setdefault("pairs", context.accumulator(0)), BOUNDS.setdefault("skipped", context.accumulator(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block.value.num_rows:        # a hash block without queries
            return
        best = BestRows(QueryBlock(block.value))
        for start in batches:
            table = pa.Table.from_batches([start])
            for at in range(0, table.num_rows, NOTICE_SLICE_ROWS):
                best.add(table.slice(at, NOTICE_SLICE_ROWS))
        met.add(best.pairs)
        spared.add(best.skipped)
        yield from best.batches()

    return notices.mapInArrow(score, SCORED)


def _nearest_passes(notices: DataFrame, queries: DataFrame, query_rows: int) -> DataFrame:
    """Any number of queries: they are stored in blocks of query_rows, and each block is broadcast and passed
    over the notices where they lie; vectors are never shuffled. Every pass keeps each query's best k per task."""
    blocks = max(1, -(-queries.count() // query_rows))
    stored = settled(queries.withColumn("_block", F.pmod(F.xxhash64("request_key"), F.lit(blocks))), "query-blocks")
    passes = [_nearest_broadcast(notices, stored.filter(F.col("_block") == b).drop("_block")) for b in range(blocks)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def nearest(notices: DataFrame, queries: DataFrame, max_queries: int = QUERY_BLOCK_ROWS,
            max_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Candidate rows (request_key, k, id, date, score): every query's best k of each slice of the
    notices, by cosine, among the rows its filters admit. The best k overall are among them.

    notices: id, date, embedding, event_category, action_taken, code, significance_score.
    queries: request_key, vector, k and the six `want_` filter columns.
    """
    notices = notices.filter(F.col("embedding").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "date", "embedding", "event_category",
        "action_taken", "code", "significance_score")
    queries = queries.filter(F.col("vector").isNotNull()).select(
        F.col("request_key").cast("string").alias("request_key"), "vector", F.col("k").cast("int").alias("k"),
        *[f"want_{c}" for c in FILTER_COLUMNS])
    notices = spread(notices)
    BOUNDS.clear()
    if is_small(queries, 4 * F.size("vector"), max_queries, max_bytes):
        return _nearest_broadcast(notices, queries)
    return _nearest_passes(notices, queries, max_queries)
