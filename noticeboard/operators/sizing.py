"""Checks that decide whether a side may be broadcast."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, row_bytes: Column, max_rows: int = BROADCAST_ROWS,
             max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the whole side fits the broadcast bounds, counted on the data itself. Reads at most
    one row more than the bound."""
    head = df.select(row_bytes.cast("long").alias("b")).limit(max_rows + 1)
    n, size = head.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes
