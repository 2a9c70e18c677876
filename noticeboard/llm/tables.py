"""Small helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, functions as F

from noticeboard.session import work_dir

BROADCAST_ROWS = 400_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared working folder and read back: lineage is cut, and a lost executor
    costs no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast where a count proves it within the bound; beyond it
    the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spared(df: DataFrame, needed: Collection[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(df with every column but the needed ones under a neutral name, a function that gives the names back).
    Whatever an operator calls its own columns, none meets a column that only passes through. restored(out,
    *added) returns df's columns and then the added ones; a column of df with an added name is replaced."""
    spare = {i: f"_passed_through_{i}" for i, c in enumerate(df.columns) if c not in needed}
    names = df.columns

    def restored(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*(F.col(spare.get(i, c)).alias(c) for i, c in enumerate(names) if c not in added), *added)
    return df.toDF(*(spare.get(i, c) for i, c in enumerate(names))), restored
