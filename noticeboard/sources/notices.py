"""The notices table on shared storage: a base snapshot plus committed deltas.

    <root>/base/batch=<n>/year=<y>     full table after batch n
    <root>/delta/batch=<n>/year=<y>    full rows of the ids that batch n touched

A batch reads only the years its ids belong to and writes only the rows it touches; it is replaced
as a whole when it is replayed, so a lost executor or a repeated batch changes nothing. Readers
overlay deltas on the newest base; compact() folds them in. A folder counts once its _SUCCESS marker
is there.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeboard.functions.text import tokens
from noticeboard.operators.sizing import is_small
from noticeboard.operators.topn import first_n
from noticeboard.operators.upsert import apply_annotations, apply_vectors, upsert
from noticeboard.schema import FULL_COLUMNS, NOTICES


def notices(spark: SparkSession, path: str) -> DataFrame:
    """A plain Parquet notices table."""
    return spark.read.parquet(path)


def full(df: DataFrame) -> DataFrame:
    return df.select(*FULL_COLUMNS)


def get_notice(df: DataFrame, id_: str) -> DataFrame:
    """Point lookup; no such id gives no row."""
    return full(df.filter(F.col("id") == id_))


def get_notices(df: DataFrame, ids: DataFrame) -> DataFrame:
    return full(df.join(ids.select("id"), "id", "left_semi"))


def append_notices(df: DataFrame, path: str) -> None:
    """Durable append by publication year: a failed write leaves nothing behind."""
    (df.withColumn("year", _year_of(F.col("id"))).hint("rebalance", "year")
     .write.mode("append").partitionBy("year").parquet(path))


MAX_YEARS = 1000      # distinct id years worth naming in a partition filter


def _year_of(id_: Column) -> Column:
    return F.substring(id_, 1, 4)


class NoticeTable:
    """Read and change the table; see the module text for the layout."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._empty = spark.createDataFrame([], NOTICES)

    def _batches(self, kind: str) -> list[int]:
        """Committed batch numbers of a kind, ascending."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in names
                      if p.getName().startswith("batch=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _parts(self, before: int | None = None) -> tuple[int | None, list[int]]:
        ok = lambda n: before is None or n < before
        bases = [n for n in self._batches("base") if ok(n)]
        base = bases[-1] if bases else None
        return base, [n for n in self._batches("delta") if ok(n) and (base is None or n > base)]

    def last_batch(self) -> int:
        return max([-1, *self._batches("base"), *self._batches("delta")])

    def read(self, before: int | None = None, years: list[str] | None = None) -> DataFrame:
        """The table as of the newest batch, or as of the batches before a number; only the given
        years' folders where years are given."""
        base_id, delta_ids = self._parts(before)

        def read(kind: str, ids: list[int]) -> DataFrame:
            rows = (self.spark.read.schema(NOTICES + ", batch int, year string")
                    .option("basePath", f"{self.root}/{kind}")
                    .parquet(*[f"{self.root}/{kind}/batch={n:09d}" for n in ids]))
            return rows if years is None else rows.filter(F.col("year").isin(years))

        columns = self._empty.columns
        base = read("base", [base_id]).select(*columns) if base_id is not None else self._empty
        if not delta_ids:
            return base
        deltas = read("delta", delta_ids)
        newest = first_n(deltas, ["id"], [F.col("batch").desc()], 1).select(*columns)
        if base_id is None:
            return newest
        replaced = newest.select("id")
        if is_small(deltas, F.length("id") + F.lit(16)):
            replaced = F.broadcast(replaced)     # no more ids than delta rows, which fit
        return base.join(replaced, "id", "left_anti").unionByName(newest)

    def _write(self, df: DataFrame, kind: str, batch: int, *sort: str) -> None:
        """One folder per year; rebalancing gives each year as many even files as it needs."""
        rows = df.select(*self._empty.columns).withColumn("year", _year_of(F.col("id")))
        rows = rows.hint("rebalance", "year")
        if sort:
            rows = rows.sortWithinPartitions("year", *sort)
        rows.write.mode("overwrite").partitionBy("year").parquet(
            f"{self.root}/{kind}/batch={batch:09d}")

    def _commit(self, batch: int, ids: DataFrame,
                change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes the changed rows of the given ids as one delta."""
        ids = ids.select("id").distinct()
        years = [r[0] for r in ids.select(_year_of(F.col("id"))).distinct().limit(MAX_YEARS + 1)
                 .collect()]
        table = self.read(before=batch, years=years if len(years) <= MAX_YEARS else None)
        self._write(change(table.join(ids, "id", "left_semi")), "delta", batch)

    def _staged(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        """Incoming rows written first: they are used several times, and answers of outside
        functions need not be the same when asked again."""
        path = f"{self.root}/{kind}/batch={batch:09d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _number(self, batch: int | None) -> int:
        return self.last_batch() + 1 if batch is None else batch

    def upsert(self, batch_rows: DataFrame, seq: list[str], batch: int | None = None,
               reset_on_change: bool = False) -> int:
        batch = self._number(batch)
        rows = self._staged(batch_rows, "landed", batch)
        self._commit(batch, rows, lambda touched: upsert(
            touched, rows, seq, reset_on_change=reset_on_change)
            .withColumn("tokens", tokens(F.col("title"), F.col("fulltext"))))
        return batch

    def annotate(self, annotations: DataFrame, batch: int | None = None) -> int:
        batch = self._number(batch)
        answers = self._staged(annotations, "answers", batch)
        self._commit(batch, answers, lambda touched: apply_annotations(touched, answers))
        return batch

    def embed(self, vectors: DataFrame, batch: int | None = None) -> int:
        batch = self._number(batch)
        found = self._staged(vectors, "vectors", batch)
        self._commit(batch, found, lambda touched: apply_vectors(touched, found))
        return batch

    def reload(self, rows: DataFrame, seq: list[str]) -> int:
        """Full reload: every landed record again, over whatever the table holds."""
        return self.upsert(rows, seq)

    def compact(self) -> int:
        """Folds all deltas into a new base named after the newest batch, sorted within files by
        code and date so that filters skip row groups."""
        batch = self.last_batch()
        if batch >= 0 and batch not in self._batches("base"):
            self._write(self.read(), "base", batch, "code", "date")
        return batch
