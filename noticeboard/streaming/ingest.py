"""Incremental ingest of landed pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeboard.sources.notices import NoticeTable
from noticeboard.sources.pages import SEQUENCE, build_notices, read_pages, stream_pages
from noticeboard.sources.types import notice_types


def stream_ingest(spark: SparkSession, pages: str, table_root: str, checkpoint: str,
                  files_per_batch: int = 1000, skip_damaged: bool = False) -> int:
    """Reads every page file not seen before and upserts its notices, then stops. Returns the
    number of micro-batches.

    Re-read pages arrive as new files and repeat ids; the upsert is idempotent, so at-least-once
    delivery is enough and no watermark may drop late records. A micro-batch that is replayed after
    a crash upserts the same rows once more, which changes nothing.
    """
    table = NoticeTable(spark, table_root)
    types = notice_types(spark)
    start = table.last_batch() + 1
    offset: dict[str, int] = {}

    def load(records: DataFrame, batch_id: int) -> None:
        first = offset.setdefault("first", batch_id)
        offset["batches"] = offset.get("batches", 0) + 1
        rows = build_notices(records, types, keep=tuple(SEQUENCE))
        table.upsert(rows, SEQUENCE, batch=start + batch_id - first)

    query = (stream_pages(spark, pages, files_per_batch, skip_damaged).writeStream
             .foreachBatch(load).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return offset.get("batches", 0)


def full_reload(spark: SparkSession, pages: str, table_root: str, year_from: int | None = None,
                year_to: int | None = None) -> int:
    """All landed pages again, ignoring the stream's checkpoint."""
    rows = build_notices(read_pages(spark, pages, year_from, year_to), keep=tuple(SEQUENCE))
    return NoticeTable(spark, table_root).reload(rows, SEQUENCE)
