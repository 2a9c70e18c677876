"""Landed record pages (JSON) and the notice rows in them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeboard.functions import records as R
from noticeboard.schema import RAW_PAGE
from noticeboard.sources.types import notice_types, with_labels

# Arrival order of a record: files by the time they landed, then by path; then place on the page.
SEQUENCE = ["landed", "file", "position"]
DAMAGED = "_damaged"


def _records(pages: DataFrame) -> DataFrame:
    """One row per record; a page is one small file (100 records), so it is exploded in place."""
    return (pages.select(F.col("search.result_count").alias("result_count"),
                         R.live_edge(F.col("search.results")).alias("live_edge"), "landed", "file", "year",
                         F.posexplode("search.results").alias("position", "record"))
            .select("result_count", R.page_count(F.col("result_count")).alias("page_count"),
                    "live_edge", "landed", "file", "year", "position", "record.*"))


def _sound(pages: DataFrame, skip_damaged: bool) -> DataFrame:
    """Pages that parsed whole. A damaged page (cut short, no result list) stops the load, or is left out where
    the caller asks for that and reads rejected_pages."""
    damaged = F.col(DAMAGED).isNotNull() | F.col("search.results").isNull()
    if skip_damaged:
        return pages.filter(~damaged)
    return pages.filter(F.assert_true(~damaged, F.concat(F.lit("damaged page: "), F.col("file"))).isNull())


def _with_file(pages: DataFrame) -> DataFrame:
    return pages.select("search", "year", DAMAGED, F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_modification_time").alias("landed"))


def _page_schema() -> str:
    return RAW_PAGE + f", year int, {DAMAGED} string"


def _read(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(_page_schema()).option("multiLine", "true")
            .option("columnNameOfCorruptRecord", DAMAGED).json(path))


def rejected_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, landed, year, damaged text) of the pages that do not parse whole."""
    return (_with_file(_read(spark, path)).filter(F.col(DAMAGED).isNotNull() | F.col("search.results").isNull())
            .select("file", "landed", "year", F.col(DAMAGED).alias("damaged")))


def read_pages(spark: SparkSession, path: str, year_from: int | None = None,
               year_to: int | None = None, skip_damaged: bool = False) -> DataFrame:
    """Records of all landed pages, or of a window of year=YYYY folders (pruned before reading)."""
    pages = _read(spark, path)
    if year_from is not None:
        pages = pages.filter(F.col("year") >= year_from)
    if year_to is not None:
        pages = pages.filter(F.col("year") <= year_to)
    return _records(_sound(_with_file(pages), skip_damaged))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000,
                 skip_damaged: bool = False) -> DataFrame:
    """The same as a stream. The checkpoint of the query that consumes it remembers which files
    were read, so a restart resumes after the last committed batch."""
    pages = (spark.readStream.schema(_page_schema()).option("multiLine", "true")
             .option("columnNameOfCorruptRecord", DAMAGED).option("maxFilesPerTrigger", files_per_batch).json(path))
    return _records(_sound(_with_file(pages), skip_damaged))


def build_notices(records: DataFrame, types: DataFrame | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Record -> notice row; records without a notice number drop out."""
    def text_of(name: str) -> Column:
        return R.plain_text(F.col(name))

    shaped = records.select(
        R.notice_id(F.col("dc_identifier")).alias("id"), R.day(F.col("date")).alias("date"),
        R.bad_day(F.col("date")).alias("bad_day"), "title",
        R.body(text_of("fulltext"), text_of("description")).alias("fulltext"), "landing_url", *keep)
    identified = drop_unidentified(shaped).withColumn("code", R.type_code(F.col("id")))
    types = notice_types(records.sparkSession) if types is None else types
    return with_labels(identified, types).select(
        "id", "code", "type", "date", "title", R.nzbn(F.col("fulltext")).alias("nzbn"),
        R.company_number(F.col("fulltext")).alias("company_number"), "fulltext", "landing_url",
        R.source_stamp().alias("source"), "bad_day", *keep)


def drop_unidentified(df: DataFrame) -> DataFrame:
    return df.filter(F.col("id").isNotNull())
