"""Published statistics and the request log."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.fixed_values import ERROR_CHARS, LOG_RETENTION_DAYS, USER_AGENT_CHARS
from noticeboard.functions.clients import client_ip, hash_ip, utc_day
from noticeboard.functions.text import truncate
from noticeboard.operators.stats import stats_document
from noticeboard.schema import REQUEST_LOG


def publish_stats(df: DataFrame, path: str) -> None:
    """The statistics document, replaced as a whole."""
    stats_document(df).write.mode("overwrite").text(path)


def log_lines(requests: DataFrame, salt: str) -> DataFrame:
    """Raw requests -> log lines with the address hashed.

    requests: ts, route, forwarded, peer, country, ua, referer, request, response, status, ms,
    error."""
    return requests.select(
        F.col("ts").cast("timestamp").alias("ts"), "route",
        hash_ip(client_ip(F.col("forwarded"), F.col("peer")), salt).alias("ip_hash"), "country",
        truncate(F.coalesce("ua", F.lit("")), USER_AGENT_CHARS).alias("ua"), "referer", "request",
        "response", "status", "ms", truncate(F.col("error"), ERROR_CHARS).alias("error"),
        utc_day(F.col("ts").cast("timestamp")).alias("day"))


def write_request_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").partitionBy("day").json(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_LOG + ", day string").json(path)


def prune_log(spark: SparkSession, path: str, as_of: date,
              days: int = LOG_RETENTION_DAYS) -> tuple[int, int]:
    """Deletes day folders older than the window; the day in the name decides. (kept, pruned)."""
    cutoff = (as_of - timedelta(days=days)).isoformat()
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = pruned = 0
    for status in (fs.listStatus(root) if fs.exists(root) else []):
        name = status.getPath().getName()
        if not name.startswith("day="):
            continue
        if name[len("day="):] < cutoff:
            fs.delete(status.getPath(), True)
            pruned += 1
        else:
            kept += 1
    return kept, pruned
