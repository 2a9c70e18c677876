"""Request-log streams: window counts, rate-limit decisions, the log itself."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeboard.fixed_values import PER_DAY_LIMIT, PER_MINUTE_LIMIT
from noticeboard.functions.clients import utc_day, utc_minute
from noticeboard.operators.topn import first_n


def stream_window_hits(log: DataFrame, width: str = "1 minute", delay: str = "1 hour",
                       by_ip: bool = True) -> DataFrame:
    """Tumbling counts per address (or overall); partial counts combine before the shuffle."""
    keys = [F.window("ts", width).alias("window")] + ([F.col("ip")] if by_ip else [])
    counts = log.withWatermark("ts", delay).groupBy(*keys).agg(F.count("*").alias("hits"))
    return counts.select(F.col("window.start").alias("window_start"),
                         *(["ip"] if by_ip else []), "hits")


def write_window_hits(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores the counts of every window, the ones still open included: each micro-batch writes the counts
    it changed as one folder, which a replay replaces. Rows later than the watermark's delay are left
    out by the engine, which counts them (`numRowsDroppedByWatermark` of the query's progress)."""
    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    return (counts.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_window_hits(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each window; counts only grow, so it is the largest."""
    stored = spark.read.parquet(path).drop("batch")
    return stored.groupBy(*[c for c in stored.columns if c != "hits"]).agg(F.max("hits").alias("hits"))


class RateLimiter:
    """Per-address minute and day limits over micro-batches.

    Counters are rows keyed by (ip, window), kept as one folder per micro-batch; batch n reads only
    folder n-1 and replaces folder n, so a replay gives the same verdicts. Inside a batch the same
    first-n cuts as in the batch job apply, so a hot address is trimmed in the map tasks.
    Counters older than `keep_days` before the newest day of earlier batches are dropped. A request of
    such a day can no longer be judged, so it is refused: reason `late`, status 429, not counted.
    """
    COUNTERS = "kind string, ip string, window string, hits bigint"

    def __init__(self, spark: SparkSession, root: str, per_minute: int = PER_MINUTE_LIMIT,
                 per_day: int = PER_DAY_LIMIT, keep_days: int = 1):
        self.spark, self.root = spark, root.rstrip("/")
        self.per_minute, self.per_day, self.keep_days = per_minute, per_day, keep_days

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch:09d}"

    def _counters(self, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], self.COUNTERS)
        return self.spark.read.schema(self.COUNTERS).parquet(self._path("counters", batch - 1))

    def _ranked(self, hits: DataFrame, counters: DataFrame, kind: str, window: str,
                limit: int) -> DataFrame:
        """Rows that are among the first `limit` of their window, earlier batches included."""
        order = [F.col("ts").asc(), F.col("event_id").asc()]
        before = counters.filter(F.col("kind") == kind).select(
            "ip", F.col("window").alias(window), F.col("hits").alias("_before"))
        first = first_n(hits, ["ip", window], order, limit, "event_id")
        return (first.join(before, ["ip", window], "left")
                .filter(F.col("rank") + F.coalesce("_before", F.lit(0)) <= limit)
                .drop("rank", "_before"))

    def run_batch(self, log: DataFrame, batch: int) -> None:
        counters = self._counters(batch)
        horizon = counters.filter("kind = 'horizon'").agg(F.max("window")).first()[0]
        log = log.persist()
        late = F.coalesce(utc_day(F.col("ts")) < F.lit(horizon), F.lit(False))
        hits = log.filter(~late).select("event_id", "ip", "ts", utc_minute(F.col("ts")).alias("minute"),
                          utc_day(F.col("ts")).alias("day"))
        minute_ok = self._ranked(hits, counters, "minute", "minute", self.per_minute)
        day_ok = self._ranked(minute_ok, counters, "day", "day", self.per_day)
        verdicts = (minute_ok.select("event_id")
                    .join(day_ok.select("event_id", F.lit("ok").alias("reason")), "event_id", "left")
                    .withColumn("reason", F.coalesce("reason", F.lit("ip_day"))))
        reason = F.when(late, F.lit("late")).otherwise(F.coalesce("reason", F.lit("ip_minute")))
        (log.join(verdicts, "event_id", "left").withColumn("reason", reason)
         .withColumn("status", F.when(F.col("reason") == "ok", F.lit(200)).otherwise(F.lit(429)))
         .write.mode("overwrite").parquet(self._path("decisions", batch)))

        def counted(df: DataFrame, kind: str, window: str) -> DataFrame:
            return (df.groupBy("ip", F.col(window).alias("window")).agg(F.count("*").alias("hits"))
                    .select(F.lit(kind).alias("kind"), "ip", "window", "hits"))

        merged = (counters.unionByName(counted(hits, "minute", "minute"))
                  .unionByName(counted(minute_ok, "day", "day"))
                  .groupBy("kind", "ip", "window").agg(F.sum("hits").alias("hits")))
        newest = log.agg(F.max(F.to_date("ts"))).first()[0]
        if newest is not None:
            oldest_kept = max(horizon or "", (newest - timedelta(days=self.keep_days)).isoformat())
            line = self.spark.createDataFrame([("horizon", "", oldest_kept, 0)], self.COUNTERS)
            merged = (merged.filter((F.col("kind") != "horizon")
                                    & (F.substring("window", 1, 10) >= oldest_kept)).unionByName(line))
        merged.write.mode("overwrite").parquet(self._path("counters", batch))
        log.unpersist()

    def start(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """log: streaming event_id, ip, ts."""
        return (log.writeStream.foreachBatch(self.run_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def decisions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/decisions").drop("batch")


def stream_request_log(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends log lines to one folder per UTC day."""
    return (lines.writeStream.partitionBy("day").format("json").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
