"""Rate limits against a step-by-step simulation, in batch and as a stream."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeboard.operators.requests import rate_decisions
from noticeboard.streaming.limits import RateLimiter


def events(n=600):
    rng = random.Random(3)
    start, at, rows = datetime(2024, 1, 1), 0.0, []
    for i in range(n):
        at += rng.expovariate(1 / 140)
        ip = "hot" if rng.random() < .5 else f"ip{rng.randint(0, 4)}"
        rows.append((i, ip, (start + timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S.%f")))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ip string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))


def simulate(rows, per_minute, per_day, cap):
    counts, out = {}, {}

    def hit(key):
        counts[key] = counts.get(key, 0) + 1
        return counts[key]

    for event, ip, ts in rows:
        if hit(("m", ip, ts[:16])) > per_minute:
            out[event] = 429
        elif hit(("d", ip, ts[:10])) > per_day:
            out[event] = 429
        elif cap is not None and hit(("g", ts[:10])) > cap:
            out[event] = 503
        else:
            out[event] = 200
    return out


@pytest.mark.parametrize("limits", [(1, 5, 12), (2, 100, 500), (3, 20, 30), (1, 1, 1)])
def test_batch_decisions(spark, limits):
    rows = events()
    got = rate_decisions(frame(spark, rows), *limits).select("event_id", "status").collect()
    assert {r["event_id"]: r["status"] for r in got} == simulate(rows, *limits)


def test_stream_decisions_over_micro_batches(spark, tmp_path):
    rows = events()
    limiter = RateLimiter(spark, str(tmp_path / "limits"), 1, 20)
    cuts = [0, 50, 51, 300, 470, 600]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if i == 2 else 1):       # a replayed micro-batch
            limiter.run_batch(frame(spark, rows[a:b]), i)
    got = {r["event_id"]: r["status"] for r in limiter.decisions().collect()}
    assert got == simulate(rows, 1, 20, None)


def test_requests_older_than_the_counters_are_refused_and_told_apart(spark, tmp_path):
    limiter = RateLimiter(spark, str(tmp_path / "limits"), 1, 20)
    batches = [[(0, "a", "2024-01-01 10:00:01"), (1, "a", "2024-01-01 10:00:02")],
               [(2, "a", "2024-01-05 09:00:00"), (3, "a", "2024-01-01 10:00:03")],
               [(4, "a", "2024-01-01 10:00:04"), (5, "b", "2024-01-02 00:00:00"), (6, "a", "2024-01-04 00:00:00")]]
    for i, rows in enumerate(batches):
        limiter.run_batch(frame(spark, rows), i)
    got = {r["event_id"]: (r["status"], r["reason"]) for r in limiter.decisions().collect()}
    assert got == {0: (200, "ok"), 1: (429, "ip_minute"), 2: (200, "ok"), 3: (429, "ip_minute"),
                   4: (429, "late"), 5: (429, "late"), 6: (200, "ok")}


def test_window_counts_hold_open_windows_and_grow_over_runs(spark, tmp_path):
    from noticeboard.streaming.limits import read_window_hits, stream_window_hits, write_window_hits
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))
    parts = [[(0, "a", "2024-01-01 10:00:01"), (1, "b", "2024-01-01 10:20:00")],
             [(2, "a", "2024-01-01 10:30:00"), (3, "a", "2024-01-01 11:00:00")]]
    for rows in parts:
        frame(spark, rows).write.mode("append").parquet(landed)
        log = spark.readStream.schema("event_id bigint, ip string, ts timestamp").parquet(landed)
        write_window_hits(stream_window_hits(log, "1 hour", "1 hour"), out, check).awaitTermination()
    got = {(r["window_start"].hour, r["ip"]): r["hits"] for r in read_window_hits(spark, out).collect()}
    assert got == {(10, "a"): 2, (10, "b"): 1, (11, "a"): 1}
