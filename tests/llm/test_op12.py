"""Mixing to target weights: sizes and targets against a plain water filling, rounding against its promises."""
import re
from collections import defaultdict

from pyspark.sql import functions as F

from noticeboard.llm import op12_mixing as op12

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string"


def targets(rows):
    """rows: [(text, source)] -> {source: (source_size, target)} by repeated capping."""
    sizes = defaultdict(int)
    for text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(3 * sizes[s] for s in capped)) / free if free else 0.0
        over = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: (sizes[s], 3.0 * sizes[s] if s in capped else weight[s] * level) for s in order}
        capped |= over


def check(spark, rows, ids=None):
    df = spark.createDataFrame([(i if ids is None else ids[i], t, s, "clash") for i, (t, s) in enumerate(rows)], DOCS)
    got = op12.mix(df).collect()
    want = targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    biggest = defaultdict(int)
    for r in got:
        size, target = want[r["source"]]
        assert r["source_size"] == size and abs(r["target"] - target) <= 1e-6 * max(1.0, target)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    for s, (size, target) in want.items():
        assert abs(taken[s] - target) <= biggest[s], (s, taken[s], target)   # one residual document at most
    assert abs(sum(t for _, t in want.values()) - sum(sz for sz, _ in want.values())) < 1e-6 * max(1, sum(sz for sz, _ in want.values()))
    return got


def test_targets_caps_and_rounding(spark):
    rows = []
    for i in range(600):
        source = ["big", "b", "c", None, "Zed", "ä"][i % 6] if i % 7 else "big"
        rows.append((None if i % 50 == 0 else " ".join(["w"] * (1 + (i * 37) % 300)), source))
    rows += [("tiny source", "a-small"), ("", "empty"), (None, "nulls")]
    rows += rows[:20]                         # repeated rows
    got = check(spark, rows, ids=[i % 400 for i in range(len(rows))])
    again = op12.mix(spark.createDataFrame([(i % 400, t, s, "x") for i, (t, s) in enumerate(rows)], DOCS))
    assert sorted(map(tuple, again.select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_many_groups_and_levels(spark, monkeypatch):
    monkeypatch.setattr(op12, "GROUP_ROWS", 7)
    monkeypatch.setattr(op12, "FAN", 2)
    rows = [(" ".join(["x"] * (1 + i % 40)), "hot" if i % 3 else f"s{i % 5}") for i in range(500)]
    check(spark, rows)


def test_empty_and_single(spark):
    assert op12.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = check(spark, [(None, None)])
    assert got[0]["taken"] == 0 and got[0]["target"] == 0.0
    one = check(spark, [("a b c", "only")])
    assert one[0]["taken"] == 3 and one[0]["target"] == 3.0


def test_pivot_keeps_words_and_marginals():
    import numpy as np
    rng = np.random.default_rng(1)
    words = rng.integers(1, 500, 40).astype(float)
    p = rng.random(40)
    mean = np.zeros(40)
    for seed in range(2000):
        out, carry = op12._pivot(p, words, np.random.default_rng(seed))
        assert sum(0 < v < 1 for v in out) <= 1
        assert abs((out * words).sum() - (p * words).sum()) < 1e-6
        mean += out
    assert np.abs(mean / 2000 - p).max() < 0.06
