"""Ranked lexical search: Block-Max MaxScore against exhaustive scoring in Python and in Spark."""
import math
import random
import re
from collections import Counter

from noticeboard.llm import op11_search as op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, query long, extra string"


def terms(text):
    if text is None:
        return []
    return TERM.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def exhaustive(docs, queries, k=10):
    """docs: [(doc_id, text)], queries: [(query, text)] -> {(query, rank): (doc_id, score)}."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(i, d, c) for i, (d, c) in enumerate(counted)]
    held = [(i, d, c) for i, d, c in counted if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, _, c in held)
    df = Counter(t for _, _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = {}
    for q, text in queries:
        qt = terms(text)
        scored = []
        for i, d, c in held:
            m = 25 + (75 * sum(c.values()) * big_n) // big_l
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in qt if c.get(t))
            if s > 0:
                scored.append((-s, (d is None, d if d is not None else 0), i, d, s))
        for rank, (_, _, _, d, s) in enumerate(sorted(scored)[:k], 1):
            out[(q, rank)] = (d, s)
    return out


def run(spark, docs, queries, k=10):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(t, n, "y") for n, t in queries], "text string, query long, doc_id string")
    return {(r["query"], r["rank"]): (r["doc_id"], r["score"]) for r in op11.search(d, q, k).collect()}


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "and", "Ünï", "日本"]
    texts = []
    for i in range(n):
        if i % 17 == 0:
            texts.append(None)
        elif i % 19 == 0:
            texts.append("")
        else:
            size = rng.choice([1, 5, 30, 200, 2000])
            texts.append(" ".join(rng.choice(vocabulary[:20] if rng.random() < 0.5 else vocabulary) for _ in range(size))
                         + rng.choice(["", ". THE End!", "\tw1,w2;w3"]))
    return texts


def test_equals_exhaustive_scoring_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    texts = corpus(rng, 400)
    ids = [None if i % 23 == 0 else (i // 3 if i % 5 == 0 else i) for i in range(len(texts))]
    texts += texts[:30]                      # repeated rows
    ids += ids[:30]
    docs = list(zip(ids, texts))
    queries = [(n, " ".join(rng.choice(["w1", "w2", "the", "w250", "W7", "and", "日本", "zz"]) for _ in range(rng.randint(1, 9))))
               for n in range(25)] + [(99, None), (98, ""), (97, "!!! ..."), (96, "unseen words only")]
    assert run(spark, docs, queries) == exhaustive(docs, queries)


def test_agrees_with_spark_brute_force_at_small_k(spark):
    rng = random.Random(8)
    docs = list(enumerate(corpus(rng, 300)))
    queries = [(n, " ".join(rng.choice(["w1", "w2", "the", "w9", "w150"]) for _ in range(6))) for n in range(10)]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(n, t) for n, t in queries], "query long, text string")
    got = sorted(map(tuple, op11.search(d, q, 3).collect()))
    assert got == sorted(map(tuple, op11.brute_force(d, q, 3).collect()))
    assert len(got) == 30


def test_empty_tables_and_very_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    q = spark.createDataFrame([(1, "a b")], "query long, text string")
    assert op11.search(empty, q).count() == 0
    assert op11.search(spark.createDataFrame([(1, "a", 0, "x")], DOCS), q.limit(0)).count() == 0
    long = " ".join(["needle"] * 3 + ["hay"] * 400_000)
    docs = [(1, long), (2, "hay needle"), (3, "hay")]
    queries = [(1, "needle"), (2, "hay hay")]
    assert run(spark, docs, queries) == exhaustive(docs, queries)
