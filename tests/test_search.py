"""Search against brute force."""
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.fixed_values import EVENT_CATEGORIES, SEARCH_CASES
from noticeboard.functions.text import words
from noticeboard.operators.phrases import match_phrases
from noticeboard.operators.topn import best_first, first_n
from noticeboard.operators.vectors import nearest
from noticeboard.plans import search as Q
from noticeboard.operators.filters import Filters
from noticeboard.schema import FILTER_COLUMNS, REQUESTS

WORDS = "bay radiators limited plumbing services sunrise cafe skippy nz finance boston".split()


def corpus(seed=1, n=120, dim=8):
    rng = random.Random(seed)
    copies = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        vector = copies if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(dim)]   # a third are copies
        if i == 7:
            vector = [0.0] * dim
        rows.append({
            "id": f"n{i:03d}", "title": rng.choice(WORDS), "code": rng.choice(["al", "ds"]),
            "fulltext": " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))),
            "date": None if i % 10 == 0 else date(2020, 1, 1) + timedelta(days=rng.randint(0, 20)),
            "event_category": rng.choice(EVENT_CATEGORIES[:3]), "action_taken": "other",
            "significance_score": None if i % 4 == 0 else rng.randint(0, 100),
            "embedding": None if i == 11 else [float(np.float32(x)) for x in vector]})
    return rows


def requests(spark, queries):
    full = [(i, q, f.get("limit"), f.get("event_category"), f.get("action_taken"), f.get("code"),
             f.get("date_from"), f.get("date_to"), f.get("min_significance"))
            for i, (q, f) in enumerate(queries)]
    return spark.createDataFrame(full, REQUESTS)


def admitted(row, f):
    d, s = row["date"], row["significance_score"]
    return ((not f.get("event_category") or row["event_category"] == f["event_category"])
            and (not f.get("code") or row["code"] == f["code"])
            and (f.get("date_from") is None or (d is not None and d >= f["date_from"]))
            and (f.get("date_to") is None or (d is not None and d <= f["date_to"]))
            and (f.get("min_significance") is None or (s is not None and s >= f["min_significance"])))


def newest_key(row):
    return (-(row["date"] or date.max).toordinal(), row["id"])


QUERIES = [("limited", {}), ("bay radiators", {"limit": 3}), ("Bay Plumbing", {"code": "al"}),
           ("cafe", {"min_significance": 0}), ("cafe", {"min_significance": 0}), ("zzz", {}), ("!!", {}),
           ("limited", {"event_category": "", "date_from": date(2020, 1, 5), "date_to": date(2020, 1, 12)})]


def word_rows(row):
    return (row["title"] + " " + row["fulltext"]).lower().split()


def occurrences(row, phrase):
    have, want = word_rows(row), phrase.lower().split()
    return sum(have[i:i + len(want)] == want for i in range(len(have) - len(want) + 1))


def keyword_brute_force(rows, query, f):
    import math
    scored = []
    for row in rows:
        tf = occurrences(row, query)
        if tf and admitted(row, f):
            n = len(word_rows(row))
            score = (0.1 * sum(1 / j ** 2 for j in range(1, tf + 1)) / 1.64493406685 / math.log2(n + 1)
                     + (row["significance_score"] or 0) / 100 - min(len(row["fulltext"]) / 20000, 1))
            scored.append((score, row))
    best = sorted(scored, key=lambda p: (-p[0], newest_key(p[1])))[:f.get("limit") or 20]
    return [row["id"] for _, row in sorted(best, key=lambda p: newest_key(p[1]))]


def pages(df):
    out = {}
    for r in df.orderBy("query_id", "position").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_keyword_search_is_brute_force(spark, notices):
    rows = corpus()
    got = pages(Q.keyword_search(notices(rows), requests(spark, QUERIES)))
    for i, (q, f) in enumerate(QUERIES):
        want = keyword_brute_force(rows, q, f) if q != "!!" else []
        assert got.get(i, []) == want, q


def test_single_query_equals_batch(spark, notices):
    table = notices(corpus())
    wanted = Filters(code="al", min_significance=0)
    single = [r["id"] for r in Q.search_phrase(table, "limited", wanted, 5).collect()]
    batch = pages(Q.keyword_search(table, requests(
        spark, [("limited", {"code": "al", "min_significance": 0, "limit": 5})])))
    assert single == batch[0]


def test_large_phrase_tables_take_the_shuffled_join(spark, notices):
    table = notices(corpus()).select("id", "tokens")
    phrases = requests(spark, QUERIES).select("query_id", words(F.col("q")).alias("words"))
    pairs = lambda df: sorted((r["query_id"], r["id"]) for r in df.select("query_id", "id").collect())
    assert pairs(match_phrases(table, phrases)) == pairs(match_phrases(table, phrases, max_rows=0))


def vector_requests(spark, n=9, dim=8):
    rng = random.Random(5)
    filters = [{}, {"event_category": "liquidation"}, {"date_from": date(2020, 1, 9)}, {"code": "ds"},
               {"min_significance": 0, "date_to": date(2020, 1, 15)}]
    rows = [(f"q{i}", [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)], 3 + 7 * (i % 3),
             filters[i % 5]) for i in range(n)]
    schema = ("request_key string, vector array<float>, k int, " + ", ".join(
        f"want_{c} {t}" for c, t in zip(FILTER_COLUMNS, ("string", "string", "string", "date", "date", "int"))))
    return rows, spark.createDataFrame(
        [(key, v, k, *[f.get(c) for c in FILTER_COLUMNS]) for key, v, k, f in rows], schema)


def cosine_of(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return -2.0 if na == 0 or nb == 0 else round(float(np.dot(a, b) / na / nb), 9)


@pytest.mark.parametrize("max_queries", [4096, 2])
def test_nearest_is_brute_force(spark, notices, max_queries):
    rows = corpus()
    asked, frame = vector_requests(spark)
    found = nearest(notices(rows).repartition(3), frame, max_queries=max_queries)
    got = {}
    for r in first_n(found, ["request_key"], best_first(), 100).filter("rank <= k") \
            .orderBy("request_key", "rank").collect():
        got.setdefault(r["request_key"], []).append(r["id"])
    for key, vector, k, f in asked:
        able = [r for r in rows if r["embedding"] is not None and admitted(r, f)]
        want = sorted(able, key=lambda r: (-cosine_of(r["embedding"], vector), newest_key(r)))[:k]
        assert got.get(key, []) == [r["id"] for r in want], key


def test_semantic_search_with_bonus_is_brute_force(spark, notices):
    rows = corpus()
    rng = random.Random(9)
    keywords = [[], ["bay radiators", "cafe"], ["limited"], [' "" '], None]
    vectors = [[float(np.float32(rng.gauss(0, 1))) for _ in range(8)] for _ in range(5)]
    asked = requests(spark, [("a b c d", {"limit": 12})] * 5)
    extra = spark.createDataFrame(list(zip(range(5), vectors, keywords)),
                                  "query_id bigint, vector array<float>, keywords array<string>")
    got = pages(Q.semantic_search(notices(rows), asked.join(extra, "query_id")))
    for i in range(5):
        def score(row):
            clean = [k for k in keywords[i] or [] if k.strip(' "')]
            return cosine_of(row["embedding"], vectors[i]) + 0.1 * any(occurrences(row, k) for k in clean)
        able = [r for r in rows if r["embedding"] is not None]
        best = sorted(able, key=lambda r: (-score(r), newest_key(r)))[:12]
        assert got[i] == [r["id"] for r in sorted(best, key=newest_key)], i


def test_routed_search_merges_inferred_filters(spark, notices):
    rows = corpus()
    asked = requests(spark, [("bay radiators limited", {}), ("which bay companies failed", {}),
                             ("which bay companies failed", {"event_category": ""}), ("who knows what why", {})])

    def parser(text):
        if text.startswith("who"):
            raise RuntimeError("down")
        return '{"event_category": "receivership", "keywords": ["bay"]}'

    table = notices([{**r, "embedding": [1.0] * 64} for r in rows])
    found = Q.search(table, asked, parser).join(table.select("id", "event_category"), "id").collect()
    routes = {r["query_id"]: r["route"] for r in found}
    assert routes[1] == routes[2] == routes[3] == "semantic" and routes.get(0, "keyword") == "keyword"
    kinds = lambda q: {r["event_category"] for r in found if r["query_id"] == q}
    assert kinds(1) == {"receivership"} and len(kinds(2)) > 1 and len(kinds(3)) > 1


def test_search_regression_cases(spark, notices):
    """The bulk notice lists real names; names that borrow words from several of them must miss."""
    table = notices([
        {"id": "a", "title": "Du Val Group", "fulltext": "receivership"},
        {"id": "b", "title": "Sacred Hill Vineyards", "fulltext": "liquidation of company"},
        {"id": "c", "title": "Removals", "fulltext":
            "BAY RADIATORS LIMITED, BOSTON FINANCE LIMITED, SKIPPY NZ LIMITED, KAIKOURA CAFE LIMITED, "
            "SUNRISE ELECTRICAL LIMITED, TARQUIN SERVICES LIMITED, BLAKELEY PLUMBING SERVICES LIMITED, "
            "VANDERMEER LIMITED"}])
    cases = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(SEARCH_CASES)],
        "query_id bigint, q string, expect_hit boolean, must_contain string")
    asked = requests(spark, [(c[0], {"limit": 3}) for c in SEARCH_CASES])
    verdicts = Q.evaluate(Q.keyword_search(table, asked), table, cases).collect()
    assert len(verdicts) == 12 and all(v["passed"] for v in verdicts), verdicts


def test_first_n_beyond_the_group_limit(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"))
    got = first_n(df, ["g"], [F.col("id").asc()], 1500)
    assert [r["id"] for r in got.orderBy("rank").collect()] == list(range(1500))


def test_hot_groups_are_cut_before_the_shuffle(spark, notices):
    plan = Q.keyword_search(notices(corpus()), requests(spark, QUERIES)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_bounds_skip_far_batches_and_stay_exact(spark, notices, monkeypatch):
    import noticeboard.operators.vectors as V
    monkeypatch.setattr(V, "NOTICE_SLICE_ROWS", 8)
    rng = np.random.default_rng(2)
    centre = {"a": rng.normal(size=8), "b": -rng.normal(size=8)}
    rows = [{"id": f"{c}{i}", "title": "t", "fulltext": "x", "date": date(2020, 1, 1 + i % 20),
             "event_category": "liquidation", "action_taken": "a", "code": "ds", "significance_score": 5,
             "embedding": [float(x) for x in centre[c] + 0.01 * rng.normal(size=8)]}
            for c in "ab" for i in range(64)]
    asked = [(f"q{c}{i}", [float(x) for x in centre[c] + 0.01 * rng.normal(size=8)], 3) for c in "ab" for i in range(4)]
    schema = ("request_key string, vector array<float>, k int, " + ", ".join(
        f"want_{c} {t}" for c, t in zip(FILTER_COLUMNS, ("string", "string", "string", "date", "date", "int"))))
    frame = spark.createDataFrame([(key, v, k, None, None, None, None, None, None) for key, v, k in asked], schema)
    found = nearest(notices(rows).coalesce(1), frame, max_queries=3)
    got = {}
    for r in first_n(found, ["request_key"], best_first(), 100).filter("rank <= k").orderBy("request_key", "rank").collect():
        got.setdefault(r["request_key"], []).append(r["id"])
    for key, vector, k in asked:
        want = sorted(rows, key=lambda r: (-cosine_of(r["embedding"], vector), newest_key(r)))[:k]
        assert got[key] == [r["id"] for r in want], key
    assert V.BOUNDS["skipped"].value > 0 and V.BOUNDS["skipped"].value < V.BOUNDS["pairs"].value
