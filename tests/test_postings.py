"""Positional postings: occurrences against brute force, searches that never read texts, cost by postings."""
import random
import time

from pyspark.sql import functions as F

from noticeboard.operators.postings import occurrences, phrase_index
from noticeboard.plans import search as Q


def brute(rows, phrases):
    out = {}
    for r, (i, toks) in enumerate(rows):
        for key, words in phrases:
            n = len(words)
            c = sum(1 for s in range(len(toks) - n + 1) if n and toks[s:s + n] == words)
            if c:
                out[(key, r)] = c
    return out


def test_occurrences_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "of", "the", "x"]
    rows = [(f"n{i % 40}", [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]) for i in range(60)]
    rows += [("n1", ["a", "b", "a", "b", "a"]), ("n1", ["a", "b", "a", "b", "a"])]   # repeated id, overlaps
    phrases = [(1, ["a", "b", "a"]), (2, ["of", "the"]), (3, ["x"]), (4, []), (5, ["zz"]), (6, ["a", "zz"]),
               (7, ["the", "the", "the"]), (8, ["c", "a", "b", "c"])]
    notices = spark.createDataFrame(rows, "id string, tokens array<string>")
    index = phrase_index(notices)
    order = {r["_row"]: n for n, r in enumerate(index.rows.orderBy("_row").collect())}
    got = {(r["key"], order[r["_row"]]): r["occurrences"]
           for r in occurrences(index, spark.createDataFrame(phrases, "key int, words array<string>")).collect()}
    assert got == brute(rows, phrases)


def test_search_plan_reads_no_text_and_cost_follows_postings(spark):
    def notices(n_words):
        rng = random.Random(n_words)
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n_words))
        rows = [(str(i), f"t{i}", text + " needle point", "2020-01-02") for i in range(4)]
        df = spark.createDataFrame(rows, "id string, title string, fulltext string, date string")
        return df.select("id", F.col("date").cast("date").alias("date"), F.lit("c").alias("event_category"),
                         F.lit("a").alias("action_taken"), F.lit("x").alias("code"),
                         F.lit(10).alias("significance_score"), "fulltext",
                         F.split(F.concat_ws(" ", "title", "fulltext"), " ").alias("tokens"))
    requests = spark.createDataFrame([(1, "needle point", None), (2, "beta gamma", 5)], "query_id int, q string, limit int")
    requests = requests.select("query_id", "q", "limit", *[F.lit(None).cast(t).alias(c) for c, t in [
        ("event_category", "string"), ("action_taken", "string"), ("code", "string"), ("date_from", "date"),
        ("date_to", "date"), ("min_significance", "int")]])
    times = []
    for n in (40_000, 80_000):
        index = Q.keyword_index(notices(n))
        found = Q.keyword_search(index, requests)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "fulltext" not in plan
        started = time.time()
        assert found.filter("query_id = 1").count() == 4
        times.append(time.time() - started)
    assert times[1] <= 2.5 * times[0] + 2.0, times


def test_bounds_count_fewer_pairs_and_change_nothing(spark):
    from noticeboard.catalog import fixtures as X
    from noticeboard.operators.filters import request_filter
    from noticeboard.operators.topn import rank_then_newest_per
    sf = "/root/testdata/sf0.001"
    index = Q.keyword_index(X.docs(spark, sf))
    requests = X.requests(spark, sf)
    got = sorted(map(tuple, Q.keyword_search(index, requests).collect()))
    bounds = dict(Q.LAST_BOUNDS)
    # every candidate counted: the plain answer
    asked = Q.prepared(requests).withColumn("words", Q.words(F.col("q"))).filter(F.size("words") > 0)
    asked = asked.withColumn("request_key", Q._request_key("words"))
    distinct = asked.drop("query_id").dropDuplicates(["request_key"])
    found = occurrences(index, distinct.select("request_key", "words"), "request_key")
    hits = Q.with_keyword_score(found.join(index.rows, "_row").join(distinct.drop("words"), "request_key")
                                .filter(request_filter()), F.col("occurrences"))
    best = rank_then_newest_per(hits.select("request_key", "k", "id", "date", "score"), ["request_key"], 100, F.col("k"))
    want = best.join(asked.select("query_id", "request_key"), "request_key").select(
        "query_id", "id", "date", "score", "rank", "position")
    assert got == sorted(map(tuple, want.collect()))
    assert bounds["first"] + bounds["late"] < bounds["candidates"], bounds
