"""Ranked lexical search by Block-Max MaxScore.

Every query (here: a benchmark item) ranks all documents by an integer BM25-like score:

    terms   maximal runs of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F] (ASCII letters and digits, any non-ASCII),
            only A-Z lower-cased
    N, L    documents with at least one term, and all their terms with repeats; n: one document's terms
    w       floor(1000 * ln((2N + 2) / (2 df + 1)))          per term, df = documents that hold it
    m       25 + (75 n N) div L                              per document
    impact  (10^9 tf) div (1000 tf + 8 m)                    per posting (term, document), tf = occurrences
    score   sum over the query's terms (repeats counted) of w * impact

The method, as Spark jobs over stored tables:
1. Postings (term, row, tf, impact) of the queries' terms are counted inside each row and written once, in blocks of BLOCK consecutive rows of a scan partition;
   per term the largest impact (the list's global bound) and per (term, block) the block's largest impact.
2. A threshold per query: the documents of each term's champions (the best posting of each of CHAMPIONS shards
   of its list, by a partial aggregation) are scored exactly; the k-th best score among them cannot exceed the true k-th.
3. MaxScore: the query's terms sorted by bound; the longest prefix whose bounds add up to less than the
   threshold is non-essential, because a document that holds only those terms cannot reach the top k.
   Candidates come from the essential lists alone.
4. Block-max: a candidate's bound is its exact essential score plus the block maxima of its block in the
   non-essential lists (summed once per query and block). Candidates under the threshold are dropped before the non-essential postings are read
   (the "decompression"); the others are scored exactly.
5. Top k per (query, shard), then per query: the shards' heaps are merged.

Every document of the true top k has a score at least the threshold, so it holds an essential term and passes
the block bound: the result equals exhaustive scoring (tested against it and against SQL).

Nulls and ties: a null text has no terms, so it never scores; null or repeated doc_ids are documents of their
own (rows are keyed by a row number written with the postings); equal scores go by ascending doc_id, nulls
last; a query without terms, or without a document above 0, returns no rows. Extra columns are not read.
Very long texts are tokenised whole by the JVM's regex, no Python.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from noticeboard.llm.tables import small_side, stored

# Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP_K = 10

BLOCK = 128          # rows of one scan partition per block of a posting list
CHAMPIONS = 10       # shards of a posting list whose best posting is scored to seed the threshold
SHARDS = 64          # heaps per query before the merge, and shards of a champion list


def terms(text) -> F.Column:
    """The terms of a text column, in order, repeats kept; null text: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def index(docs: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, term bounds, block bounds) of docs(doc_id, text), stored; with wanted(term), the lists of
    those terms only (N and L still count every document).

    postings: _row, doc_id, term, tf, impact, block; bounds: term, w, top; blocks: term, block, top.
    A document's terms are sorted and counted by their runs inside its own row, so postings leave the scan
    without a shuffle; each document keeps one row for N and L besides; term bounds come from block bounds."""
    sorted_terms = F.sort_array(terms(F.col("text")))     # array_sort compares by an interpreted lambda
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", sorted_terms.alias("_t"))
    n = F.size("_t")
    ends = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (
        F.element_at("_t", i) != F.element_at("_t", i + 1)))).otherwise(F.array().cast("array<int>"))
    # The run ends are a column of their own: inside the lambda an expression would be computed per element.
    runs = F.transform("_ends", lambda e, k: F.struct(
        F.element_at("_t", e).alias("term"),
        (e - F.when(k > 0, F.element_at("_ends", k)).otherwise(0)).cast("long").alias("tf"),
        (k == 0).alias("first")))
    runs_of = rows.withColumn("_ends", ends).select("_row", "doc_id", n.cast("long").alias("_len"), F.inline(runs))
    if wanted is None:
        runs_of = runs_of.withColumn("_wanted", F.lit(True))
    else:
        marks = small_side(wanted.select("term").distinct().withColumn("_wanted", F.lit(True)))
        runs_of = runs_of.join(marks, "term", "left").filter(F.col("first") | F.col("_wanted").isNotNull())
    counted = stored(runs_of.withColumn("block", F.expr(f"_row div {BLOCK}")), "op11-postings")
    docs_n, terms_l = counted.agg(F.count(F.when(F.col("first"), 1)), F.sum(F.when(F.col("first"), F.col("_len")))).first()
    counted = counted.filter(F.col("_wanted").isNotNull())
    m = F.lit(25) + F.expr(f"(75 * _len * {docs_n or 0}) div {terms_l or 1}")
    postings = counted.select("_row", "doc_id", "term", "tf", "block", m.alias("_m")).select(
        "_row", "doc_id", "term", "tf", F.expr("(1000000000 * tf) div (1000 * tf + 8 * _m)").alias("impact"), "block")
    blocks = stored(postings.groupBy("term", "block").agg(F.max("impact").alias("top"), F.count("*").alias("_df")),
                    "op11-blocks")
    bounds = stored(blocks.groupBy("term").agg(
        F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * (docs_n or 0) + 2) / (F.lit(2.0) * F.sum("_df") + 1)))
        .cast("long").alias("w"), F.max("top").alias("top")), "op11-bounds")
    return postings, bounds, blocks.drop("_df")


def _top(scored: DataFrame, key: str, order: list[F.Column], k: int) -> DataFrame:
    """The k first rows of each key by order: per (key, shard) first, then the shards' heaps merged."""
    shard = F.abs(F.xxhash64("_row")) % SHARDS
    first = scored.withColumn("_rank", F.row_number().over(Window.partitionBy(key, shard).orderBy(*order)))
    heaps = first.filter(F.col("_rank") <= k).drop("_rank")
    return heaps.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(
        F.col("_rank") <= k)


def _exact(pairs: DataFrame, query_terms: DataFrame, postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Exact scores of (query, _row) pairs: their terms' postings read for these rows only."""
    wanted = pairs.join(query_terms, "query")
    hits = wanted.join(postings.select("term", "_row", "impact"), ["term", "_row"]).join(bounds, "term")
    return hits.groupBy("query", "_row").agg(F.sum(F.col("qtf") * F.col("w") * F.col("impact")).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """For each query of queries(query, text), its k best documents of docs(doc_id, text) with score above 0:
    query, rank (int, from 1), doc_id, score (long). See the module's notes for scores, ties and nulls."""
    query_terms = stored(queries.select("query", F.explode(terms(F.col("text"))).alias("term"))
                         .groupBy("query", "term").agg(F.count("*").alias("qtf")), "op11-query-terms")
    postings, bounds, blocks = index(docs.select("doc_id", "text"), query_terms)
    ranked = query_terms.join(bounds, "term").withColumn("ub", F.col("qtf") * F.col("w") * F.col("top"))

    # 2. Threshold from the champion lists of the query's terms.
    best = postings.groupBy("term", F.pmod("_row", F.lit(CHAMPIONS)).alias("_shard")).agg(
        F.max_by("_row", F.struct("impact", "_row")).alias("_row"))   # map-side partial: one row a term and shard
    champions = best.select("term", "_row")
    seeds = ranked.select("query", "term").join(champions, "term").select("query", "_row").distinct()
    seeded = _exact(small_side(stored(seeds, "op11-seeds")), query_terms, postings, bounds)
    kth = stored(seeded.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc())))
                 .filter(F.col("_rank") == k).select("query", F.col("score").alias("theta")), "op11-theta")

    # 3. MaxScore: non-essential terms are the cheapest prefix whose bounds stay under the threshold.
    order = Window.partitionBy("query").orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = stored(ranked.join(kth, "query", "left").fillna(0, ["theta"])
                   .withColumn("_prefix", F.sum("ub").over(order))
                   .withColumn("essential", F.col("_prefix") >= F.col("theta")), "op11-split")
    essential = small_side(split.filter("essential").select("term", "query", "qtf", "w"))
    found = (postings.select("term", "_row", "doc_id", "impact", "block").join(essential, "term")
             .groupBy("query", "_row").agg(F.sum(F.col("qtf") * F.col("w") * F.col("impact")).alias("part"),
                                            F.first("block").alias("block"), F.first("doc_id").alias("doc_id")))

    # 4. Block-max bound over the non-essential lists: per (query, block) the sum of their block maxima, so a
    # candidate meets one row; survivors then read those lists' postings, for their own rows only.
    rest = split.filter(~F.col("essential")).select("query", "term", "qtf", "w")
    reach = (rest.join(blocks, "term").groupBy("query", "block")
             .agg(F.sum(F.col("qtf") * F.col("w") * F.col("top")).alias("extra")))
    survivors = stored(
        found.join(kth, "query", "left").join(reach, ["query", "block"], "left")
        .filter(F.col("theta").isNull() | (F.col("part") + F.coalesce("extra", F.lit(0)) >= F.col("theta")))
        .select("query", "_row", "doc_id", "part"), "op11-survivors")
    late = _exact(survivors.select("query", "_row"), rest.select("query", "term", "qtf"), postings, bounds)
    scored = (survivors.join(late.withColumnRenamed("score", "late"), ["query", "_row"], "left")
              .select("query", "_row", "doc_id",
                      (F.col("part") + F.coalesce(F.col("late"), F.lit(0))).cast("long").alias("score"))
              .filter("score > 0"))

    # 5. Shard heaps merged per query.
    order_k = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    top = _top(scored, "query", order_k, k)
    return top.select("query", F.col("_rank").cast("int").alias("rank"), F.col("doc_id").cast("long"), "score")


def brute_force(docs: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The same result by scoring every (query, document) pair that shares a term: for tests."""
    postings, bounds, _ = index(docs.select("doc_id", "text"))
    query_terms = queries.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "query", "term").agg(F.count("*").alias("qtf"))
    scored = (query_terms.join(postings, "term").join(bounds, "term").groupBy("query", "_row", "doc_id")
              .agg(F.sum(F.col("qtf") * F.col("w") * F.col("impact")).cast("long").alias("score")).filter("score > 0"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_row")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query", F.col("rank").cast("int"), F.col("doc_id").cast("long"), "score")
