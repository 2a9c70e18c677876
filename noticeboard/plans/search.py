"""Phrase search, vector search and the routed search over a table of requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from noticeboard.fixed_values import (COMPACT_SEARCH_LIMIT, DEFAULT_LIMIT, KEYWORD_BONUS, MAX_LIMIT, RANK_WEIGHT)
from noticeboard.functions.annotations import merge_filter
from noticeboard.functions.scoring import (cosine, length_penalty, norm, phrase_rank, significance_boost)
from noticeboard.functions.text import (has_phrase, is_sentence, overlaps_itself, phrase_count,
                                        phrases, spaced, words)
from noticeboard.operators.annotate import embed_texts, parse_queries
from noticeboard.operators.filters import Filters, has_vector, request_filter
from noticeboard.operators.phrases import anchored, match_phrases
from noticeboard.operators.postings import PhraseIndex, candidates, occurrences, phrase_index
from noticeboard.operators.sizing import is_small
from noticeboard.operators.topn import (best_first, capped, first_n, rank_then_newest,
                                        rank_then_newest_per)
from noticeboard.operators.vectors import QUERY_BLOCK_BYTES, QUERY_BLOCK_ROWS, nearest
from noticeboard.schema import FILTER_COLUMNS, FULL_COLUMNS
from noticeboard.session import settled

# What ranking reads; wide columns join the k winners afterwards.
RANK_COLUMNS = ["id", "date", "event_category", "action_taken", "code", "significance_score",
                "tokens", "n_tokens", "n_chars"]


def rankable(notices: DataFrame) -> DataFrame:
    """The ranking columns; a table that stores n_tokens and n_chars spares the scan the texts."""
    sizes = {"n_tokens": F.size("tokens"), "n_chars": F.length("fulltext")}
    return notices.withColumns({name: value for name, value in sizes.items()
                                if name not in notices.columns}).select(*RANK_COLUMNS)


def with_keyword_score(hits: DataFrame, occurrences: Column) -> DataFrame:
    """The count is a column of its own, so that it is taken once per hit."""
    return hits.withColumn("occurrences", occurrences).withColumn(
        "score", phrase_rank(F.col("occurrences"), F.col("n_tokens"))
        + significance_boost(F.col("significance_score")) - length_penalty(F.col("n_chars")))


def search_phrase(notices: DataFrame, query: str, filters: Filters = Filters(),
                  limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One phrase query; its filters are literals and reach the scan."""
    phrase_words = words(F.lit(query))
    text = spaced(F.col("tokens"))
    hits = with_keyword_score(
        rankable(notices.filter(filters.column())).filter(has_phrase(text, phrase_words)),
        phrase_count(text, spaced(phrase_words), overlaps_itself(phrase_words)))
    winners = rank_then_newest(hits.select("id", "date", "score"), min(max(limit, 1), MAX_LIMIT))
    return winners


def prepared(requests: DataFrame) -> DataFrame:
    """Requests with `k` and the `want_` filter columns, plus `request_key`, equal for requests
    that must have equal answers."""
    wanted = [F.col(c).alias(f"want_{c}") for c in FILTER_COLUMNS]
    return requests.select("query_id", "q", *[c for c in requests.columns
                                              if c not in ("query_id", "q", "limit", *FILTER_COLUMNS)],
                           capped(F.col("limit"), 1, MAX_LIMIT, DEFAULT_LIMIT).alias("k"), *wanted)


def _request_key(*what: str) -> Column:
    shape = F.struct(*what, "k", *[f"want_{c}" for c in FILTER_COLUMNS])
    return F.sha2(F.to_json(shape, {"ignoreNullFields": "false"}), 256)


# Pairs (request, notice) of the last keyword search: holding an anchor word and passing the filters, counted in
# the first round (each request's best k by bound), counted after it (bound at least the k-th exact score).
LAST_BOUNDS: dict[str, int] = {}


def upper_score(n_tokens: Column, significance: Column, n_chars: Column) -> Column:
    """A score that no number of occurrences exceeds: the series of 1/j^2 stays under its limit, so the rank
    term stays under RANK_WEIGHT / log2(n + 1); boost and penalty are known before counting."""
    return (F.lit(RANK_WEIGHT) / F.log2(n_tokens + F.lit(1)) * F.lit(1 + 1e-9)
            + significance_boost(significance) - length_penalty(n_chars) + F.lit(1e-12))


def bounded_occurrences(index: PhraseIndex, distinct: DataFrame) -> DataFrame:
    """(request_key, _row, occurrences) of the notices that pass a request's filters and may reach its best k.

    Notices holding a request's anchor word are candidates; the best k of each request by upper score are
    counted first, and the k-th best exact score among them is a threshold that the true k-th reaches. Of the
    other candidates only those whose upper score reaches the threshold are counted; the rest can score only
    below it. The best k are those of counting every candidate."""
    phrases = distinct.select("request_key", "words")
    wanted = (candidates(index, phrases, "request_key").join(index.rows, "_row")
              .join(distinct.drop("words"), "request_key").filter(request_filter())
              .select("request_key", "_row", "k", upper_score(
                  F.col("n_tokens"), F.col("significance_score"), F.col("n_chars")).alias("_upper")))
    seen = Observation("keyword_candidates")
    wanted = settled(wanted.observe(seen, F.count(F.lit(1)).alias("pairs")), "candidates")
    by_bound = Window.partitionBy("request_key").orderBy(F.col("_upper").desc(), "_row")
    first = settled(wanted.withColumn("_r", F.row_number().over(by_bound)).filter(F.col("_r") <= F.col("k")),
                    "first-counted")
    counted = settled(occurrences(index, phrases, "request_key", among=first), "first-occurrences")
    exact = (counted.join(index.rows, "_row").join(first.select("request_key", "_row", "k"), ["request_key", "_row"])
             .select("request_key", "k", "id", "date", score_of(F.col("occurrences")).alias("score")))
    kth = (exact.withColumn("_r", F.row_number().over(Window.partitionBy("request_key").orderBy(*best_first())))
           .filter(F.col("_r") == F.col("k")).select("request_key", F.col("score").alias("_theta")))
    rest = (wanted.join(first, ["request_key", "_row"], "left_anti").join(kth, "request_key", "left")
            .filter(F.col("_theta").isNull() | (F.col("_upper") >= F.col("_theta"))))
    late = Observation("keyword_counted_late")
    rest = settled(rest.observe(late, F.count(F.lit(1)).alias("pairs")), "late-counted")
    LAST_BOUNDS.update(candidates=seen.get["pairs"], first=first.count(), late=late.get["pairs"])
    return counted.unionByName(occurrences(index, phrases, "request_key", among=rest))


def score_of(occurrences_col: Column) -> Column:
    """The score of counted occurrences in a row that holds n_tokens, significance_score and n_chars."""
    return (phrase_rank(occurrences_col, F.col("n_tokens")) + significance_boost(F.col("significance_score"))
            - length_penalty(F.col("n_chars")))


def keyword_index(notices: DataFrame, phrases: DataFrame | None = None) -> PhraseIndex:
    """The positional index of notices with the ranking columns beside it: built once, read by searches. With
    phrases(words), it answers those only."""
    return phrase_index(rankable(notices), phrases=phrases)


def keyword_search(notices: DataFrame | PhraseIndex, requests: DataFrame) -> DataFrame:
    """Phrase search for a table of requests: (query_id, id, date, score, rank, position).

    Occurrences come from the positional index (given, or built here for these requests), so the search
    reads postings of the requests' words and the ranking columns, never the texts. Requests that ask the
    same are answered once and the answer, at most MAX_LIMIT rows, is handed to each of them; requests
    without words match nothing."""
    asked = prepared(requests).withColumn("words", words(F.col("q")))
    asked = settled(asked.withColumn("request_key", _request_key("words")).drop("q")
                    .filter(F.size("words") > 0), "requests")
    distinct = asked.drop("query_id").dropDuplicates(["request_key"])
    index = notices if isinstance(notices, PhraseIndex) else keyword_index(notices, distinct.select("words"))
    found = bounded_occurrences(index, distinct)
    hits = with_keyword_score(
        found.join(index.rows, "_row").join(distinct.drop("words"), "request_key"),
        F.col("occurrences")).select("request_key", "k", "id", "date", "score")
    best = rank_then_newest_per(hits, ["request_key"], MAX_LIMIT, F.col("k"))
    return (best.join(asked.select("query_id", "request_key"), "request_key")
            .select("query_id", "id", "date", "score", "rank", "position"))


def _keyword_hits(notices: DataFrame, asked: DataFrame) -> DataFrame:
    """Best k notices of each request among those that hold one of its keywords; norms are taken once per vector."""
    asked = asked.withColumn("_vector_norm", norm(F.col("vector")))
    notices = notices.withColumn("_norm", norm(F.col("embedding")))
    lists = asked.withColumn("_lists", phrases(F.coalesce("keywords", F.array().cast("array<string>"))))
    table = (lists.select("request_key", "k", "vector", "_vector_norm", *[f"want_{c}" for c in FILTER_COLUMNS],
                          F.transform("_lists", spaced).alias("_all"),
                          F.posexplode("_lists").alias("_at", "words"))
             .withColumn("_earlier", F.slice("_all", F.lit(1), F.col("_at"))).drop("_all", "_at"))
    # A notice with several of the keywords counts at the first one only.
    first_hit = ~F.exists("_earlier", lambda p: F.contains(F.col("spaced_text"), p))
    small = is_small(asked, 4 * F.size("vector"), QUERY_BLOCK_ROWS, QUERY_BLOCK_BYTES)
    found = match_phrases(notices, table if small else table.drop("vector", "_vector_norm")) \
        .filter(request_filter() & first_hit)
    if not small:
        found = found.join(asked.select("request_key", "vector", "_vector_norm"), "request_key")
    score = cosine(F.col("embedding"), F.col("vector"), F.col("_norm"), F.col("_vector_norm"))
    scored = (found.withColumn("score", score)
              .select("request_key", "k", "id", "date", "score"))
    return (first_n(scored, ["request_key"], best_first(), MAX_LIMIT)
            .filter(F.col("rank") <= F.col("k"))
            .withColumn("score", F.col("score") + F.lit(KEYWORD_BONUS)).drop("rank"))


def semantic_search(notices: DataFrame, requests: DataFrame) -> DataFrame:
    """Vector search for a table of requests (with columns vector and, optionally, keywords).

    Filters gate before ranking. The best k by cosine plus the best k among keyword hits hold every
    row the bonus could lift into the answer, so the result is exact without scoring pairs twice.
    """
    if "keywords" not in requests.columns:
        requests = requests.withColumn("keywords", F.array().cast("array<string>"))
    asked = prepared(requests).filter(F.col("vector").isNotNull())
    asked = asked.withColumn("request_key", _request_key("vector", "keywords"))
    asked = settled(asked.select("query_id", "request_key", "vector", "keywords", "k",
                                 *[f"want_{c}" for c in FILTER_COLUMNS]), "requests")
    distinct = asked.drop("query_id").dropDuplicates(["request_key"])
    with_vectors = has_vector(notices).select(
        "id", "date", "event_category", "action_taken", "code", "significance_score", "tokens",
        "embedding")
    candidates = nearest(notices, distinct).unionByName(_keyword_hits(with_vectors, distinct))
    # A notice occurs at most twice, so the best 2k rows hold the best k notices.
    few = first_n(candidates, ["request_key"], best_first(), 2 * MAX_LIMIT).drop("rank")
    once = first_n(few, ["request_key", "id"], [F.col("score").desc_nulls_last()], 1).drop("rank")
    best = rank_then_newest_per(once, ["request_key"], MAX_LIMIT, F.col("k"))
    return (best.join(asked.select("query_id", "request_key"), "request_key")
            .select("query_id", "id", "date", "score", "rank", "position"))


def with_query_vectors(queries: DataFrame, text: str, embedder) -> DataFrame:
    """Adds `vector`; each distinct text is embedded once."""
    texts = queries.select(F.col(text).alias("_text")).distinct().withColumn("_copy", F.col("_text"))
    vectors = embed_texts(texts, "_copy", "vector", embedder).withColumnRenamed("_text", text)
    return queries.join(settled(vectors, "query-vectors"), text)


def parsed_sentences(requests: DataFrame, parser=None) -> DataFrame:
    """The sentences among the requests with `parsed`. The parser's answers are stored, so a table made
    once and given to both `search` and `responses` asks for each text once and shows what was used."""
    return parse_queries(requests.filter(is_sentence(F.col("q"))), parser)


def search(notices: DataFrame, requests: DataFrame, parser=None, embedder=None,
           sentences: DataFrame | None = None) -> DataFrame:
    """Routed search: short queries are phrases, sentences are parsed, embedded and matched by
    meaning. Result rows carry the route; responses() counts them per query."""
    keyword = requests.filter(~is_sentence(F.col("q")))
    sentences = parsed_sentences(requests, parser) if sentences is None else sentences
    merged = (sentences.withColumn("event_category", merge_filter(
                  F.col("event_category"), F.col("parsed.event_category")))
              .withColumn("action_taken", merge_filter(
                  F.col("action_taken"), F.col("parsed.action_taken")))
              .withColumn("keywords", F.col("parsed.keywords"))
              .withColumn("semantic_query", F.col("parsed.semantic_query")).drop("parsed"))
    semantic = semantic_search(notices, with_query_vectors(merged, "semantic_query", embedder))
    return (keyword_search(notices, keyword).withColumn("route", F.lit("keyword"))
            .unionByName(semantic.withColumn("route", F.lit("semantic"))))


def responses(requests: DataFrame, results: DataFrame, parser=None,
              sentences: DataFrame | None = None) -> DataFrame:
    """One row per request: route, what was parsed (sentences only) and how many rows answered."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("count"))
    sentences = parsed_sentences(requests, parser) if sentences is None else sentences
    short = requests.filter(~F.coalesce(is_sentence(F.col("q")), F.lit(False)))
    routed = (short.select("query_id", F.lit("keyword").alias("route"))
              .unionByName(sentences.select("query_id", F.lit("semantic").alias("route"), "parsed"),
                           allowMissingColumns=True))
    return routed.join(counts, "query_id", "left").select(
        "query_id", "route", "parsed", F.coalesce("count", F.lit(0)).alias("count"))


def scan(notices: DataFrame, requests: DataFrame, embedder=None) -> DataFrame:
    """Compact search: 12 rows, compact columns, and sentences matched on the raw text alone."""
    asked = requests.withColumn("limit", F.lit(COMPACT_SEARCH_LIMIT))
    keyword = keyword_search(notices, asked.filter(~is_sentence(F.col("q"))))
    sentences = asked.filter(is_sentence(F.col("q")))
    semantic = semantic_search(notices, with_query_vectors(sentences, "q", embedder))
    return with_compact(keyword.unionByName(semantic), notices)


def with_compact(results: DataFrame, notices: DataFrame) -> DataFrame:
    wide = notices.select("id", "headline", F.col("event_category").alias("category"),
                          F.col("significance_score").alias("significance"))
    return results.join(wide, "id").select(
        "query_id", "position", "id", F.date_format("date", "yyyy-MM-dd").alias("date"), "headline",
        "category", "significance")


def with_details(results: DataFrame, notices: DataFrame) -> DataFrame:
    """Joins the full columns to the winners only."""
    return results.join(notices.select(*[c for c in FULL_COLUMNS if c != "date"]), "id")


def evaluate(results: DataFrame, notices: DataFrame, cases: DataFrame) -> DataFrame:
    """Regression verdicts. cases: query_id, q, expect_hit, must_contain. The first row of the page
    is what a reader sees, so its headline (else title) is what must hold the text."""
    top = (results.filter(F.col("position") == 1)
           .join(notices.select("id", F.coalesce(F.nullif("headline", F.lit("")), F.col("title"),
                                                 F.lit("")).alias("top")), "id")
           .select("query_id", "top"))
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    joined = cases.join(counts, "query_id", "left").join(top, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    found = F.contains(F.lower(F.coalesce("top", F.lit(""))), F.lower("must_contain"))
    return joined.select("query_id", "q", "expect_hit", n.alias("n"),
                         F.when(F.col("expect_hit"), (n > 0) & found).otherwise(n == 0).alias("passed"))
